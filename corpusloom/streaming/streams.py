"""Structured Streaming jobs over fetch logs, verdicts and payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ingest import change_classes
from corpusloom.sources.changelog import ChangeLog
from corpusloom.sources.scratch import checkpoint_dir


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """New files of one table in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def fetch_health(log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Actions and errors in tumbling windows; rows later than the watermark are left out."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def error_share(log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, n, errors, share`` of actions in tumbling windows; rows later than the watermark are left out."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    failed = F.count(F.when(F.col("event_type") == "error", 1))
    return timed.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), failed.alias("errors"), (failed / F.count(F.lit(1))).alias("share")).select(F.col("w.start").alias("start"), "n", "errors", "share")


def run_totals(verdicts: DataFrame, arrived: str | None = None, late: str = "1 day") -> DataFrame:
    """Kept, dropped, unparsed and cost of each run; a repeated page of a run counts once.

    With ``arrived``, a time column, repeats are known for ``late`` after a page came, and the state
    that tells them stays as small as that; without, all pages of all runs are kept in state.
    """
    once = verdicts.dropDuplicates(["run_id", "url"]) if arrived is None else verdicts.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["run_id", "url"])
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return once.groupBy("run_id").agg(flag(F.col("keep") == 1).alias("kept"), flag(F.col("keep") == 0).alias("dropped"), flag(F.col("keep").isNull()).alias("unparsed"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its last state as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    save = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")
    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def keep_run_totals(verdicts: DataFrame, path: str, arrived: str | None = None, late: str = "1 day", checkpoint: str | None = None) -> ChangeLog:
    """Take in what is there and keep the totals of each run in a change log; only runs that changed are written.

    The stream runs in update mode, so a batch's rows are the runs it changed. A batch that is
    repeated after a failure replaces what it wrote. ``newest(["run_id"])`` of the log reads the totals.
    """
    totals = run_totals(verdicts, arrived, late)
    log = ChangeLog(verdicts.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in totals.schema))
    query = totals.writeStream.outputMode("update").foreachBatch(log.write).option("checkpointLocation", checkpoint or f"{path}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return log


#: A page as it was fetched in a batch, and as a page table has it.
FETCHED = "url string, content_hash string, source string, seen_at string"
PAGE = "url string, content_hash string, source string, first_seen string, last_seen string, last_changed string"


def page_log(spark: SparkSession, path: str) -> ChangeLog:
    """A page table as a change log."""
    return ChangeLog(spark, path, FETCHED, PAGE)


def pages_of(log: ChangeLog, upto: int | None = None) -> DataFrame:
    """The page table: the base with each later batch's row of a page merged into it, in order, as ``upsert_pages`` does.

    A page has one row a batch at most, so what is gathered for it is bounded by the batches since
    the last base; ``compact`` keeps these few.
    """
    old = log.base().select("url", F.lit(-1).alias("batch"), F.struct("content_hash", "source", "first_seen", "last_seen", "last_changed").alias("page"))
    first = F.struct(F.col("content_hash"), F.col("source"), F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), F.lit(None).cast("string").alias("last_changed"))
    rows = old.unionAll(log.log(upto).select("url", "batch", first.alias("page")))
    gathered = rows.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("batch", "page"))).alias("rows"))

    def merge(state: Column, row: Column) -> Column:
        new, at = row["page"], row["page"]["last_seen"]
        return F.when(row["batch"] < 0, new).otherwise(F.struct(
            new["content_hash"].alias("content_hash"), F.coalesce(new["source"], state["source"]).alias("source"), F.coalesce(state["first_seen"], new["first_seen"]).alias("first_seen"), at.alias("last_seen"),
            F.when(~state["content_hash"].eqNullSafe(new["content_hash"]), at).otherwise(state["last_changed"]).alias("last_changed"),
        ))

    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("content_hash", "source", "first_seen", "last_seen", "last_changed")])
    return gathered.select("url", F.aggregate("rows", none, merge).alias("x")).select("url", "x.*")


def ingest_payloads(fetched: DataFrame, log: ChangeLog, domain: str = "example.org", checkpoint: str | None = None) -> None:
    """Append each batch of fetched payloads (``raw_url, http_status, body, seq``) to a page table's log.

    Of a batch the first row of each page counts, if it was fetched; others are left out. Nothing
    stored is read, so a batch costs what it holds, and a batch that is repeated replaces itself.
    """
    nothing = fetched.sparkSession.createDataFrame([], "url string, content_hash string")

    def append(batch: DataFrame, n: int) -> None:
        seen = change_classes(batch, nothing, domain).where("change = 'new'")
        log.write(seen.select("url", F.col("new_hash").alias("content_hash"), F.lit("stream").alias("source"), F.lit(str(n)).alias("seen_at")), n)

    fetched.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint or f"{log.path}-log").trigger(availableNow=True).start().awaitTermination()
