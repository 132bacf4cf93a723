"""Exact deduplication against a persistent index of digests, in DataFrame operations only."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialise, scratch_dir

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Buckets of a new index. A bucket should stay in an executor's memory: about one per 20 million digests.
BUCKETS = 32
#: Spark's setting by which buckets of one file count as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Number of a batch without rows that every index has.
EMPTY = -1
#: Parts in which a table goes into an index.
PARTS = 2


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(text: Column) -> Column:
    """Lower-case hex sha256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """A table of known digests at a shared path, bucketed and sorted by digest, which only grows.

    Columns: ``text_sha256``; ``keep_id``, ``keep_row``, ``n_chars`` of the text that stands for the
    digest; and ``batch``, the number of the batch that brought it, by which the table is
    partitioned. The buckets let the anti-join read the index without a shuffle, and without a sort
    where a bucket is one file, as in a copy by ``compact``. Any session that gives the same path opens
    the same index, whatever its catalog knows. A batch is written in one step over its own
    partition, so one that is run again replaces what it wrote before. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, id_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.buckets, self.id_type = spark, buckets, id_type
        self.path = path or f"{scratch_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        if not spark.catalog.tableExists(self.name):
            columns = f"text_sha256 STRING, keep_id {id_type}, keep_row BIGINT, n_chars INT, batch BIGINT"
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.path}'")
            # A batch without rows makes the folder; then what other sessions have written is found in it.
            self._write(spark.createDataFrame([], spark.table(self.name).drop("batch").schema), EMPTY)
        spark.catalog.recoverPartitions(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def next_batch(self) -> int:
        """One more than the largest batch number; 0 for an empty index."""
        return max(self.batches(), default=-1) + 1

    def batches(self) -> list[int]:
        """Numbers of the batches that the index holds."""
        found = (int(r[0].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())
        return sorted(k for k in found if k != EMPTY)

    def unseen(self, groups: DataFrame, batch: int, first: int | None = None) -> DataFrame:
        """Rows of ``groups`` (one per ``text_sha256``) that batches before ``batch`` don't settle, by a sort-merge anti-join.

        A digest is settled if a batch before ``first`` has it, whatever the text, or one from
        ``first`` on (an earlier part of the same run) has it for a text that goes before.
        """
        first = batch if first is None else first
        known = self.table().where((F.col("batch") > EMPTY) & (F.col("batch") < batch)).select("text_sha256", F.col("batch").alias("old_batch"), _rank("keep_id", "keep_row", "n_chars").alias("old")).hint("merge")
        new = groups.withColumn("new", _rank("keep_id", "keep_row", "n_chars"))
        settled = (new["text_sha256"] == known["text_sha256"]) & ((known["old_batch"] < first) | (known["old"] < new["new"]))
        return new.join(known, settled, "left_anti").drop("new")

    def append(self, groups: DataFrame, batch: int, first: int | None = None) -> None:
        """Add what ``unseen`` returns of ``groups`` as ``batch``, in place of what that batch held."""
        before = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")  # a bucket of one file is read in its order
        try:
            new = materialise(self.unseen(groups.select("text_sha256", "keep_id", "keep_row", "n_chars"), batch, first), "digests")
        finally:
            self.spark.conf.set(ORDERED, before)
        self._write(new, batch)

    def compact(self, path: str) -> DigestIndex:
        """A copy of the index at another shared path with all batches in one, so that each bucket is one file.

        The old one stays until its folder is deleted; its batches can't be run again on the copy.
        """
        out = DigestIndex(self.spark, path, self.id_type, self.buckets)
        out._write(self.best(), max(self.batches(), default=0))
        return out

    def best(self, first: int = 0, among: DataFrame | None = None) -> DataFrame:
        """One row per digest: that of the oldest batch before ``first``, else of the text that goes before. No shuffle of the index.

        ``among`` (one row per ``text_sha256``, with further columns that are kept) limits it to
        these digests: they meet the index before anything is grouped, so a batch costs what it
        holds and the sorted read of the index.
        """
        order = F.struct(F.least("batch", F.lit(first)).alias("age"), _rank("keep_id", "keep_row", "n_chars").alias("rank"))
        more = [] if among is None else [c for c in among.columns if c != "text_sha256"]
        rows = self.table() if among is None else self.table().join(among.hint("merge"), "text_sha256")
        found = rows.groupBy("text_sha256").agg(F.min(order).alias("best"), *[F.first(c).alias(c) for c in more])
        rank = "best.rank"
        return found.select("text_sha256", *more, F.col(f"{rank}.id").alias("keep_id"), F.col(f"{rank}.row").alias("keep_row"), (-F.col(f"{rank}.minus")).alias("n_chars"), F.col("best.age").alias("age"))

    def _write(self, rows: DataFrame, batch: int) -> None:
        dealt = rows.select("text_sha256", "keep_id", "keep_row", "n_chars").repartition(self.buckets, "text_sha256")
        view = f"new_{uuid.uuid4().hex}"
        dealt.createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {batch}) SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)


def _rank(id_col: str, row_col: str, chars: str) -> Column:
    """Of equal texts the least of these stays: the longest, then the smallest id (null last), then the first row."""
    return F.struct((-F.col(chars)).alias("minus"), F.col(id_col).isNull().alias("nul"), F.col(id_col).alias("id"), F.col(row_col).alias("row"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row per document: ``doc_id``, ``text_sha256``, ``n_chars``, ``row_id``.

    ``row_id`` tells rows apart that repeat an id. Every text is hashed once, in the scan.
    """
    text = F.col(text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("text_sha256"), F.length(F.coalesce(text, F.lit(""))).alias("n_chars"))
    return materialise(out.withColumn("row_id", F.monotonically_increasing_id()), "rows")


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: ``keep_row``, ``keep_id``, ``n_chars`` and ``group_size``.

    The longest original text wins, then the smallest id (null counts as largest), then the first
    row. The minimum is combined before the shuffle: a digest that a third of all rows share
    sends one row from each task.
    """
    best = rows.groupBy("text_sha256").agg(F.min(_rank("doc_id", "row_id", "n_chars")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select("text_sha256", "group_size", (-F.col("best.minus")).alias("n_chars"), F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: int | None = None, parts: int = PARTS) -> DataFrame:
    """Judge every row: ``doc_id, keep_id, group_size, kept, text_sha256`` (and ``n_chars, row_id``).

    The rows go into the index in ``parts`` parts, each anti-joined with what the index holds and
    appended; the verdicts are then read from the index. A row whose digest an earlier batch
    brought is dropped in favour of the row that the index names; of the others the winner of each
    digest stays, over all parts. Without an index, a new one is made. ``group_size`` counts the
    rows of ``docs``.

    ``batch`` is the number of the first part, the others follow; by default they come after all
    that the index holds. A batch is judged by smaller numbers alone and replaces what the same
    numbers wrote, so a run that failed at any point is run again with the same number and the
    same answer.

    Null and empty texts, and texts of blanks only, are equal to one another. Rows that repeat a
    text and an id are told apart: one stays. Null ids lose against others. No rows give no rows.
    Further columns of ``docs`` are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    index = index or DigestIndex(docs.sparkSession, id_type=id_type)
    first = index.next_batch() if batch is None else batch
    rows = digests(docs, id_col, text_col)
    part = F.pmod(F.xxhash64("row_id"), F.lit(parts))
    for k in range(parts):
        index.append(winners(rows.where(part == k)), first + k, first)
    sizes = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    named = index.best(first, sizes).select("text_sha256", "group_size", "keep_id", "keep_row", (F.col("age") < first).alias("old"))
    # One row a digest on one side, so a digest of very many rows is split.
    joined = rows.join(named.hint("merge"), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", (~F.col("old") & (F.col("row_id") == F.col("keep_row"))).alias("kept"), "text_sha256", "n_chars", "row_id")


def keep_first(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Of rows that are equal but for blanks, or by null and empty texts, the longest stays, then the
    one with the smallest id; null ids come last. Rows meet their verdict on id, digest and length;
    of rows that repeat all three, one stays. No rows give no rows; no column of ``docs`` is
    changed, whatever its name.
    """
    at, sha, chars = fresh(docs, "id"), fresh(docs, "digest"), fresh(docs, "chars")
    verdicts = exact_dedup(docs, index, id_col, text_col, batch).where("kept").select(F.col("doc_id").alias(at), F.col("text_sha256").alias(f"{sha}_kept"), F.col("n_chars").alias(f"{chars}_kept"))
    marked = docs.withColumn(sha, digest(F.col(text_col))).withColumn(chars, F.length(F.coalesce(F.col(text_col), F.lit(""))))
    met = marked.join(verdicts, marked[id_col].eqNullSafe(verdicts[at]) & (marked[sha] == verdicts[f"{sha}_kept"]) & (marked[chars] == verdicts[f"{chars}_kept"]), "left_semi")
    return met.dropDuplicates([id_col, sha, chars]).drop(sha, chars)
