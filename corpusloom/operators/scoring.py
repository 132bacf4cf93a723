"""Scoring pages by a caller's function, in a stored run that can be interrupted and continued."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A scorer takes some pages and returns as many verdicts in their order: ``keep, score, reason`` or fewer of these.
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
#: What a run stores for each page.
VERDICT = "url string, content_hash string, keep int, score double, reason string, error string, ms bigint"
#: Parts that a run is written in by default; each is kept once it is done.
PARTS = 16


def keyword_scorer(words: list[str]) -> Scorer:
    """The default: the share of the words that a page's text holds, in any case; kept with one or more. A null text holds none."""
    low = [w.lower() for w in words]
    if not low:
        raise ValueError("no words")

    def score(pages: pd.DataFrame) -> pd.DataFrame:
        found = pages["text"].fillna("").str.lower().map(lambda t: sum(w in t for w in low))
        return pd.DataFrame({"keep": (found > 0).astype("int32"), "score": found / len(low)})

    return score


def score_batch(pages: pd.DataFrame, scorer: Scorer) -> pd.DataFrame:
    """A verdict row for each page of a batch.

    Where the scorer fails on the batch, or returns another number of rows, each page is tried
    alone; a page on which it fails again gets no verdict and the error's text. A verdict other than
    0 and 1 counts as none.
    """
    start = time.monotonic()
    try:
        found = scorer(pages.reset_index(drop=True)).reset_index(drop=True)
        if len(found) != len(pages):
            raise ValueError(f"{len(found)} verdicts for {len(pages)} pages")
        error = pd.Series([None] * len(pages), dtype="object")
    except Exception as failure:  # any fault of the caller's function is the page's result
        if len(pages) > 1:
            return pd.concat([score_batch(pages.iloc[i : i + 1], scorer) for i in range(len(pages))], ignore_index=True)
        found, error = pd.DataFrame(index=range(1)), pd.Series([f"{type(failure).__name__}: {failure}"[:1000]])
    column = lambda name, kind: found[name].astype(kind) if name in found else pd.Series([None] * len(pages), dtype=kind)
    keep = pd.to_numeric(column("keep", "object"), errors="coerce")
    return pd.DataFrame({
        "url": pages["url"].to_numpy(), "content_hash": pages["content_hash"].to_numpy() if "content_hash" in pages else None, "keep": keep.where(keep.isin([0, 1])).astype("Int32"), "score": pd.to_numeric(column("score", "object"), errors="coerce").astype("Float64"),
        "reason": column("reason", "object"), "error": error.to_numpy(), "ms": int(1000 * (time.monotonic() - start) / max(1, len(pages))),
    })


class ScoringRun:
    """One run's verdicts under a path: ``part=n/attempt=m`` for each part and each time it was worked on.

    A part is a job of its own, whose files appear when it is done. What is stored is never asked
    for again: a run that stopped goes on with the pages that have no row, and asking twice changes
    nothing. Lost executors repeat their own pages only.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def results(self) -> DataFrame:
        """The verdicts so far, one a page: ``url, content_hash, keep, score, reason, error, ms``. Of several attempts the last counts."""
        rows = self._stored()
        last = rows.groupBy("url").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("part", "url")]), "attempt").alias("x"))
        return last.select("url", "x.content_hash", "x.keep", "x.score", "x.reason", "x.error", "x.ms")

    def _stored(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"{VERDICT}, part int, attempt int"
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def part(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.parts)).cast("int")

    def pending(self, pages: DataFrame, again: bool = False) -> DataFrame:
        """Pages without a stored row; with ``again`` also those whose last attempt failed. Null urls are left out."""
        done = self.results()
        done = done.where("error IS NULL") if again else done
        return pages.where("url IS NOT NULL").join(done.select("url"), "url", "left_anti")

    def score(self, pages: DataFrame, scorer: Scorer, parts: list[int] | None = None, again: bool = False, batch: int | None = None) -> None:
        """Ask for the pages (``url, text`` and whatever the scorer reads) that are pending, part by part.

        Of repeated urls one page is asked for. ``parts`` limits the call to some parts, as a worker
        or a time limit may; ``again`` asks anew where an attempt failed; ``batch`` is the number of
        pages that the scorer gets at a time, Spark's own by default.
        """
        names = pages.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pages in batches:
                for at in range(0, len(pages), batch or len(pages)):
                    yield score_batch(pages.iloc[at : at + (batch or len(pages))], scorer)

        attempt = (self._stored().agg(F.max("attempt").alias("a")).first().a or 0) + 1
        wanted = pages if parts is None else pages.where(self.part(F.col("url")).isin(parts))
        one = self.pending(wanted, again).groupBy("url").agg(F.max(F.struct(*[c for c in names if c != "url"])).alias("x")).select("url", "x.*")
        # What is pending is dealt into its parts once, so each part reads its own pages only.
        todo = f"{self.path}-todo/{uuid.uuid4().hex}"
        one.withColumn("part", self.part(F.col("url"))).write.partitionBy("part").parquet(todo)
        dealt = self.spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in one.schema)}, part int").parquet(todo)
        for n in sorted(r.part for r in dealt.select("part").distinct().collect()):
            dealt.where(F.col("part") == n).select(*names).mapInPandas(run, VERDICT).write.mode("overwrite").parquet(f"{self.path}/part={n}/attempt={attempt}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}-todo")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
