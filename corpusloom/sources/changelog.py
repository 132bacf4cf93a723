"""A table kept as a base and a log of plain Parquet batches; readers merge, so a batch writes its own rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChangeLog:
    """``log/batch=n`` has the rows of batch n, ``base/version=v`` the state after all batches up to v.

    A batch that is written again replaces itself. A base counts once it is complete; batches up to
    its version are then no longer read, so an old batch that comes again after it changes nothing.
    ``schema`` is that of a batch's rows, ``state`` that of the base's (the same by default).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, state: str | None = None):
        self.spark, self.path, self.schema, self.state = spark, path.rstrip("/"), schema, state or schema

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, name: str, key: str) -> list[int]:
        """The complete folders ``name/key=n``: those that Spark has marked as done."""
        files, path = self._folder(name)
        found = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(p.getName().partition("=")[2]) for p in found if p.getName().startswith(f"{key}=") and done(p))

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def version(self) -> int:
        """The newest base; -2 if there is none, -1 for one from before the first batch."""
        return max(self._numbers("base", "version"), default=-2)

    def batches(self) -> list[int]:
        """The batches that a base doesn't hold yet."""
        version = self.version()
        return [n for n in self._numbers("log", "batch") if n > version]

    def log(self, upto: int | None = None) -> DataFrame:
        """The rows of these batches with their ``batch``."""
        numbers = [n for n in self.batches() if upto is None or n <= upto]
        if not numbers:
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        return self.spark.read.schema(f"{self.schema}, batch int").option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/batch={n}" for n in numbers])

    def base(self) -> DataFrame:
        version = self.version()
        return self.spark.createDataFrame([], self.state) if version < -1 else self.spark.read.schema(self.state).parquet(f"{self.path}/base/version={version}")

    def newest(self, keys: list[str], upto: int | None = None) -> DataFrame:
        """Of base and log the newest row of each key, for tables whose rows replace one another."""
        rows = self.base().withColumn("batch", F.lit(-1)).unionByName(self.log(upto))
        others = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")

    def compact(self, state: DataFrame, upto: int) -> None:
        """Write ``state``, which must be that after batch ``upto``, as the new base; remove the batches and bases it replaces."""
        if upto <= self.version():
            return
        state.write.mode("overwrite").parquet(f"{self.path}/base/version={upto}")
        gone = [("log", "batch", n) for n in self._numbers("log", "batch") if n <= upto] + [("base", "version", v) for v in self._numbers("base", "version") if v < upto]
        for name, key, n in gone:
            files, path = self._folder(f"{name}/{key}={n}")
            files.delete(path, True)
