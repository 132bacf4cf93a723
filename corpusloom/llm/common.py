"""What the corpus operators share: scratch tables, word lists and word shingles.

Scratch tables lie in the folder that the cluster names in ``spark.checkpoint.dir``; a folder of
the machine is taken only where that setting is absent (tests in local mode).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"\w+")
#: Odd multiplier of the rolling word hash, and the finaliser's constants (64-bit golden ratio family).
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Words kept in a worker's cache before it starts anew: it bounds memory and changes no result.
CACHE_WORDS = 150_000


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one of ``spark.checkpoint.dir``.

    Only in local mode (tests) a folder of the machine is taken where that setting is absent; a
    cluster without it is refused, as executors would not see one another's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return "/".join([found.rstrip("/"), spark.sparkContext.applicationId, *_SCOPES])


#: Folders within the application's that what is written now goes to.
_SCOPES: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[None]:
    """What is written to the scratch folder within this goes to a folder of its own, which is deleted at the end."""
    _SCOPES.append(f"{name}-{uuid.uuid4().hex}")
    path = scratch_dir(spark)
    try:
        yield
    finally:
        _SCOPES.pop()
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the scratch folder; for use when its results are stored elsewhere."""
    _delete(spark, scratch_dir(spark))


def discard(spark: SparkSession, df: DataFrame | None) -> None:
    """Delete the table that ``materialise`` has written for ``df``; null and other DataFrames are left alone."""
    if path := getattr(df, "scratch_path", None):
        _delete(spark, path)


def materialise(df: DataFrame, name: str = "step", folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    It cuts the lineage: a lost executor repeats a read, not the work above it, and row ids given
    by ``monotonically_increasing_id`` no longer change.
    """
    spark = df.sparkSession
    path = f"{folder or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


class WordHashes(dict):
    """word -> 64-bit hash, kept while the worker lives and begun anew at ``CACHE_WORDS``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = WordHashes()


def words(text: str | None) -> list[str]:
    """Lower-case words: runs of letters, digits and underscores. Null has none."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(tokens: list[str], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words.

    Fewer words than that make one shingle of all words; no word makes none.
    """
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(_rolled(word_hashes(tokens), min(size, len(tokens))))


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    count = len(hashes) - size + 1
    out = np.full(count, np.uint64(size))
    for k in range(size):
        out = (out ^ hashes[k : k + count]) * _MULT
        out ^= out >> np.uint64(29)
    for factor in _MIX:
        out = (out ^ (out >> np.uint64(30))) * factor
    return out ^ (out >> np.uint64(31))


def ordered_shingles(tokens: list[str], size: int = 5) -> np.ndarray:
    """The shingles of ``shingle_hashes`` in text order, repeats kept."""
    if not tokens:
        return np.empty(0, np.uint64)
    return _rolled(word_hashes(tokens), min(size, len(tokens)))
