"""Bounded samples of labelled rows, for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a model is fitted on at most.
TRAIN_ROWS = 3000


def held_out(id_col: str | Column) -> Column:
    """True where crc32 of the id, written as text, leaves 1 when divided by 3. A null id is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", all_folds: bool = False) -> DataFrame:
    """``id, text, y`` of at most ``limit`` documents that have a label, chosen by a hash of the id.

    Held-out documents are left out unless ``all_folds``. A document with several labels gets the
    largest. The sample is picked among the labels alone, so the texts are read once and only the
    chosen ones leave the scan; ``limit`` bounds what is broadcast. Documents that repeat an id all
    come, so what is collected is limited again (``first_rows``).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if not all_folds:
        known = known.where(~held_out(id_col))
    once = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    # Counted first, so that a little more than the limit reaches the last sort at any size.
    share = min(1.0, 1.5 * limit / max(once.count(), 1))
    point = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 40))
    chosen = once.where(point < int(share * (1 << 40))).orderBy(point, "id").limit(limit)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id")


def first_rows(sample: DataFrame, limit: int) -> list:
    """At most ``limit`` rows, by id, in one job."""
    return sample.orderBy("id").limit(limit).collect()
