"""Removal of repeated passages of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise

#: Lines of a window.
WINDOW = 3


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at line feeds; null counts as empty (one empty line)."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (``nul``, ``id``, ``sum``, ``lines``), every window but its first: ``nul``, ``id``, ``sum``, ``pos``.

    A window is hashed to 128 bits (two 64-bit hashes of its lines). Its first occurrence is the
    smallest (nul, id, sum, position). A window that very many rows share is met by a minimum that
    is combined before the shuffle. The join back has one row a window on its other side, and both
    sides are plain tables, so adaptive execution splits such a window over tasks.
    """
    n = F.size("lines") - (WINDOW - 1)
    window = lambda seed, i: F.xxhash64(F.lit(seed), *[F.element_at("lines", i + k) for k in range(WINDOW)])
    hashed = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i - 1).alias("pos"), window(7, i).alias("h1"), window(11, i).alias("h2")))
    windows = materialise(rows.where(n >= 1).select("nul", "id", "sum", F.inline(hashed)), "windows")
    order = F.struct("nul", "id", "sum", "pos")
    counted = windows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    again = windows.join(materialise(counted, "repeated").hint("merge"), ["h1", "h2"])
    return materialise(again.where(~order.eqNullSafe(F.col("first"))).select("nul", "id", "sum", "pos"), "repeats")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every row: ``doc_id, text, n_lines, removed`` (positions from 0, sorted).

    All runs of three consecutive lines are compared over the whole table. Of each that occurs
    again, every occurrence but the first (smallest id, then smallest position) is covered, and
    the union of covered positions is removed; overlapping occurrences merge. ``text`` is what
    remains, joined by line feeds; null when the text was null, empty when nothing remains.

    A null or empty text and one of fewer than three lines lose nothing. Ids of any type that Spark
    can order go in its order; a null id comes after all others. Rows that repeat an id are told
    apart by a hash of their text; rows that repeat both are one document, whose result each of
    them gets. No rows give no rows. Further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select("*", F.col("doc_id").isNull().alias("nul"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("sum"))
    again = repeated_windows(keyed.select("nul", "id", "sum", lines_of(F.col("text")).alias("lines")))
    covered = again.select("nul", "id", "sum", F.explode(F.sequence(F.col("pos"), F.col("pos") + (WINDOW - 1))).alias("at"))
    gone = materialise(covered.groupBy("nul", "id", "sum").agg(F.array_sort(F.collect_set("at")).alias("removed")), "covered")
    # Merged at every size: what repeats grows with the corpus, so a broadcast would only fit small inputs.
    gone = gone.select(F.col("id").alias("gone_id"), F.col("sum").alias("gone_sum"), "removed").hint("merge")
    met = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sum") == F.col("gone_sum")), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    # What stays is a difference of sets of positions, so a text of many lines costs as many steps.
    lines = lines_of(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    rest = F.array_join(F.element_at(F.transform(F.array(lines), lambda own: F.transform(left, lambda i: own[i])), 1), "\n")
    return met.select("doc_id", F.when(F.size("removed") > 0, rest).otherwise(F.col("text")).alias("text"), F.size(lines_of(F.col("text"))).alias("n_lines"), "removed")
