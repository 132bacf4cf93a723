"""Rounded numbers at and beside halves, against DuckDB's."""

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions.numbers import rounded
from corpusloom.functions.readability import grade
from corpusloom.operators import runs


def test_rounded(spark):
    values = [(29.849999999999998, 1), (0.145, 2), (-0.03, 1), (0.03, 1), (-0.25, 1), (0.25, 1), (2.675, 2), (1e300, 9), (0.0, 3), (1 / 3, 9), (None, 2), (float("inf"), 1)]
    got = spark.range(1).select(*[rounded(F.lit(v).cast("double"), p).alias(f"x{n}") for n, (v, p) in enumerate(values)]).first()
    want = [duckdb.execute(f"SELECT round(?::DOUBLE, {p})", [v]).fetchone()[0] for v, p in values]
    assert list(map(repr, got)) == list(map(repr, want))


def test_grade_at_a_half(spark):
    """56 words of two syllables in one sentence: 29.85, whose double lies below."""
    df = spark.createDataFrame([("label " * 56 + ".",)], "t string")
    assert df.select(grade(df.t)).first()[0] == 29.9


def test_commonest_score_beside_a_half(spark):
    """0.145 is 14.499999999999998 hundredths, so it counts with 0.14."""
    rows = spark.createDataFrame([(1, 0.145), (1, 0.14), (1, 0.15)], "keep int, score double")
    got = runs.discriminability(rows).first()
    assert (got.top_score, round(got.top_share, 6)) == (0.14, 66.666667)
