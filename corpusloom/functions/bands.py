"""Bands over dates, reading ages and scores. The labels and cut points are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def freshness_band(updated: Column, asof: str) -> Column:
    """Six bands of an ISO timestamp by text order against ``asof`` less 30, 91, 365 and 730 days."""
    edge = lambda days: F.date_format(F.date_sub(F.to_date(F.lit(asof)), days), "yyyy-MM-dd")
    return (
        F.when(F.coalesce(updated, F.lit("")) == "", "Unknown")
        .when(updated >= edge(30), "< 1 month")
        .when(updated >= edge(91), "1-3 months")
        .when(updated >= edge(365), "3 months-1 year")
        .when(updated >= edge(730), "1-2 years")
        .otherwise("> 2 years")
    )


def reading_band(age: Column) -> Column:
    """Band of a reading age; Unknown without one."""
    return F.when(age.isNull(), "Unknown").when(age < 9, "Under 9").when(age < 12, "9-11").when(age < 15, "12-14").when(age < 18, "15-17").otherwise("18+")


def confidence(score: Column) -> Column:
    """How central a topic is by its score; empty without one."""
    return F.when(score.isNull(), "").when(score <= 0, "Wrong sense").when(score <= 0.35, "Mentioned in passing").when(score <= 0.65, "Discussed a moderate amount").otherwise("Major focus")


#: The bands of ``score_band`` in order of scores.
BAND_ORDER = ("0", "0.1-0.3", "0.4-0.6", "0.7-1.0")


def score_band(score: Column) -> Column:
    """Band of a score for strata and calibration; unscored without one."""
    return F.when(score.isNull(), "unscored").when(score <= 0, "0").when(score <= 0.35, "0.1-0.3").when(score <= 0.65, "0.4-0.6").otherwise("0.7-1.0")


def score_bucket(score: Column) -> Column:
    """Histogram bucket 0 to 5; a missing score counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s <= 0, 0).when(s <= 0.12, 1).when(s <= 0.23, 2).when(s <= 0.35, 3).when(s <= 0.65, 4).otherwise(5)


def zone(bucket: Column) -> Column:
    """What becomes of a bucket: drop, borderline or confident."""
    return F.when(bucket == 0, "drop").when(bucket <= 3, "borderline").otherwise("confident")
