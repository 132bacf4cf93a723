"""Exports and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """An export as CSV with a header, or as JSON lines."""
    writer = rows.write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if fmt == "csv" else writer.json(path)


def write_label_sheet(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns, nulls empty."""
    rows.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True, escape='"')


def write_audit(audit: DataFrame, path: str) -> None:
    """One folder for each outcome."""
    audit.write.mode("overwrite").partitionBy("outcome").parquet(path)


def write_report(tables: dict[str, DataFrame], summary: DataFrame, path: str) -> None:
    """A report bundle: each table as CSV with a header, and a summary of a few rows as JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True, escape='"')
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
