"""Exportable fields of a selection, and its lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.bands import freshness_band
from corpusloom.operators.filters import effective_type, one_row

#: Rows of an export, unless asked otherwise.
MOST = 100_000


def fields(asof: str) -> dict[str, Column]:
    """The 22 fields by name, over page columns and those of ``page_organisations``."""
    own = ("title", "document_type", "source", "last_seen_at", "search_text", "content", "first_published_at", "public_updated_at", "view_count", "view_count_source", "view_count_updated")
    made = {
        "url": F.col("url"),
        "effective_document_type": effective_type(),
        "parent_document_type": F.coalesce("parent_document_type", F.get_json_object("content", "$.links.parent[0].document_type"), F.get_json_object("content", "$.links.parent.document_type")),
        "organisations": F.col("organisations"),
        "primary_org": F.col("primary_org"),
        "size": F.octet_length("search_text").cast("long"),
        "readability": F.col("reading_age"),
        "english_issues": F.col("english_score"),
        "english_findings": F.col("english_findings"),
        "english_stars": F.col("english_stars"),
        "last_update_band": freshness_band(F.col("public_updated_at"), asof),
    }
    return made | {name: F.col(name) for name in own}


def page_organisations(links: DataFrame) -> DataFrame:
    """``url, organisations, primary_org``: the slugs in order as text, and the first primary one."""
    return links.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("organisation_slug")), ", ").alias("organisations"), F.min(F.when(F.col("role") == "primary", F.col("organisation_slug"))).alias("primary_org"))


def export(pages: DataFrame, links: DataFrame, names: list[str], asof: str, limit: int | None = MOST, offset: int = 0) -> DataFrame:
    """The chosen fields of each page of a selection once, url first, by url.

    Unknown names are dropped, and url need not be named. Organisations are joined only if asked
    for; a page without links has null ones. The limit is the export's own.
    """
    known = fields(asof)
    keys = ["url", *[n for n in names if n in known and n != "url"]]
    rows = one_row(pages)
    if {"organisations", "primary_org"} & set(keys):
        rows = rows.join(page_organisations(links.join(rows.select("url"), "url", "left_semi")), "url", "left")
    out = rows.select(*[known[k].alias(k) for k in keys]).orderBy("url").offset(offset)
    return out if limit is None else out.limit(limit)


def stacked(exports: dict[str, DataFrame]) -> DataFrame:
    """Exports of several runs under one another, with the run's id as ``run_id`` in front; missing columns are null."""
    out = None
    for run, df in exports.items():
        own = df.select(F.lit(run).alias("run_id"), *df.columns)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out


def urls(pages: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The urls of a selection, each page once, by url."""
    return _paged(one_row(pages).select("url"), limit, offset)


def titles(pages: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``url, title`` of each page once, by url."""
    return _paged(one_row(pages).select("url", "title"), limit, offset)


def details(pages: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``url, title, size_bytes, updated`` of each page once, by url."""
    return _paged(one_row(pages).select("url", "title", F.octet_length("search_text").cast("long").alias("size_bytes"), F.col("public_updated_at").alias("updated")), limit, offset)


def _paged(rows: DataFrame, limit: int | None, offset: int) -> DataFrame:
    rows = rows.orderBy("url").offset(offset)
    return rows if limit is None else rows.limit(limit)
