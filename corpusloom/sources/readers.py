"""Readers of the corpus' input formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.urls import canonical_url, content_hash

SITEMAP = T.StructType([T.StructField("loc", T.StringType()), T.StructField("lastmod", T.StringType())])
_ORG = "slug string, link string, title string, acronym string, child_organisations array<string>, parent_organisations array<string>"
REGISTRY = f"aggregates struct<organisations: struct<options: array<struct<value: struct<{_ORG.replace(' ', ': ').replace(',:', ',')}>>>>>"


def read_sitemap(spark: SparkSession, path: str, tag: str = "url") -> DataFrame:
    """``sitemap_file, loc, lastmod`` of sitemap files; ``tag='sitemap'`` reads an index."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(SITEMAP).load(path)
    return rows.select(F.input_file_name().alias("sitemap_file"), F.trim("loc").alias("loc"), "lastmod").where("loc IS NOT NULL")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Organisations (``slug, title, acronym``) and parent, child edges of a registry file."""
    raw = spark.read.schema(REGISTRY).json(path, multiLine=True)
    org = raw.select(F.explode("aggregates.organisations.options.value").alias("v")).select("v.*")
    slug = F.coalesce("slug", F.element_at(F.split(F.regexp_replace("link", "/+$", ""), "/"), -1))
    named = org.withColumn("slug", slug)
    down = named.select(F.col("slug").alias("parent"), F.explode("child_organisations").alias("child"))
    up = named.select(F.explode("parent_organisations").alias("parent"), F.col("slug").alias("child"))
    return named.select("slug", "title", "acronym").dropDuplicates(["slug"]), down.union(up).distinct()


def read_label_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def legacy_rows(pages: DataFrame, sitemap: DataFrame, target: DataFrame, domain: str = "example.org", order: str | None = None) -> DataFrame:
    """Insert or ignore: rows of an old page table that ``target`` (``url``) lacks, in the present form.

    ``url`` canonical (rows without are left out; of several spellings of one the first as text
    stays, of rows of one spelling the first by the column ``order`` and then by what they hold),
    ``content, content_hash, source`` (sitemap where the old sitemap lists the url, else other),
    ``document_type, title, is_redirect, lastmod``. An empty body has no hash.
    """
    own = pages.withColumn("key", canonical_url(F.col("url"), domain)).where("key IS NOT NULL")
    held = [*([order] if order else []), "title", "document_type"]
    # The rows' bodies are told apart by hash, so none is shuffled to be compared.
    ranked = own.withColumn("at", F.struct("url", *held, F.sha2("content", 256)))
    first = ranked.groupBy("key").agg(F.min("at").alias("at"))
    listed = sitemap.select(canonical_url(F.col("url"), domain).alias("key"), "lastmod").where("key IS NOT NULL").groupBy("key").agg(F.max("lastmod").alias("lastmod"), F.lit("sitemap").alias("listed"))
    met = ranked.join(first, ["key", "at"], "left_semi").dropDuplicates(["key"]).join(listed, "key", "left").join(target.select(F.col("url").alias("key")), "key", "left_anti")
    return met.select(
        F.col("key").alias("url"), "content", F.when(F.col("content") != "", content_hash(F.col("content"))).alias("content_hash"), F.coalesce("listed", F.lit("other")).alias("source"), "document_type", "title",
        (F.coalesce("document_type", F.lit("")) == "redirect").alias("is_redirect"), "lastmod",
    )


def legacy_counters(pages: DataFrame, sitemap: DataFrame, domain: str = "example.org") -> DataFrame:
    """One row ``content_in, sitemap_in, content_written, sitemap_written, invalid_url`` of an import."""
    good = lambda df: F.count(canonical_url(F.col("url"), domain))
    a = pages.agg(F.count(F.lit(1)).alias("content_in"), good(pages).alias("content_written"))
    b = sitemap.agg(F.count(F.lit(1)).alias("sitemap_in"), good(sitemap).alias("sitemap_written"))
    lost = F.col("content_in") + F.col("sitemap_in") - F.col("content_written") - F.col("sitemap_written")
    return a.crossJoin(b).withColumn("invalid_url", lost)  # one row each


def with_validity(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Raw payloads, kept as they are, with ``valid``: whether the text is JSON; null and empty ones are not."""
    return payloads.withColumn("valid", F.try_parse_json(column).isNotNull())
