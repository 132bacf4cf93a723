"""A category with all that it refers to as one unit of Parquet tables, written and taken in again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose rows belong to one category, and the keys of those that categories share.
OWN = ("runs", "membership", "counts", "audit")
SHARED = {"pages": ["url"], "page_organisations": ["url", "organisation_slug", "role"], "organisations": ["slug"], "hierarchy": ["parent", "child"]}


def collect(tables: dict[str, DataFrame], category_id: int) -> dict[str, DataFrame]:
    """Every table cut down to what one category refers to.

    ``categories`` and the tables of ``OWN`` by its id, ``results`` by its runs, pages by what
    membership, results and audit name, organisations by those pages and by the edges next to
    them. An unknown category gives empty tables.
    """
    out = {"categories": tables["categories"].where(F.col("category_id") == category_id)}
    out |= {name: tables[name].where(F.col("category_id") == category_id) for name in OWN}
    out["results"] = tables["results"].join(out["runs"].select("run_id"), "run_id", "left_semi")
    urls = reduce(DataFrame.union, (out[t].select("url") for t in ("membership", "results", "audit"))).where("url IS NOT NULL").distinct()
    out["pages"] = tables["pages"].join(urls, "url", "left_semi")
    out["page_organisations"] = tables["page_organisations"].join(urls, "url", "left_semi")
    slugs = out["page_organisations"].select(F.col("organisation_slug").alias("slug")).distinct()
    named = lambda side: tables["hierarchy"].join(slugs.withColumnRenamed("slug", side), side, "left_semi").select("parent", "child")
    out["hierarchy"] = named("parent").union(named("child")).distinct()
    ends = out["hierarchy"].select(F.col("parent").alias("slug")).union(out["hierarchy"].select("child")).union(slugs).distinct()
    out["organisations"] = tables["organisations"].join(ends, "slug", "left_semi")
    return out


def write(bundle: dict[str, DataFrame], path: str) -> None:
    """One folder for each table."""
    for name, df in bundle.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def take_in(spark: SparkSession, path: str, tables: dict[str, DataFrame], owner: str | None = None) -> dict[str, DataFrame]:
    """``tables`` with a bundle in them; doing it again changes nothing.

    The category's own rows, results of its former runs included, are replaced; shared rows are
    taken over the present ones of the same key. ``owner`` becomes the category's owner.
    """
    new = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
    if owner is not None:
        new["categories"] = new["categories"].withColumn("owner", F.lit(owner))
    ids = new["categories"].select("category_id")
    out = {}
    for name, df in tables.items():
        if name in (*OWN, "categories"):
            kept = df.join(ids, "category_id", "left_anti")
        elif name == "results":
            gone = tables["runs"].join(ids, "category_id", "left_semi").select("run_id").union(new["runs"].select("run_id")).distinct()
            kept = df.join(gone, "run_id", "left_anti")
        else:
            kept = df.join(new[name].select(SHARED[name]), SHARED[name], "left_anti")
        out[name] = kept.unionByName(new[name].select(df.columns))
    return out
