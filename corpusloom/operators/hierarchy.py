"""Organisation hierarchy: edges, descendants, expansion, forest, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.filters import page_key
from corpusloom.operators.paths import follow
from corpusloom.sources.scratch import cut


def edges_from_both(down: DataFrame, up: DataFrame) -> DataFrame:
    """Distinct parent, child pairs from what parents and what children declare."""
    return down.select("parent", "child").union(up.select("parent", "child")).where("parent IS NOT NULL AND child IS NOT NULL").distinct()


def children(edges: DataFrame, slug: str) -> DataFrame:
    """Direct children of ``slug``, each once; none for an unknown one."""
    return edges.where(F.col("parent") == slug).select(F.col("child").alias("slug")).distinct()


def expand(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(root, slug)``: for each root all that lies below its seeds (``root, slug``), seeds excluded unless a cycle leads back.

    One join for each level, of what the level before found alone; what was found before is not
    followed again, so cycles end, and any depth does. No seeds give no rows. The joins are merged at
    every size: edges and what is found grow with the input, and each level would broadcast them anew.
    """
    step = edges.select(F.col("parent").alias("slug"), "child").hint("merge")
    frontier = cut(seeds.join(step, "slug").select("root", F.col("child").alias("slug")).distinct())
    found = frontier
    while True:
        frontier = cut(frontier.join(step, "slug").select("root", F.col("child").alias("slug")).distinct().join(found.hint("merge"), ["root", "slug"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.union(frontier))


def descendants(edges: DataFrame, slug: str) -> DataFrame:
    """All that lies below ``slug``, itself only where a cycle leads back."""
    seeds = edges.sparkSession.createDataFrame([(slug, slug)], "root string, slug string")
    return expand(edges, seeds).select("slug")


def with_descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds and all below them, by root."""
    return seeds.select("root", "slug").union(expand(edges, seeds)).distinct()


def forest(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """``slug, parent, depth, pages``: each child keeps the parent with most pages, then the first by name.

    Loops are left out. A member of a cycle of kept parents is a root, and what hangs on it stays
    below it. Slugs without a count have 0 pages. No edges give no rows. Cycles and depths are found
    by path doubling, so any depth does.
    """
    real = edges.where("parent <> child").select("parent", "child")
    sized = real.join(counts.select(F.col("slug").alias("parent"), "pages"), "parent", "left")
    # The greatest by pages, of equals the first by name: combined before the shuffle.
    one = cut(sized.groupBy("child").agg(F.min_by("parent", F.struct(-F.coalesce("pages", F.lit(0)), "parent")).alias("parent")))
    ring = follow(one.select(F.col("child").alias("node"), F.col("parent").alias("next"))).where("looped").select(F.col("end").alias("child")).distinct()
    below = cut(one.join(ring, "child", "left_anti"))
    depths = follow(below.select(F.col("child").alias("node"), F.col("parent").alias("next"))).select(F.col("node").alias("slug"), F.col("hops").alias("depth"))
    slugs = edges.select(F.col("parent").alias("slug")).union(edges.select("child")).distinct()
    met = slugs.join(below.select(F.col("child").alias("slug"), "parent"), "slug", "left").join(depths, "slug", "left").join(counts.select("slug", "pages"), "slug", "left")
    return met.select("slug", "parent", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("pages", F.lit(0)).alias("pages"))


def page_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``slug, pages``: distinct pages of each organisation; aliases of a page count once, pages without links not at all."""
    met = pages.select("url", page_key().alias("key")).join(links.select("url", "organisation_slug"), "url")
    return met.groupBy(F.col("organisation_slug").alias("slug")).agg(F.countDistinct("key").alias("pages"))


def registry_list(organisations: DataFrame) -> DataFrame:
    """Organisations outside ``world`` by title: ``slug, title``, the slug's words where there is no title."""
    own = organisations.where(~F.col("slug").startswith("world"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.initcap(F.replace(F.col("slug"), F.lit("-"), F.lit(" "))))
    return own.select("slug", title.alias("title")).distinct().orderBy(F.lower("title"), "slug")
