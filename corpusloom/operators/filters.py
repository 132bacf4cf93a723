"""Selection: usable pages, organisations, document types, keywords, and one row per page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_key() -> Column:
    """What makes rows one page: the content id, else the url."""
    return F.coalesce("content_id", "url")


def is_usable(redirects: bool = False, unfetched: bool = False, withdrawn: bool = False) -> Column:
    """Neither a redirect, nor without a hash, nor withdrawn; each switch lets its kind pass."""
    keep = F.lit(True)
    keep = keep if redirects else keep & ~F.coalesce("is_redirect", F.lit(False))
    keep = keep if unfetched else keep & F.col("content_hash").isNotNull()
    return keep if withdrawn else keep & ~F.coalesce("withdrawn", F.lit(False))


def with_organisations(pages: DataFrame, links: DataFrame, slugs: list[str]) -> DataFrame:
    """Pages of any of the organisations, once each. No slugs: all pages."""
    if not slugs:
        return pages
    return pages.join(links.where(F.col("organisation_slug").isin(slugs)).select("url"), "url", "left_semi")


def effective_type() -> Column:
    """An HTML publication takes its parent's type where that is known."""
    own = F.col("document_type")
    return F.when(own == "html_publication", F.coalesce(F.nullif(F.col("parent_document_type"), F.lit("")), own)).otherwise(own)


def of_types(types: list[str]) -> Column:
    """Selecting HTML publications keeps all of them, whatever their parents."""
    if not types:
        return F.lit(True)
    keep = effective_type().isin(types)
    return keep | (F.col("document_type") == "html_publication") if "html_publication" in types else keep


def keyword_text() -> Column:
    """Title, description and body in lower case, parted by blanks; missing ones are empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "description", "search_text")]))


def has_keyword(word: str) -> Column:
    """Substring match without case."""
    return keyword_text().contains(word.lower())


def keyword_match(words: list[str], match: str = "any") -> Column:
    """Substring match without case of any or all words. No words: all pages."""
    if not words:
        return F.lit(True)
    return reduce(lambda a, b: a | b if match == "any" else a & b, map(has_keyword, words))


def shortlist(pages: DataFrame, links: DataFrame, organisations=(), types=(), words=(), match: str = "any", **switches) -> DataFrame:
    """All usable rows that pass the three filters; aliases of a page are kept."""
    found = with_organisations(pages.where(is_usable(**switches)), links, list(organisations))
    return found.where(of_types(list(types)) & keyword_match(list(words), match))


def one_row(pages: DataFrame) -> DataFrame:
    """Of each page key the row of the smallest url.

    The smallest url is combined before the shuffle, so a key that very many rows share (as empty
    texts may) costs one row from each task. Rows that repeat a url all stay.
    """
    return pages.join(membership(pages).select("url"), "url", "left_semi")


def membership(pages: DataFrame) -> DataFrame:
    """``content_id, url``: each page once, with its smallest url."""
    return pages.groupBy(page_key().alias("content_id")).agg(F.min("url").alias("url"))


def membership_hits(pages: DataFrame, words: list[str]) -> DataFrame:
    """Membership with the keywords that any row of the page matches, in the given order."""
    hits = F.array_compact(F.array(*[F.when(F.max(has_keyword(w).cast("int")) == 1, w) for w in words]))
    return pages.groupBy(page_key().alias("content_id")).agg(F.min("url").alias("url"), hits.alias("hits"))


def canonical_alias(pages: DataFrame) -> DataFrame:
    """The shortest url of each page; ties by text order."""
    return pages.groupBy("content_id").agg(F.min_by("url", F.struct(F.length("url"), "url")).alias("url"))


def funnel(pages: DataFrame, links: DataFrame, organisations: list[str], types: list[str], words: list[str]) -> DataFrame:
    """Distinct pages left after each narrowing step, in one pass over the pages: flags by page, then their sums."""
    flagged = pages.where(is_usable())
    if organisations:
        some = links.where(F.col("organisation_slug").isin(organisations)).select("url").distinct().withColumn("in_org", F.lit(True))
        flagged = flagged.join(some, "url", "left")
    else:
        flagged = flagged.withColumn("in_org", F.lit(True))
    org = F.coalesce("in_org", F.lit(False))
    typed = org & of_types(types)
    steps = {"n_all": F.lit(True), "n_org": org, "n_type": typed, "n_keyword": typed & keyword_match(words)}
    per = flagged.groupBy(page_key().alias("key")).agg(*[F.max(c.cast("int")).alias(name) for name, c in steps.items()])
    return per.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in steps])


def url_check(expected: list[str], unexpected: list[str], pages: DataFrame, final: DataFrame) -> DataFrame:
    """Are the listed urls in the corpus, active, and in the final set? The first list wins."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(u, "expected", 0) for u in expected] + [(u, "unexpected", 1) for u in unexpected], "url string, list string, rank int")
    once = listed.groupBy("url").agg(F.min_by("list", "rank").alias("list"))
    corpus = pages.select("url", is_usable(withdrawn=True).alias("active"))
    return once.join(corpus, "url", "left").join(final.select("url", F.lit(True).alias("in_final")), "url", "left").select(
        "url", "list", F.col("active").isNotNull().alias("in_corpus"), F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("in_final", F.lit(False)).alias("in_final")
    )
