"""Counts and breakdowns over a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.bands import freshness_band
from corpusloom.functions.numbers import rounded
from corpusloom.operators.filters import effective_type, has_keyword, keyword_match, of_types, page_key

#: Organisations that a breakdown lists.
TOP = 300


def org_breakdown(pages: DataFrame, links: DataFrame, top: int = TOP) -> DataFrame:
    """Distinct pages of each organisation; a page of several counts in each."""
    met = pages.select("url", page_key().alias("key")).join(links.select("url", "organisation_slug"), "url")
    return met.groupBy("organisation_slug").agg(F.countDistinct("key").alias("n")).orderBy(F.desc("n"), "organisation_slug").limit(top)


def type_breakdown(pages: DataFrame) -> DataFrame:
    """``type, n``: distinct pages of each effective type."""
    return pages.groupBy(effective_type().alias("type")).agg(F.countDistinct(page_key()).alias("n"))


def type_counts(pages: DataFrame, links: DataFrame, slugs: list[str]) -> DataFrame:
    """Urls of each type within organisations: distinct urls first, then the join."""
    some = links.where(F.col("organisation_slug").isin(slugs)).select("url").distinct()
    return pages.join(some, "url").groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))


def keyword_breakdown(hits: DataFrame, words: list[str]) -> DataFrame:
    """Pages of each keyword, zeros included."""
    asked = hits.sparkSession.createDataFrame([(w,) for w in words], "keyword string")
    counted = hits.select(F.explode("hits").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counted, "keyword", "left").select("keyword", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_overlap(pages: DataFrame, words: list[str]) -> DataFrame:
    """Pages of each exact combination of keywords as a bit mask; no match is left out."""
    bits = sum((F.max(has_keyword(w).cast("long")) * (1 << k) for k, w in enumerate(words)), F.lit(0))
    return pages.groupBy(page_key().alias("key")).agg(bits.alias("mask")).where("mask > 0").groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def category_summary(pages: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """``dimension, value, n, mean_age, computed_at`` of a selection's pages, by each dimension and in all, in one pass.

    The dimension ``total`` has all pages and no value. ``mean_age`` leaves out pages without a
    reading age, ``computed_at`` is the latest. An empty selection gives no rows.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("value")) for name, c in ({"total": F.lit(None)} | dimensions).items()]))
    rows = pages.select(cells.alias("c"), "reading_age", "computed_at")
    return rows.groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"), F.avg("reading_age").alias("mean_age"), F.max("computed_at").alias("computed_at"))


def audit(pages: DataFrame, links: DataFrame, organisations: list[str], types: list[str], words: list[str]) -> DataFrame:
    """Every page of the organisations with the step at which it left."""
    from corpusloom.operators.filters import with_organisations

    outcome = F.when(~of_types(types), "dropped: document type").when(~keyword_match(words), "dropped: keyword").otherwise("included")
    return with_organisations(pages, links, organisations).select("url", outcome.alias("outcome"))


def stage_stats(pages: DataFrame, asof: str) -> DataFrame:
    """Number, mean size, reading age, issues and stars, and freshness buckets of a stage, in one aggregate.

    Means leave out nulls, and are null for an empty stage.
    """
    band = freshness_band(F.col("public_updated_at"), asof)
    names = {"< 1 month": "lt_1m", "1-3 months": "m1_3", "3 months-1 year": "m3_12", "1-2 years": "y1_2", "> 2 years": "gt_2y", "Unknown": "unknown"}
    buckets = [F.sum((band == label).cast("int")).alias(name) for label, name in names.items()]
    return pages.agg(F.count(F.lit(1)).alias("n"), F.avg(F.octet_length("search_text")).alias("mean_size"), F.avg("reading_age").alias("mean_age"), F.avg("english_score").alias("mean_issues"), F.avg("english_stars").alias("mean_stars"), *buckets)


def top_classes(scanned: DataFrame, weights: dict[str, float], sample: int = 25_000) -> DataFrame:
    """Issue classes by summed weight * log2(1 + n) over the first ``sample`` urls; ``sampled`` tells if there are more."""
    total = scanned.agg(F.count(F.lit(1)).alias("total"))
    first = scanned.orderBy("url").limit(sample).select(F.explode("counts").alias("issue", "n"))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("issue")]
    out = first.groupBy("issue").agg(F.sum("n").alias("n"), F.sum(weight * F.log2(1 + F.col("n"))).alias("impact"))
    return out.crossJoin(total).select("issue", "n", "impact", (F.col("total") > sample).alias("sampled"))


def corpus_totals(pages: DataFrame, frontier: DataFrame, links: DataFrame) -> DataFrame:
    """One row: pages, fetched, unfetched, redirects, share fetched (0 for no pages), frontier size, backlog, links between pages."""
    own = pages.agg(F.count(F.lit(1)).alias("total"), F.count("content_hash").alias("fetched"), F.coalesce(F.sum(F.col("is_redirect").cast("int")), F.lit(0)).alias("redirects"))
    waiting = frontier.join(pages.where("content_hash IS NOT NULL").select("url"), "url", "left_anti").agg(F.count(F.lit(1)).alias("backlog"))
    size, linked = frontier.agg(F.count(F.lit(1)).alias("sitemap")), links.agg(F.count(F.lit(1)).alias("page_links"))
    share = F.when(F.col("total") > 0, F.col("fetched") * 100.0 / F.col("total")).otherwise(0.0)
    # One row each.
    return own.crossJoin(waiting).crossJoin(size).crossJoin(linked).withColumns({"unfetched": F.col("total") - F.col("fetched"), "pct_fetched": share})


def source_breakdown(pages: DataFrame) -> DataFrame:
    """``source, n`` of pages by where they come from, most first; ``(none)`` where that is not known."""
    return pages.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


# Counters of outcomes that failed, and of totals that are no outcomes.
FAILED = ("error", "invalid", "no_content_item", "failed", "circular", "max_depth", "gone", "external", "imported_error", "imported_no_content_item")
TOTALS = ("seen", "sources", "parents", "urls_seen", "sub_sitemaps", "children_to_import", "child_links", "binaries", "duplicate", "resolved", "content_in", "sitemap_in")


def run_health(runs: DataFrame, newest: int = 7) -> DataFrame:
    """The ``newest`` runs (``run_id, stage, status, started_at, finished_at, counters``) with seconds, errors, processed and success rate in percent.

    ``counters`` is JSON of numbers; broken or missing ones count as empty, and a run without
    outcomes has a rate of 100. Seconds are null without both times.
    """
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(newest)
    held = F.coalesce(F.from_json("counters", "map<string, double>"), F.create_map().cast("map<string, double>"))
    count = lambda keys: F.aggregate(F.map_values(keys), F.lit(0).cast("long"), lambda n, v: n + F.coalesce(v, F.lit(0.0)).cast("long"))
    bad = count(F.map_filter("c", lambda k, _: k.isin(*FAILED)))
    good = count(F.map_filter("c", lambda k, _: ~k.isin(*FAILED, *TOTALS)))
    seconds = rounded(F.unix_micros(F.try_to_timestamp("finished_at")) / 1e6 - F.unix_micros(F.try_to_timestamp("started_at")) / 1e6, 1)
    met = last.withColumn("c", held).withColumns({"errors": bad, "processed": good})
    rate = F.when(F.col("errors") + F.col("processed") > 0, F.col("processed") * 100.0 / (F.col("errors") + F.col("processed"))).otherwise(100.0)
    return met.select("run_id", "stage", "status", "started_at", seconds.alias("elapsed_s"), "errors", "processed", rate.alias("success_rate"))


def running(runs: DataFrame) -> DataFrame:
    """``n``: runs that are under way."""
    return runs.where("status = 'running'").agg(F.count(F.lit(1)).alias("n"))


def fetch_counters(log: DataFrame, actions: list[str]) -> DataFrame:
    """A column of counts for each action, by run."""
    return log.groupBy("run_id").pivot("action", actions).agg(F.count(F.lit(1))).na.fill(0)


def spend_by_day(ledger: DataFrame) -> DataFrame:
    """Daily spend and its running sum."""
    daily = ledger.groupBy(F.to_date("ts").alias("day")).agg(F.sum("cost").alias("spend"))
    return daily.withColumn("running", F.sum("spend").over(Window.orderBy("day")))  # one row a day


def spend_by_phase(ledger: DataFrame) -> DataFrame:
    """``phase, spend, calls``; calls without a cost count but add nothing."""
    return ledger.groupBy("phase").agg(F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("calls"))
