"""Comparison of a shortlist with the hits of an outside search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per link of ``phrase_no, phrase, link, title, document_type, es_score, hit_no``.

    Phrases in order, the highest score, and title, type and rank of the first hit.
    """
    phrases = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("phrase_no", "phrase"))), lambda p: p["phrase"]))
    order = F.struct("hit_no", "phrase_no")
    return hits.groupBy("link").agg(phrases.alias("phrases"), F.max("es_score").alias("es_score"), F.min_by("title", order).alias("title"), F.min_by("document_type", order).alias("document_type"), F.min("hit_no").alias("first_hit"))


def phrase_totals(hits: DataFrame, cap: int) -> DataFrame:
    """``phrase, total, within, capped``: hits of each phrase, those up to the cap, and whether there are more."""
    per = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("total"))
    return per.select("phrase", "total", F.least(F.col("total"), F.lit(cap)).alias("within"), (F.col("total") > cap).alias("capped"))


def hit_types(merged: DataFrame) -> DataFrame:
    """``document_type, n`` of merged hits; a missing type is ``unknown``."""
    return merged.groupBy(F.coalesce(F.nullif(F.col("document_type"), F.lit("")), F.lit("unknown")).alias("document_type")).agg(F.count(F.lit(1)).alias("n"))


def compare(shortlist: DataFrame, hits: DataFrame) -> DataFrame:
    """Union of both by page key: ``key, url, title, document_type, source, phrases, matched, es_score``.

    ``shortlist`` has ``key, url, title, document_type, matched`` (its keywords); ``hits`` has
    ``key, url, title, document_type, phrases, es_score, first_hit``. Source is both, shortlister
    or search. Of several hits of one page the first gives url, title, type, phrases and score;
    what the shortlist has keeps its own url, title and type. Ties go to the smaller url.
    """
    fields = ("url", "title", "document_type", "phrases", "es_score")
    h = hits.groupBy("key").agg(F.min_by(F.struct(*fields), F.struct("first_hit", "url")).alias("h"))
    s = shortlist.groupBy("key").agg(F.min_by(F.struct("url", "title", "document_type", "matched"), "url").alias("s"))
    source = F.when(F.col("s").isNotNull() & F.col("h").isNotNull(), "both").when(F.col("h").isNull(), "shortlister").otherwise("search")
    own = lambda c: F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"h.{c}")).alias(c)
    return s.join(h, "key", "full_outer").select("key", own("url"), own("title"), own("document_type"), source.alias("source"), F.col("h.phrases").alias("phrases"), F.col("s.matched").alias("matched"), F.col("h.es_score").alias("es_score"))


def summary(compared: DataFrame, min_score: float = 0.0) -> DataFrame:
    """``source, n, mean_score`` of the rows over the floor, the three sources always."""
    found = compared.where(above_floor(min_score)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("es_score").alias("mean_score"))
    every = compared.sparkSession.createDataFrame([(x,) for x in ("both", "shortlister", "search")], "source string")
    return every.join(found, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), "mean_score")


def evaluable(compared: DataFrame, corpus: DataFrame, min_score: float = 0.0) -> DataFrame:
    """One row ``total, evaluable, pending_fetch`` over the floor: all rows, and the search-only ones that the corpus holds and does not hold."""
    held = corpus.select("url", F.lit(True).alias("held")).distinct()
    met = compared.where(above_floor(min_score)).join(held, "url", "left")
    own = lambda c: F.count(F.when((F.col("source") == "search") & c, 1))
    return met.agg(F.count(F.lit(1)).alias("total"), own(F.col("held").isNotNull()).alias("evaluable"), own(F.col("held").isNull()).alias("pending_fetch"))


def above_floor(min_score: float) -> Column:
    """The floor drops only search-only rows that have a score."""
    return ~((F.col("source") == "search") & F.coalesce(F.col("es_score") < min_score, F.lit(False)))


def augmented(compared: DataFrame, corpus: DataFrame, min_score: float, source: str | None = None, title: str = "", loaded: bool | None = None) -> DataFrame:
    """Rows over the floor with a flag for those that the corpus holds; of one source, with a text in the title (any case), or loaded or not, where asked."""
    held = corpus.select("url", F.lit(True).alias("held")).distinct()
    out = compared.where(above_floor(min_score)).join(held, "url", "left").withColumn("loaded", F.coalesce("held", F.lit(False))).drop("held")
    out = out if source is None else out.where(F.col("source") == source)
    out = out if not title.strip() else out.where(F.lower("title").contains(title.strip().lower()))
    return out if loaded is None else out.where(F.col("loaded") == loaded)


def source_rank() -> Column:
    """Order of a listing: search-only rows first, then both, then the shortlist's."""
    return F.when(F.col("source") == "search", 0).when(F.col("source") == "both", 1).otherwise(2)


def pending(compared: DataFrame, corpus: DataFrame) -> DataFrame:
    """Search-only urls that the corpus does not hold."""
    return compared.where("source = 'search'").select("url").join(corpus.select("url"), "url", "left_anti")


def resolve_containers(compared: DataFrame, attachments: DataFrame, corpus: DataFrame) -> DataFrame:
    """Replace search-only containers all of whose attachments the corpus holds by those attachments.

    ``attachments`` has ``container, attachment``; ``corpus`` has ``url, key``. An attachment whose
    page the shortlist has becomes both, and takes phrases and score of the container where it has
    none; one that no row has becomes a search row with them. Of several containers the first by
    url counts. A container without attachments stays.
    """
    some = compared.where("source = 'search'").select(F.col("url").alias("container"), "phrases", "es_score").join(attachments, "container")
    known = some.join(corpus.select(F.col("url").alias("attachment"), F.col("key").alias("held")).dropDuplicates(["attachment"]), "attachment", "left")
    whole = known.groupBy("container").agg(F.bool_and(F.col("held").isNotNull()).alias("whole")).where("whole").select("container")
    moved = known.join(whole, "container").groupBy(F.col("held").alias("key")).agg(F.min_by(F.struct("attachment", "phrases", "es_score"), F.struct("container", "attachment")).alias("m"))
    rest = compared.join(whole.withColumnRenamed("container", "url"), "url", "left_anti").select("key", "url", "source", "phrases", "es_score")
    met = rest.join(moved, "key", "full_outer")
    up, new = (F.col("source") == "shortlister") & F.col("m").isNotNull(), F.col("source").isNull()
    return met.select(
        "key", F.coalesce("url", "m.attachment").alias("url"), F.when(up, "both").when(new, "search").otherwise(F.col("source")).alias("source"),
        F.when(up | new, F.coalesce("phrases", "m.phrases")).otherwise(F.col("phrases")).alias("phrases"), F.when(up | new, F.coalesce("es_score", "m.es_score")).otherwise(F.col("es_score")).alias("es_score"),
    )
