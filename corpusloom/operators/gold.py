"""Gold labels: sampling, votes, consensus and agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forwarded(shortlist: DataFrame, compared: DataFrame, min_score: float) -> DataFrame:
    """Pages that a fresh run would see, tagged both, shortlister, search or search_below_floor."""
    c = compared.select("url", "source", "es_score")
    low = (F.col("source") == "search") & F.coalesce(F.col("es_score") < min_score, F.lit(False))
    tag = F.when(low, "search_below_floor").otherwise(F.coalesce("source", F.lit("shortlister")))
    return shortlist.select("url").join(c, "url", "full_outer").select("url", tag.alias("tag"))


def seeded_rank(rows: DataFrame, strata: list[str], seed: str, target: int | None = None) -> DataFrame:
    """``rows`` with ``rn``, the rank by sha1(seed:url) within a stratum, and the stratum's ``size``.

    The hashes are dealt out by their first digits, so a stratum of any size is ranked in parts;
    the parts' sizes (a row for each stratum and part) give where each begins.
    """
    order = F.sha1(F.concat(F.lit(f"{seed}:"), "url"))
    keyed = rows.withColumns({"hash": order, "part": F.substring(order, 1, 3)})
    parts = keyed.groupBy(*strata, "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*strata)
    starts = parts.withColumn("begin", F.sum("n").over(own.orderBy("part")) - F.col("n")).withColumn("size", F.sum("n").over(own)).drop("n")
    keys = [*strata, "part"]
    met = keyed.join(starts.withColumnsRenamed({c: f"{c}_of" for c in keys}), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in keys)))
    inner = F.row_number().over(Window.partitionBy(*strata, "part").orderBy("hash", "url"))
    return met.withColumn("rn", F.col("begin") + inner).drop("hash", "part", "begin", *[f"{c}_of" for c in keys])


def stratified_order(rows: DataFrame, strata: list[str], seed: str) -> DataFrame:
    """``rows`` with ``rn, size, position``: round-robin over the strata, smallest first, in order of sha1(seed:url) within each.

    A row's position follows from its rank and the sizes of the strata, which are one small row, so
    nothing is sorted as a whole. Null strata are one stratum; ties of size go by the strata's values.
    """
    ranked = seeded_rank(rows, strata, seed)
    order = F.struct("size", *strata)
    sizes = ranked.select(order.alias("s")).distinct().agg(F.collect_list("s").alias("all"))
    # Those of each stratum that come before: of earlier rounds, and of this round the smaller strata.
    before = F.aggregate("all", F.lit(0).cast("long"), lambda n, s: n + F.least(s["size"], F.col("rn") - 1) + F.when((s["size"] >= F.col("rn")) & (s < order), 1).otherwise(0))
    return ranked.crossJoin(F.broadcast(sizes)).withColumn("position", before + 1).drop("all")


def sample(rows: DataFrame, stage: str, target: int, seed: str, full: int = 25) -> DataFrame:
    """The first ``target`` pages of each stage by seeded hash, or all if there are at most ``full``; with the sampled fraction."""
    ranked = seeded_rank(rows, [stage], seed)
    goal = F.when(F.col("size") <= full, F.col("size")).otherwise(F.least(F.lit(target), F.col("size")))
    return ranked.where(F.col("rn") <= goal).select("url", stage, "rn", (goal / F.col("size")).alias("fraction"))


def weight(fraction: Column) -> Column:
    """Inverse probability; 1 outside (0, 1]."""
    return F.when((fraction > 0) & (fraction <= 1), 1 / fraction).otherwise(1.0)


def latest_votes(votes: DataFrame) -> DataFrame:
    """The latest vote of each page and labeller; a null label withdraws it."""
    last = votes.groupBy("url", "labeller").agg(F.max_by("label", F.struct("labelled_at", "label")).alias("label"))
    return last.where("label IS NOT NULL")


#: Labels in the order in which ties go; fixed values.
LABELS = ("in", "out", "borderline")


def consensus(votes: DataFrame, adjudicated: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """``url, n_votes, label, agreement, rationale, labelled_by`` (and ``version``) of each page with votes or an adjudication.

    ``votes`` has ``url, labeller, label, rationale``. One vote is single; all alike unanimous; more
    than half majority; else split, which is borderline. The rationale is the single vote's, else
    ``labeller: label — rationale`` of all, by labeller. An adjudication (``url, label, rationale``)
    wins, with or without votes. With ``stored`` (``url, label, agreement, rationale, n_votes,
    version``) the version goes up by one where anything changed and begins at 1.
    """
    line = F.concat(F.col("labeller"), F.lit(": "), F.col("label"), F.lit(" — "), F.coalesce("rationale", F.lit("")))
    per = votes.groupBy("url").agg(
        F.count(F.lit(1)).alias("n_votes"), *[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in LABELS],
        F.array_sort(F.collect_list(F.struct("labeller", line.alias("line"), F.coalesce("rationale", F.lit("")).alias("own")))).alias("lines"),
    )
    most = F.greatest(*LABELS)
    top = F.when(F.col("in") == most, "in").when(F.col("out") == most, "out").otherwise("borderline")
    kind = F.when(F.col("n_votes") == 1, "single").when(most == F.col("n_votes"), "unanimous").when(most * 2 > F.col("n_votes"), "majority").otherwise("split")
    merged = F.when(F.col("n_votes") == 1, F.col("lines")[0]["own"]).otherwise(F.array_join(F.transform("lines", lambda v: v["line"]), " | "))
    people = F.array_join(F.array_distinct(F.transform("lines", lambda v: v["labeller"])), ", ")
    out = per.select("url", "n_votes", F.when(kind == "split", "borderline").otherwise(top).alias("label"), kind.alias("agreement"), merged.alias("rationale"), people.alias("labelled_by"))
    if adjudicated is not None:
        a = adjudicated.select("url", F.struct("label", "rationale").alias("a"))
        pick = lambda c: F.when(F.col("a").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(c)).alias(c)
        out = out.join(a, "url", "full_outer").select("url", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), pick("label"), F.when(F.col("a").isNotNull(), "adjudicated").otherwise(F.col("agreement")).alias("agreement"), pick("rationale"), F.coalesce("labelled_by", F.lit("")).alias("labelled_by"))
    if stored is None:
        return out
    fields = ("label", "agreement", "rationale", "n_votes")
    old = stored.select("url", F.struct(*fields).alias("old"), F.col("version").alias("v"))
    version = F.when(F.col("v").isNull(), 1).when(F.struct(*fields).eqNullSafe(F.col("old")), F.col("v")).otherwise(F.col("v") + 1)
    return out.join(old, "url", "left").select(*out.columns, version.cast("int").alias("version"))


def disagreements(votes: DataFrame) -> DataFrame:
    """``url, votes`` of pages with two votes or more that differ; votes as ``labeller=label`` text in order."""
    said = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "labeller", "label"))), ",")
    return votes.groupBy("url").agg(said.alias("votes"), F.countDistinct("label").alias("n")).where("n > 1").select("url", "votes")


def agreement_summary(votes: DataFrame) -> DataFrame:
    """One row: labellers, pages with a vote, with two or more, with one of every labeller, unanimous ones, Fleiss' kappa over the complete pages, blind votes.

    ``votes`` has ``url, labeller, label, blind``. Kappa is null without complete pages or with one labeller.
    """
    people = votes.agg(F.countDistinct("labeller").alias("labellers"), F.count(F.when(F.col("blind"), 1)).alias("blind_votes"))
    per = votes.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("kinds"), *[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in LABELS]).crossJoin(F.broadcast(people))
    whole = (F.col("n") == F.col("labellers")) & (F.col("labellers") >= 2)
    squares = sum((F.col(x) * F.col(x) for x in LABELS), F.lit(0))
    count = lambda c: F.count(F.when(c, 1))
    got = per.agg(
        F.first("labellers").alias("labellers"), F.count(F.lit(1)).alias("pages_voted"), count(F.col("n") >= 2).alias("pages_multi"), count(whole).alias("pages_complete"), count((F.col("n") >= 2) & (F.col("kinds") == 1)).alias("unanimous"), F.first("blind_votes").alias("blind_votes"),
        F.avg(F.when(whole, (squares - F.col("n")) / (F.col("n") * (F.col("n") - 1)))).alias("p"), *[F.avg(F.when(whole, F.col(x) / F.col("n"))).alias(f"p_{x}") for x in LABELS],
    )
    chance = sum((F.col(f"p_{x}") * F.col(f"p_{x}") for x in LABELS), F.lit(0.0))
    return got.select("labellers", "pages_voted", "pages_multi", "pages_complete", "unanimous", F.when(chance < 1, (F.col("p") - chance) / (1 - chance)).when(chance >= 1, 1.0).alias("fleiss_kappa"), "blind_votes")


def pair_agreement(votes: DataFrame) -> DataFrame:
    """Agreement and Cohen's kappa of each pair of labellers over the pages both labelled."""
    a = votes.select("url", F.col("labeller").alias("a"), F.col("label").alias("la"))
    b = votes.select("url", F.col("labeller").alias("b"), F.col("label").alias("lb"))
    cells = a.join(b, "url").where("a < b").groupBy("a", "b", "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    both = Window.partitionBy("a", "b")
    marked = cells.withColumn("total", F.sum("n").over(both)).withColumn("ra", F.sum("n").over(Window.partitionBy("a", "b", "la"))).withColumn("rb", F.sum("n").over(Window.partitionBy("a", "b", "lb")))
    same = F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0))
    rows = marked.groupBy("a", "b").agg(F.max("total").alias("n"), same.alias("same"))
    left = cells.groupBy("a", "b", F.col("la").alias("label")).agg(F.sum("n").alias("x"))
    right = cells.groupBy("a", "b", F.col("lb").alias("label")).agg(F.sum("n").alias("y"))
    chance = left.join(right, ["a", "b", "label"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    pe = F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    po = F.col("same") / F.col("n")
    return rows.join(chance, ["a", "b"], "left").select("a", "b", "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def sheet_errors(sheet: DataFrame, forwarded_urls: DataFrame, corpus: DataFrame) -> DataFrame:
    """``line, error`` of each fault of a labelled sheet (``line, url, label, rationale``).

    Empty url, duplicate url, not in the corpus, foreign (in the corpus but not sent on), bad
    label, missing rationale. Lines with an empty url are kept out of the shuffle.
    """
    own = sheet.withColumn("url", F.trim(F.coalesce("url", F.lit(""))))
    first = own.where("url <> ''").groupBy("url").agg(F.min("line").alias("first"))
    sent = forwarded_urls.select("url", F.lit(True).alias("sent")).distinct()
    held = corpus.select("url", F.lit(True).alias("held")).distinct()
    met = own.where("url <> ''").join(first, "url").join(sent, "url", "left").join(held, "url", "left").select("line", "label", "rationale", (F.col("line") > F.col("first")).alias("again"), "sent", "held")
    none = own.where("url = ''").select("line", "label", "rationale", F.lit(None).cast("boolean").alias("again"), F.lit(True).alias("sent"), F.lit(True).alias("held"))
    faults = F.array_compact(F.array(
        F.when(F.col("again").isNull(), "empty url"), F.when(F.col("again"), "duplicate url"), F.when(F.col("held").isNull(), "not in corpus"), F.when(F.col("held") & F.col("sent").isNull(), "not forwarded"),
        F.when(~F.coalesce("label", F.lit("")).isin("in", "out", "borderline"), "bad label"), F.when(F.coalesce(F.trim("rationale"), F.lit("")) == "", "missing rationale"),
    ))
    return met.union(none).select("line", F.explode(faults).alias("error"))


def sheet_drift(sheet: DataFrame, sheet_sha: str, labels: DataFrame, labels_sha: str) -> DataFrame:
    """``url, note``: pages whose label in the sheet differs from the stored one, where the sheet was made from other labels than are stored now."""
    met = sheet.select("url", F.col("label").alias("new")).join(labels.select("url", F.col("label").alias("old")), "url")
    return met.where(F.lit(sheet_sha != labels_sha) & ~F.col("new").eqNullSafe(F.col("old"))).select("url", F.concat_ws(" -> ", F.coalesce("old", F.lit("none")), F.coalesce("new", F.lit("none"))).alias("note"))


def gold_sha(labels: DataFrame) -> DataFrame:
    """One fingerprint of sorted ``url<tab>label`` lines. A gold set is made by hand and small."""
    lines = F.array_sort(F.collect_list(F.concat_ws("\t", "url", "label")))
    return labels.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("gold_sha"))
