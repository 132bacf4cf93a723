"""Review of verdict runs: scoring, stages, labels, outcomes and both phases side by side."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.bands import confidence
from corpusloom.functions.urls import canonical_url
from corpusloom.operators.runs import latest_exclusions, latest_runs, template_hash
from corpusloom.operators.workspace import entries


def run_notes(totals: DataFrame, asked: DataFrame) -> DataFrame:
    """``run_id, kind, note``: failed (over half unparsed), complete, or incomplete, with the sum that shows it."""
    met = totals.join(asked, "run_id")
    kind = F.when(F.col("unparsed") * 2 > F.col("pages"), "failed").when(F.col("pages") >= F.col("asked"), "complete").otherwise("incomplete")
    note = F.format_string("%d of %d: %d kept, %d dropped, %d unparsed", "pages", "asked", "kept", "dropped", "unparsed")
    return met.select("run_id", kind.alias("kind"), note.alias("note"))


def _phases(first: DataFrame, second: DataFrame) -> DataFrame:
    again = second.select("url", F.col("keep").alias("again"), F.lit(True).alias("seen"))
    return first.select("url", "keep", "score").join(again, "url", "left")


def end_to_end(first: DataFrame, second: DataFrame) -> DataFrame:
    """``url, keep`` of two phases: 1 if the first kept it and the second kept it or hasn't seen it, 0 if the second did anything else with it; else the first's verdict, null if unparsed."""
    keep = F.when(F.col("keep") == 1, F.when(F.col("seen"), F.coalesce(F.col("again") == 1, F.lit(False)).cast("int")).otherwise(1)).otherwise(F.col("keep"))
    return _phases(first, second).select("url", keep.alias("keep"))


def stage_rows(first: DataFrame, second: DataFrame, dept: DataFrame, doctype: DataFrame, keyword: DataFrame) -> DataFrame:
    """``url, stage``: each of the nine stages that a page is listed at.

    dept, doctype and keyword are the urls left by the filters. Of a chain's runs: reached_inclusion
    (scored at all), include (kept), excl_include (dropped), reached_exclusion (kept by the first),
    excl_final (dropped by the second), final (kept by the second, or by the first where the chain
    has no second run, that is if ``second`` is empty).
    """
    listed = lambda rows, stage: rows.select("url", F.lit(stage).alias("stage"))
    kept = first.where("keep = 1")
    parts = [
        listed(dept, "dept"), listed(doctype, "doctype"), listed(keyword, "keyword"), listed(first, "reached_inclusion"), listed(kept, "include"), listed(first.where("keep = 0"), "excl_include"), listed(kept, "reached_exclusion"),
        listed(second.where("keep = 0"), "excl_final"), listed(kept if second.isEmpty() else second.where("keep = 1"), "final"),
    ]
    return reduce(DataFrame.union, parts)


def left_at(keep: Column, seen: Column, again: Column) -> Column:
    """Where a page left a chain: p1_unparsed, p1_drop, kept (also if the second run has not seen it), p2_unparsed or p2_drop."""
    return F.when(keep.isNull(), "p1_unparsed").when(keep == 0, "p1_drop").when(seen.isNull(), "kept").when(again.isNull(), "p2_unparsed").when(again == 1, "kept").otherwise("p2_drop")


def stage_outcome(stage: Column) -> Column:
    """Whether a page that left a chain at ``stage`` is in its final list; null where a verdict is missing."""
    return F.when(stage == "kept", True).when(stage.isin("p1_drop", "p2_drop"), False)


def label_of_verdict(stage: Column, verdict: Column) -> Column:
    """The label that a judgement of a run stands for: correct, wrong or borderline, on a page that left at ``stage``.

    A correct keep and a wrong drop are in, the others out; null for other judgements, and for
    correct and wrong where the page has no outcome.
    """
    right = F.when(verdict == "correct", stage_outcome(stage)).when(verdict == "wrong", ~stage_outcome(stage))
    return F.when(verdict == "borderline", "borderline").when(right, "in").when(~right, "out")


def verdict_of_label(stage: Column, label: Column) -> Column:
    """The inverse: how a label reads against the page's outcome; null for an empty label or no outcome."""
    agrees = (label == "in") == stage_outcome(stage)
    return F.when(label == "borderline", "borderline").when(F.coalesce(label, F.lit("")) == "", None).when(agrees, "correct").when(~agrees, "wrong")


def run_pages(first: DataFrame, second: DataFrame, labels: DataFrame, votes: DataFrame) -> DataFrame:
    """Every page of a run with both verdicts, the stage it left at, its label and its votes as ``labeller=label`` text."""
    said = votes.groupBy("url").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "labeller", "label"))), ",").alias("votes"))
    return _phases(first, second).join(labels.select("url", "label"), "url", "left").join(said, "url", "left").select("url", "keep", "again", left_at(F.col("keep"), F.col("seen"), F.col("again")).alias("stage"), "label", "votes")


def enrich(results: DataFrame, pages: DataFrame, hits: DataFrame, second: DataFrame) -> DataFrame:
    """Results with keyword hits by page key, confidence, decision and the furthest phase."""
    keyed = results.join(pages.select("url", F.coalesce("content_id", "url").alias("content_id")), "url", "left").join(hits.select("content_id", "hits"), "content_id", "left")
    met = keyed.join(second.select("url", F.lit(True).alias("seen")), "url", "left")
    decision = F.when(F.col("keep") == 1, "keep").when(F.col("keep") == 0, "drop").otherwise("unparsed")
    return met.select("url", F.coalesce(F.array_join("hits", ","), F.lit("")).alias("hits"), confidence(F.col("score")).alias("confidence"), decision.alias("decision"), F.when(F.col("seen"), "exclusion").otherwise("inclusion").alias("furthest"))


def review_list(results: DataFrame, keep: int, shared_with: DataFrame) -> DataFrame:
    """A run's pages of one verdict that another run has too."""
    return results.where(F.col("keep") == keep).select("url", "score").join(shared_with.select("url"), "url", "left_semi")


def diff_cards(base: tuple[DataFrame, DataFrame], other: tuple[DataFrame, DataFrame], pages: DataFrame) -> DataFrame:
    """Pages whose combined verdict differs between two chains, with all four verdicts and the title."""
    b = _phases(*base).select("url", F.col("keep").alias("b_first"), F.col("again").alias("b_second")).join(end_to_end(*base).withColumnRenamed("keep", "b"), "url")
    o = _phases(*other).select("url", F.col("keep").alias("o_first"), F.col("again").alias("o_second")).join(end_to_end(*other).withColumnRenamed("keep", "o"), "url")
    return b.join(o, "url").where("NOT (b <=> o)").join(pages.select("url", "title"), "url", "left").select("url", "title", "b_first", "b_second", "o_first", "o_second")


# Bands of the smaller of two scores, as they are shown.
BANDS = ("0 (wrong sense)", "0.01–0.35 (in passing)", "0.36–0.65 (moderate)", "0.66–1 (major)")


def second_phase(base: tuple[DataFrame, DataFrame], other: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``url, band, input, b_drop, o_drop, b_final, o_final, same_first`` of the pages that both chains scored.

    ``input``: both first runs kept it; ``b_drop`` and ``o_drop``: a second run dropped it.
    """
    side = lambda chain, p: _phases(*chain).select("url", F.col("keep").alias(f"{p}_keep"), F.coalesce("score", F.lit(0.0)).alias(f"{p}_score"), F.coalesce(F.col("again") == 0, F.lit(False)).alias(f"{p}_drop"), (F.coalesce(F.col("keep") == 1, F.lit(False)) & (F.col("seen").isNull() | F.coalesce(F.col("again") == 1, F.lit(False)))).alias(f"{p}_final"))
    low = F.least("b_score", "o_score")
    band = F.when(low <= 0, BANDS[0]).when(low <= 0.35, BANDS[1]).when(low <= 0.65, BANDS[2]).otherwise(BANDS[3])
    return side(base, "b").join(side(other, "o"), "url").select("url", band.alias("band"), (F.coalesce(F.col("b_keep") == 1, F.lit(False)) & F.coalesce(F.col("o_keep") == 1, F.lit(False))).alias("input"), "b_drop", "o_drop", "b_final", "o_final", F.col("b_keep").eqNullSafe(F.col("o_keep")).alias("same_first"))


def second_phase_summary(pages: DataFrame) -> DataFrame:
    """One row of ``second_phase``: shared pages, input, drops of each chain, flips of the final, and which phase drove them."""
    n = lambda text: F.count(F.when(F.expr(text), 1))
    return pages.agg(F.count(F.lit(1)).alias("shared"), n("input").alias("excl_input"), n("input AND b_drop").alias("base_dropped"), n("input AND o_drop").alias("other_dropped"), n("b_final <> o_final").alias("flips"), n("b_final <> o_final AND same_first").alias("exclusion_driven"), n("b_final <> o_final AND NOT same_first").alias("inclusion_driven"))


def second_phase_bands(pages: DataFrame) -> DataFrame:
    """By band of ``second_phase``: input, kept by both, dropped by both and flipped of the input; pages and flips of all; every band."""
    n = lambda text: F.count(F.when(F.expr(text), 1))
    found = pages.groupBy("band").agg(n("input").alias("input"), n("input AND b_final AND o_final").alias("kept"), n("input AND NOT b_final AND NOT o_final").alias("dropped"), n("input AND b_final <> o_final").alias("flipped"), F.count(F.lit(1)).alias("pages"), n("b_final <> o_final").alias("all_flipped"))
    every = pages.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    return every.join(found, "band", "left").na.fill(0)


def latest_verdicts(runs: DataFrame, results: DataFrame) -> DataFrame:
    """``category_id, url, current_score, p1_keep, p1_reason, primary_topic, p2_keep`` of each category's newest inclusion run.

    ``p2_keep`` is that of the newest exclusion run built on it; null without one, or where that has
    not seen the page. Reason and topic are empty where they are missing. Runs of other ages play
    no part; ties go to the larger id.
    """
    first = latest_runs(runs.where("phase = 'inclusion'")).select("category_id", "run_id")
    second = latest_exclusions(runs).select(F.col("source_run_id").alias("run_id"), F.col("run_id").alias("second_id"))
    some = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = first.join(second, "run_id", "left").join(results.select("run_id", "url", "score", "keep", some("reason"), some("primary_topic")), "run_id")
    again = results.select(F.col("run_id").alias("second_id"), "url", F.col("keep").alias("p2_keep"))
    return rows.join(again, ["second_id", "url"], "left").select("category_id", "url", F.col("score").alias("current_score"), F.col("keep").alias("p1_keep"), F.col("reason").alias("p1_reason"), "primary_topic", "p2_keep")


def seed_labels(lists: DataFrame, domain: str = "example.org") -> DataFrame:
    """``url, label`` of expected and unexpected lists held as text; the unexpected list wins."""
    one = lambda c, label, rank: lists.select(F.explode(entries(F.col(c))).alias("raw")).select(canonical_url(F.col("raw"), domain).alias("url"), F.lit(label).alias("label"), F.lit(rank).alias("rank"))
    both = one("expected", "in", 0).union(one("unexpected", "out", 1)).where("url IS NOT NULL")
    return both.groupBy("url").agg(F.max_by("label", "rank").alias("label"))


def matched_keywords(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Keyword hits of each asked page by content id, else by url, as text."""
    by_id = hits.select(F.col("content_id").alias("key"), F.col("hits").alias("a"))
    by_url = hits.select("url", F.col("hits").alias("b"))
    return asked.join(by_id, "key", "left").join(by_url, "url", "left").select("url", F.array_join(F.coalesce("a", "b"), ",").alias("hits"))


def label_status(labels: DataFrame, sent: DataFrame) -> DataFrame:
    """By tag of the pages sent on (``url, tag, content_hash``): how many, unlabelled, borderline, and drifted from the hash they were labelled at; labels of pages not sent on as ``gone``."""
    own = labels.select("url", "label", F.col("content_hash_at_label").alias("then"), F.lit(True).alias("labelled"))
    met = sent.join(own, "url", "full_outer")
    n = lambda text: F.count(F.when(F.expr(text), 1))
    return met.groupBy(F.coalesce("tag", F.lit("gone")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), n("labelled IS NULL").alias("unlabelled"), n("label = 'borderline'").alias("borderline"), n("content_hash <> then").alias("drifted"))


def label_strata(labels: DataFrame, strata: list[str]) -> DataFrame:
    """``stratum, in, out, borderline, share_borderline`` of labels by the joined strata, a dash where one is missing or empty."""
    key = F.concat_ws(" / ", *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")) for c in strata])
    n = lambda x: F.count(F.when(F.col("label") == x, 1)).alias(x)
    return labels.groupBy(key.alias("stratum")).agg(n("in"), n("out"), n("borderline"), F.avg((F.col("label") == "borderline").cast("int")).alias("share_borderline"))


def run_list(runs: DataFrame) -> DataFrame:
    """A category's runs, newest first, with the settings of their stored JSON: variant (current where none is named), concurrency, sampling, number of scoped urls; null where that is missing or broken."""
    spec = F.from_json("spec", "prompt_variant string, concurrency int, sampling string, scope struct<urls: array<string>>")
    valid = F.try_parse_json("spec").isNotNull()
    return runs.withColumn("s", spec).orderBy(F.desc("started_at"), F.desc("run_id")).select("run_id", "started_at", F.when(valid, F.coalesce("s.prompt_variant", F.lit("current"))).alias("variant"), "s.concurrency", "s.sampling", F.size("s.scope.urls").alias("scope_size"))


def prompt_spec(runs: DataFrame, categories: DataFrame, templates: DataFrame, body_limit: int) -> DataFrame:
    """``run_id, spec``: all that a run's prompts depend on as one JSON text, empty where the category has none.

    ``runs`` has ``run_id, category_id, phase, prompt_variant, concurrency``; ``categories``
    ``category_id, name, inclusion, exclusion, keep_hints, drop_hints``; ``templates`` ``phase,
    prompt_variant, template, version``. The fingerprint is the template's. A missing variant is
    current, a missing name the topic.
    """
    t = templates.select(F.col("phase").alias("t_phase"), F.col("prompt_variant").alias("t_variant"), "template", "version")
    variant = F.coalesce("prompt_variant", F.lit("current"))
    met = runs.withColumn("variant", variant).join(categories, "category_id", "left").join(t, (F.col("phase") == F.col("t_phase")) & (F.col("variant") == F.col("t_variant")), "left")
    some = lambda c, other="": F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    spec = F.struct(
        some("template").alias("template"), some("version").alias("template_version"), template_hash(F.col("template")).alias("template_hash"), some("inclusion").alias("inclusion_context"), some("exclusion").alias("exclusion_context"),
        some("name", "the topic").alias("name"), some("keep_hints").alias("keep_hints"), some("drop_hints").alias("drop_hints"), F.lit(body_limit).alias("body_limit"), F.col("variant").alias("prompt_variant"), F.col("concurrency").alias("concurrency"),
    )
    return met.select("run_id", F.to_json(spec).alias("spec"))


def cost_efficiency(confusion: DataFrame, cost: float) -> DataFrame:
    """Cost for each right decision and for each page found; null where there are none."""
    per = lambda n: F.lit(cost) / F.nullif(n, F.lit(0))
    return confusion.select("bound", per(F.col("tp") + F.col("tn")).alias("per_correct"), per(F.col("tp")).alias("per_found"))


# Tokens that a reply of each phase takes, and the share of pages that the first phase keeps where no run tells.
REPLY_TOKENS, KEPT_SHARE = (220, 120), 0.75


def estimate(first: DataFrame, second: DataFrame, models: DataFrame, totals: DataFrame | None = None, repeats: int = 5, budget: float = 0.0, spent: float = 0.0) -> DataFrame:
    """What both phases would cost: a row for each pair of models, ``model, second_model, pages, kept_share, first_cost, second_cost, arm_total, total, fits``.

    ``first`` and ``second`` have the rendered prompts (``prompt``) of the same pages; ``models``
    is ``model, factor, input_rate, output_rate``: tens of rows, with rates for a million tokens and
    a factor on the usual four letters a token. The second phase reads the share of pages that
    ``totals`` (``pages, kept`` of the latest first phase, one row) kept. Costs are of one run; an
    arm's total is that of its first model with every second one, over ``repeats``; ``total`` sums the
    arms and ``fits`` if it is within what is left of the budget (0: no limit). No pages cost nothing.
    """
    letters = lambda df, name: df.agg(F.coalesce(F.sum(F.length("prompt")), F.lit(0)).alias(name), F.count(F.lit(1)).alias(f"{name}_pages"))
    share = F.lit(KEPT_SHARE) if totals is None else F.col("share")
    base = letters(first, "one").crossJoin(letters(second, "two"))  # one row each
    if totals is not None:
        base = base.crossJoin(totals.agg(F.coalesce(F.sum("kept") / F.nullif(F.sum("pages"), F.lit(0)), F.lit(KEPT_SHARE)).alias("share")))
    base = base.withColumn("kept_share", share)
    cost = lambda m, size, pages, reply, part: (F.col(size) / 4 * F.col(f"{m}.factor") * part * F.col(f"{m}.input_rate") + reply * F.col(pages) * part * F.col(f"{m}.output_rate")) / 1e6
    side = lambda m: models.select(F.struct("model", "factor", "input_rate", "output_rate").alias(m))
    pairs = side("a").crossJoin(F.broadcast(side("b"))).crossJoin(F.broadcast(base))  # tens of models
    made = pairs.select(F.col("a.model").alias("model"), F.col("b.model").alias("second_model"), F.col("one_pages").alias("pages"), "kept_share", cost("a", "one", "one_pages", REPLY_TOKENS[0], F.lit(1.0)).alias("first_cost"), cost("b", "two", "two_pages", REPLY_TOKENS[1], F.col("kept_share")).alias("second_cost"))
    arms = made.groupBy("model").agg(((F.first("first_cost") + F.sum("second_cost")) * repeats).alias("arm_total"))
    whole = arms.agg(F.sum("arm_total").alias("total"))
    fits = (F.lit(budget) <= 0) | (F.lit(spent) + F.col("total") <= budget)
    return made.join(arms, "model").crossJoin(F.broadcast(whole)).withColumn("fits", fits)


# Marks that count as the plain ones.
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


@F.pandas_udf(StringType())
def normal_text(text: pd.Series) -> pd.Series:
    """Compatibility forms, curly quotes and dashes made plain, runs of blanks one blank, lower case; null is empty."""
    table = str.maketrans(PLAIN)
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").translate(table).split()).lower(), na_action=None)


FIELDS = ("title", "description", "body")


def grounding_checks(rows: DataFrame) -> DataFrame:
    """``rows`` with seven checks, each true, false, or null where it does not apply.

    Columns: ``keep, score, evidence, where_hit`` (arrays), ``primary_topic, title, description,
    body`` (as it was sent), ``include_text, truncated``. G1_parsed: there is a verdict; without one
    only G7 applies further. G2_keep_matches_score: kept if and only if the score is over 0. Of kept
    pages: G3_evidence_verbatim, quotes exist and each is in a field; G4_where_valid, fields are
    named, all are real and each holds a quote. G5_topic_sane: one to ten words, and less than 0.6
    alike (Jaccard of words) to the first sentence of the criteria. G6_score_in_range: 0 to 1.
    G7_not_truncated.
    """
    texts = {f: F.col(f"n_{f}") for f in FIELDS}
    quotes = F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.trim(e) != "")
    named = F.coalesce("where_hit", F.array().cast("array<string>"))
    # Quotes are normalised as one text, parted by a mark that no text holds.
    made = rows.withColumns({"quotes": quotes, "named": named}).withColumns({f"n_{f}": normal_text(F.col(f)) for f in FIELDS} | {"n_quotes": normal_text(F.array_join("quotes", "\x00 "))})
    sent = F.transform(F.split("n_quotes", "\x00"), lambda q: F.trim(q))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1)))
    topic, first = normal_text(F.col("primary_topic")), normal_text(F.element_at(F.split(F.trim("include_text"), r"(?<=[.!?])\s"), 1))
    made = made.withColumns({"sent": sent, "topic": F.trim(F.coalesce("primary_topic", F.lit(""))), "tw": words(topic), "fw": words(first)})
    alike = F.size(F.array_intersect("tw", "fw")) / F.nullif(F.size(F.array_union("tw", "fw")), F.lit(0))
    parsed, kept = F.col("keep").isNotNull(), F.col("keep") == 1
    some = F.size("quotes") > 0
    holds = lambda text, q: (text != "") & text.contains(q)
    in_any = F.forall("sent", lambda q: holds(texts["title"], q) | holds(texts["description"], q) | holds(texts["body"], q))
    of_field = lambda w: F.when(w == "title", texts["title"]).when(w == "description", texts["description"]).otherwise(texts["body"])
    each = F.forall("named", lambda w: w.isin(*FIELDS) & F.coalesce(F.col("quotes")[0].isNotNull(), F.lit(False)) & F.exists("sent", lambda q: of_field(w).contains(q)))
    checks = {
        "G1_parsed": parsed,
        "G2_keep_matches_score": F.when(parsed, F.col("score").isNotNull() & (kept == (F.coalesce("score", F.lit(0.0)) > 0))),
        "G3_evidence_verbatim": F.when(parsed & kept, some & in_any),
        "G4_where_valid": F.when(parsed & kept, (F.size("named") > 0) & some & each),
        "G5_topic_sane": F.when(parsed, (F.col("topic") != "") & (F.size(F.split("topic", r"\s+")) <= 10) & ((F.size("tw") == 0) | (F.size("fw") == 0) | (alike < 0.6))),
        "G6_score_in_range": F.when(parsed, F.coalesce(F.col("score").between(0, 1), F.lit(False))),
        "G7_not_truncated": ~F.coalesce("truncated", F.lit(False)),
    }
    return made.select(*rows.columns, *[c.alias(k) for k, c in checks.items()])


CHECKS = ("G1_parsed", "G2_keep_matches_score", "G3_evidence_verbatim", "G4_where_valid", "G5_topic_sane", "G6_score_in_range", "G7_not_truncated")


def grounding(rows: DataFrame) -> DataFrame:
    """``check, n, passed, share`` of ``grounding_checks``: rows that each applies to, and how many pass; share is null without any."""
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("ok")) for name in CHECKS]))
    out = grounding_checks(rows).select(cells.alias("c")).groupBy("c.check").agg(F.count("c.ok").alias("n"), F.count(F.when(F.col("c.ok"), 1)).alias("passed"))
    return out.withColumn("share", F.when(F.col("n") > 0, F.col("passed") / F.col("n")))
