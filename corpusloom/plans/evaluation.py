"""Queries over verdict runs, gold labels, metrics and cost, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import bands
from corpusloom.functions.numbers import rounded
from corpusloom.functions.replies import parse_decision, quotes
from corpusloom.operators import cost, filters, gold, metrics, reports, runs
from corpusloom.plans.corpus import _HITS, compared
from corpusloom.plans.roles import CONTENT, GOLD, LEDGER, VOTES, content, ledger, organisations, table, verdict_sql, verdicts, votes
from corpusloom.plans.roles import gold as gold_labels

BITMAP = ("0" * 8 + "1" * 10 + "0" * 6) * 5 + "0" * 48
_H = "(('0x' || substr(md5({}), 1, 8))::BIGINT)"


def a_(s, d):
    return verdicts(s, d, "a")


def b_(s, d):
    return verdicts(s, d, "b")


def short(s, d):
    return filters.shortlist(content(s, d), organisations(s, d), types=["guidance", "policy_paper"])


def repeats(s, d):
    """Three repeats; the last misses some pages."""
    return a_(s, d).union(b_(s, d)).union(verdicts(s, d, "c").where("doc_id % 10 <> 3"))


def second(s, d):
    """A second phase over what the first kept."""
    return b_(s, d).where("doc_id % 5 <> 2")


def detailed(s, d, run):
    """A run's verdicts with reasons, why the model stopped, and, of the first run, grounding."""
    k, first = F.col("doc_id"), run == "a"
    grounded = lambda c: F.when(F.lit(first) & (k % 5 != 0), c)
    return verdicts(s, d, run).withColumns({
        "reason": F.when(F.col("keep").isNotNull(), F.concat(F.lit(run), k % 7)).otherwise("unparseable model reply"), "stop_reason": F.element_at(F.array(*map(F.lit, ("max_tokens", "length", "end_turn", "stop"))), (k % 4 + 1).cast("int")),
        "primary_topic": grounded(F.concat(F.lit("t"), k % 5)), "where_hit": grounded(F.array(F.lit("title"), F.lit("body"))), "evidence": grounded(F.array(F.concat(F.lit("q"), k))),
    })


def run_table(s, d):
    """Runs with a source run each, made of customers."""
    k = F.col("c_custkey")
    start = F.date_format(F.date_add(F.to_date(F.lit("2026-01-01")), (k % 20).cast("int")), "yyyy-MM-dd")
    return table(s, d, "customer").select(
        k.alias("run_id"), (k % 7).alias("category_id"), F.when(k % 2 == 0, "inclusion").otherwise("exclusion").alias("phase"), F.concat(start, F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00")).alias("started_at"),
        F.when((k % 10 != 1) & (k > 10), F.floor(k / 10) * 10 + k % 10 - 1).alias("source_run_id"), F.when(k % 3 == 0, "running").otherwise("done").alias("status"), F.concat(start, F.lit(" 00:10:00")).alias("heartbeat"),
    )


def e_reusable_runs(s, d):
    k = F.col("run_id")
    fresh = run_table(s, d).withColumns({"status": F.when(k % 5 != 0, F.col("status")), "source_run_id": F.when(k % 4 != 0, F.col("source_run_id"))})
    return runs.reusable_runs(fresh, fresh.where(k % 3 == 0).select("run_id"))


def spent(s, d):
    """The priced calls as those of four runs, one of which has no results."""
    run = F.element_at(F.array(*map(F.lit, "abcz")), (F.col("event_id") % 4 + 1).cast("int"))
    return priced(s, d).select(run.alias("run_id"), "cost", (F.col("miss") + F.col("hit")).alias("in_tokens"), F.col("out").alias("out_tokens"), F.col("hit").alias("hit_tokens"), F.col("miss").alias("miss_tokens"))


def e_reconcile(s, d):
    return runs.reconcile(repeats(s, d), filters.membership(short(s, d)), compared(s, d).where("source = 'search'"), content(s, d), s.createDataFrame([("c",)], "run_id string"))


def voted(s, d):
    """Latest votes with rationales; some are blind."""
    return gold.latest_votes(votes(s, d)).withColumns({"rationale": F.when(F.col("labeller") != "b", F.concat(F.lit("why "), "labeller")), "blind": (F.col("labeller") == "a") & F.col("url").endswith("1")})


def g_consensus(s, d):
    k = F.col("doc_id")
    settled = gold_labels(s, d).where(k % 11 == 0).select("url", F.lit("out").alias("label"), F.lit("decided").alias("rationale"))
    stored = gold_labels(s, d).where(k % 3 == 0).select("url", F.lit("out").alias("label"), F.when(k % 11 == 0, "adjudicated").otherwise("single").alias("agreement"), F.lit("decided").alias("rationale"), F.lit(3).cast("long").alias("n_votes"), F.lit(4).alias("version"))
    return gold.consensus(voted(s, d), settled, stored)


TEMPLATE = "{{INCLUDE}} / {{EXCLUDE}} {{UNKNOWN}}<<<{{TITLE}} | {{DESCRIPTION}} | {{BODY}}"


def rendered(s, d, template=TEMPLATE, fields=runs.INCLUSION_FIELDS):
    k = F.col("doc_id")
    body = F.sha2(runs.truncate_body(F.col("search_text"), 300), 256)
    reason = F.when(k % 6 == 0, "it's").when(k % 6 == 1, 'say "x"').when(k % 6 == 2, "both ' and \"").when(k % 6 == 3, "two\nlines \\")
    values = {"pass1_reason": reason, "inclusion": F.when(k % 3 != 0, F.concat(F.lit("in "), k)), "exclusion": F.when(k % 2 == 0, "out"), "keep_hints": F.when(k % 4 == 0, "like this"), "title": F.when(k % 5 != 0, F.substring("title", 1, 10)).otherwise(""), "description": F.lit(None).cast("string"), "body": body}
    return content(s, d).select("doc_id", runs.render(template, fields, values).alias("prompt"))


def e_render_prompt(s, d):
    return rendered(s, d).select("doc_id", "prompt", *runs.split_prompt(F.col("prompt"), "<<<"))


def counted_runs(s, d):
    """Runs with counters as JSON, some without or broken."""
    k = F.col("c_custkey")
    json = F.format_string('{"new": %d, "error": %d, "gone": 1, "seen": 500, "changed": null}', k % 50, k % 7)
    day = F.date_format(F.date_add(F.to_date(F.lit("2026-01-01")), (k % 300).cast("int")), "yyyy-MM-dd")
    return table(s, d, "customer").select(
        k.alias("run_id"), F.lit("align").alias("stage"), F.when(k % 3 == 0, "running").otherwise("done").alias("status"), F.concat(day, F.lit("T10:00:00")).alias("started_at"), F.when(k % 3 != 0, F.concat(day, F.lit("T10:0"), k % 10, F.lit(":30.5"))).alias("finished_at"),
        F.when(k % 11 == 0, "{bad").when(k % 13 != 0, json).alias("counters"),
    )


def replies(s, d):
    """Raw replies around a decision: in prose, fenced, nested, or without any."""
    v, k = a_(s, d), F.col("doc_id")
    inner = F.format_string('{"keep": %s, "score": %s, "reason": "r {%d}", "primary_topic": " t%d ", "where": "title", "evidence": ["one {", "two"], "more": {"keep": null}}', F.coalesce(F.col("keep").cast("string"), F.lit("null")), F.col("score"), k % 3, k % 5)
    prose = F.concat(F.lit('Well {"a": 1} so {x} \n'), inner, F.lit('\nDone {"b": 2}.'))
    return v.select("url", F.when(k % 6 == 0, "no answer {").when(k % 6 == 1, F.concat(F.lit("```json\n"), inner, F.lit("\n```"))).when(k % 6 == 2, inner).when(k % 6 == 3, '{"score": "high"}').otherwise(prose).alias("reply"))


def e_parse_decision(s, d):
    return replies(s, d).select("url", parse_decision(F.col("reply")).alias("d")).select("url", "d.keep", "d.score", "d.reason", "d.primary_topic", F.array_join("d.where_hit", "|").alias("where_hit"), F.array_join("d.evidence", "|").alias("evidence"))


def usage_rows(s, d):
    """Payloads of both shapes, some without a split, without output, or broken."""
    k = F.col("event_id")
    payload = (
        F.when(k % 11 == 0, "{broken")
        .when(k % 7 == 0, F.format_string('{"input_tokens":%d,"cache_read_input_tokens":%d}', k % 1000, k % 300))
        .when(k % 6 == 0, F.format_string('{"prompt_tokens":%d,"completion_tokens":%d,"prompt_cache_hit_tokens":%d}', k % 1000, k % 70, k % 300))
        .when(k % 2 == 0, F.format_string('{"prompt_tokens":%d,"completion_tokens":%d,"prompt_cache_hit_tokens":%d,"prompt_cache_miss_tokens":%d}', k % 1000 + k % 300, k % 70, k % 300, k % 1000))
        .when(k % 3 == 0, F.format_string('{"input_tokens":%d,"output_tokens":%d}', k % 1000, k % 70))
        .otherwise(F.format_string('{"input_tokens":%d,"output_tokens":%d,"cache_read_input_tokens":%d,"cache_creation_input_tokens":%d}', k % 1000, k % 70, k % 300, k % 40))
    )
    return table(s, d, "events").select("event_id", payload.alias("payload"))


def paid_runs(s, d):
    """The priced calls as runs: one for each user and phase; some lost their tokens."""
    k = F.col("user_id")
    sums = [F.sum(c).alias(c) for c in ("cost", "miss", "hit", "out")]
    rows = priced(s, d).join(table(s, d, "events").select("event_id", "user_id"), "event_id").groupBy("user_id", "model", "phase").agg(*sums)
    lost = lambda c: F.when(k % 9 != 0, c)
    return rows.select(
        F.concat_ws(":", "user_id", "phase").alias("run_id"), F.when(k % 4 != 0, F.concat(F.lit("p"), k % 3)).alias("provider"), "model", "phase", "cost",
        lost(F.col("miss") + F.col("hit")).alias("total"), lost(F.col("hit")).alias("hit"), lost(F.col("miss")).alias("miss"), lost(F.col("out")).alias("out"), (k % 50).alias("pages"), (k % 10).alias("kept"),
    )


def priced(s, d):
    grid = s.createDataFrame([("small", 0.003, 0.006, 0.15, 0.30, 0.60, 1.20), ("large", None, None, 0.5, 1.0, 2.0, 4.0)], "model string, in_hit_off double, in_hit_peak double, in_miss_off double, in_miss_peak double, out_off double, out_peak double")
    return cost.call_cost(ledger(s, d).withColumn("peak", cost.is_peak(F.col("ts"), BITMAP)), grid)


def sheet(s, d):
    k = F.col("doc_id")
    label = F.when(k % 7 == 0, "maybe").when(k % 2 == 0, "in").otherwise("out")
    url = F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("https://www.example.org/d/"), F.floor(k / 2) * 2))
    return table(s, d, "documents").select(k.alias("line"), url.alias("url"), label.alias("label"), F.when(k % 5 != 0, "because").otherwise(" ").alias("rationale"))


def _run_log(s, d):
    return table(s, d, "events").select((F.col("user_id") % 10).alias("run_id"), "ts", F.col("event_type").alias("action"))


def e_candidates(s, d):
    found = filters.membership(short(s, d))
    search = compared(s, d).where("source = 'search'").select("url", "es_score")
    return runs.candidates(found, a_(s, d).where("keep = 1"), search, 0.3, 400)


def g_agreement(s, d):
    out = gold.pair_agreement(gold.latest_votes(votes(s, d)))
    return out.select("a", "b", "n", rounded("agreement", 9).alias("agreement"), rounded("kappa", 9).alias("kappa"))


def _rounded(df, *names):
    return df.withColumns({n: rounded(n, 9) for n in names})


def _footprints(df):
    """Sums of money to so many places as their order of adding leaves alone, all else to nine."""
    return df.withColumns({c: rounded(c, 6 if "cost" in c else 9) for c, kind in df.dtypes if kind == "double"})


QUERIES = {
    "e_candidates": e_candidates,
    "e_scoped_candidates": lambda s, d: runs.scoped_candidates(b_(s, d).where("keep = 1"), content(s, d).where(filters.is_usable()), a_(s, d).where("keep = 0")),
    "e_exclusion_candidates": lambda s, d: runs.exclusion_candidates(detailed(s, d, "a"), second(s, d), 60),
    "e_truncate_body": lambda s, d: table(s, d, "documents").select("doc_id", runs.truncate_body(F.col("text"), 100).alias("body")),
    "e_render_prompt": e_render_prompt,
    "e_render_legacy": lambda s, d: rendered(s, d, "{{TITLE_LINE}}{{SPEC}}{{KEEP_SECTION}}{{DROP_SECTION}}{{PASS1_TOPIC}} {{PASS1_REASON}}", runs.EXCLUSION_FIELDS),
    "e_template_hash": lambda s, d: table(s, d, "documents").select("doc_id", runs.template_hash(F.col("text")).alias("fingerprint")),
    "e_parse_decision": e_parse_decision,
    "e_confidence": lambda s, d: a_(s, d).select("url", bands.confidence(F.col("score")).alias("confidence"), bands.score_band(F.col("score")).alias("band"), bands.score_bucket(F.col("score")).alias("bucket"), bands.zone(bands.score_bucket(F.col("score"))).alias("zone")),
    "e_run_totals": lambda s, d: runs.run_totals(repeats(s, d), spent(s, d)).withColumn("cost", rounded("cost", 6)),
    "e_latest_runs": lambda s, d: runs.latest_runs(run_table(s, d)),
    "e_latest_exclusions": lambda s, d: runs.latest_exclusions(run_table(s, d).withColumn("source_run_id", F.floor(F.col("source_run_id") / 5) * 5)),
    "e_reusable_runs": e_reusable_runs,
    "e_run_name": lambda s, d: runs.run_names(run_table(s, d)),
    "e_run_chain": lambda s, d: runs.run_roots(run_table(s, d)),
    "e_kept_count": lambda s, d: a_(s, d).where("keep = 1").agg(F.count(F.lit(1)).alias("n")),
    "e_results": lambda s, d: runs.results_with_source(detailed(s, d, "b"), detailed(s, d, "a")).withColumns({c: F.array_join(c, "|") for c in ("where_hit", "evidence")}),
    "e_failures": lambda s, d: runs.unparsed(detailed(s, d, "a").unionByName(detailed(s, d, "b"))),
    "e_truncated": lambda s, d: runs.truncated(detailed(s, d, "a").unionByName(detailed(s, d, "b"))),
    "e_reconcile": e_reconcile,
    "e_recounted": lambda s, d: runs.recounted(s.createDataFrame([(x,) for x in "abcz"], "run_id string"), e_reconcile(s, d)),
    "e_stalled": lambda s, d: runs.stalled(run_table(s, d), "2026-01-12 00:14:00"),
    "e_compare_runs": lambda s, d: runs.compare_runs(a_(s, d), b_(s, d)),
    "e_disagreements": lambda s, d: runs.disagreements(a_(s, d), b_(s, d)),
    "e_final_keep": lambda s, d: runs.final_keep(a_(s, d), second(s, d)),
    "e_final_diffs": lambda s, d: runs.final_diffs(runs.final_keep(a_(s, d), second(s, d)), runs.final_keep(b_(s, d), verdicts(s, d, "c"))),
    "e_quotes": lambda s, d: replies(s, d).select("url", F.array_join(quotes(F.concat("reply", F.lit(" ‘Zwölf Uhr’ page's “ok.” '7' '12' 'KEEP' it's"))), "|").alias("quotes")),
    "n_phase1": lambda s, d: runs.phase_compare(a_(s, d).where("doc_id % 9 <> 0"), b_(s, d).where("doc_id % 8 <> 0")),
    "n_overall": lambda s, d: _rounded(runs.overall_compare((a_(s, d), second(s, d)), (b_(s, d), verdicts(s, d, "c"))), "agreement", "mean_delta"),
    "n_discriminability": lambda s, d: _rounded(runs.discriminability(a_(s, d)), "borderline_pct", "top_score", "top_share"),
    "n_score_histogram": lambda s, d: runs.histogram(a_(s, d)),
    "g_weight": lambda s, d: table(s, d, "customer").select("c_custkey", rounded(gold.weight(F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 7 / 5)), 9).alias("weight")),
    "g_forwarded": lambda s, d: gold.forwarded(filters.membership(short(s, d)), compared(s, d), 0.3),
    "g_stratified_order": lambda s, d: gold.stratified_order(gold_labels(s, d), ["label"], "s1").select("url", "position"),
    "g_sample": lambda s, d: gold.sample(gold_labels(s, d), "label", 40, "s1").select("url", "label", "rn", rounded("fraction", 9).alias("fraction"), rounded(gold.weight(F.col("fraction")), 9).alias("weight")),
    "g_votes": lambda s, d: gold.latest_votes(votes(s, d)),
    "g_consensus": g_consensus,
    "g_disagreements": lambda s, d: gold.disagreements(voted(s, d)),
    "g_agreement_summary": lambda s, d: _rounded(gold.agreement_summary(voted(s, d)), "fleiss_kappa"),
    "g_agreement": g_agreement,
    "g_validate_sheet": lambda s, d: gold.sheet_errors(sheet(s, d), filters.membership(short(s, d)), content(s, d).where("doc_id % 4 <> 0")),
    "g_gold_sha": lambda s, d: gold.gold_sha(gold_labels(s, d)),
    "m_confusion": lambda s, d: metrics.confusion(gold_labels(s, d), a_(s, d).where("doc_id % 11 <> 0")),
    "m_rates": lambda s, d: _rounded(metrics.rates(metrics.confusion(gold_labels(s, d), a_(s, d))).drop("tp", "fp", "fn", "tn", "n", "unparsed"), "precision", "recall", "specificity", "accuracy", "f1"),
    "m_rates_by_repeat": lambda s, d: _rounded(metrics.rates_by_repeat(gold_labels(s, d), repeats(s, d)), "precision", "recall", "specificity", "accuracy", "f1"),
    "m_borderline": lambda s, d: _rounded(metrics.borderline_kept(gold_labels(s, d), a_(s, d)), "kept_share"),
    "m_value_add": lambda s, d: _rounded(metrics.value_add(gold_labels(s, d), a_(s, d), b_(s, d)), "drop_precision", "lost_share"),
    "m_stability": lambda s, d: _rounded(metrics.stability(repeats(s, d), 3), "unanimous"),
    "m_fleiss": lambda s, d: _rounded(metrics.fleiss_kappa(repeats(s, d).where("doc_id % 10 <> 3")), "kappa"),
    "m_majority": lambda s, d: metrics.majority(repeats(s, d)),
    "m_score_stability": lambda s, d: _rounded(metrics.score_stability(repeats(s, d), bands.score_band(F.col("score"))), "mean_sd", "unstable", "one_band"),
    "m_calibration": lambda s, d: _rounded(metrics.calibration(gold_labels(s, d), a_(s, d).where("doc_id % 9 <> 0"), bands.score_band(F.col("score")), bands.BAND_ORDER), "share_in", "brier"),
    "m_mcnemar": lambda s, d: _rounded(metrics.mcnemar(gold_labels(s, d), a_(s, d), b_(s, d)), "p"),
    "m_kappa": lambda s, d: _rounded(metrics.cohen_kappa(a_(s, d), b_(s, d)), "po", "kappa", "h"),
    "m_percentile": lambda s, d: _rounded(metrics.latency(repeats(s, d)), "p50", "p90"),
    "m_bootstrap": lambda s, d: _rounded(metrics.bootstrap(gold_labels(s, d), a_(s, d)), "point", "low", "high"),
    "m_bootstrap_difference": lambda s, d: _rounded(metrics.bootstrap(gold_labels(s, d), a_(s, d), b_(s, d), "f1", bound="in"), "point", "low", "high"),
    "k_usage_norm": lambda s, d: usage_rows(s, d).select("event_id", *cost.usage(F.col("payload"))),
    "k_peak": lambda s, d: table(s, d, "events").select("event_id", cost.is_peak(F.col("ts"), BITMAP).alias("peak")),
    "k_call_cost": lambda s, d: priced(s, d).select("event_id", rounded("cost", 9).alias("cost")),
    "k_footprint": lambda s, d: _rounded(cost.footprint(ledger(s, d).withColumn("total", F.col("miss") + F.col("hit"))), "amount"),
    "k_footprint_summary": lambda s, d: _footprints(cost.footprint_summary(paid_runs(s, d))),
    "k_equivalents": lambda s, d: _rounded(cost.equivalents(cost.footprint(ledger(s, d).withColumn("total", F.col("miss") + F.col("hit")))), "amount"),
    "k_data_issues": lambda s, d: cost.data_issues(paid_runs(s, d)).select("run_id", rounded("cost", 6).alias("cost")),
    "a_spend_by_phase": lambda s, d: _rounded(reports.spend_by_phase(priced(s, d)), "spend"),
    "a_spend_by_day": lambda s, d: reports.spend_by_day(priced(s, d)).select("day", rounded("spend", 6).alias("spend"), rounded("running", 6).alias("running")),
    "a_run_health": lambda s, d: _rounded(reports.run_health(counted_runs(s, d), 40), "success_rate"),
    "a_runs_active": lambda s, d: reports.running(counted_runs(s, d)),
    "a_fetch_log": lambda s, d: reports.fetch_counters(_run_log(s, d), ["click", "error", "purchase", "view"]),
}

_A, _B, _C = (verdict_sql(f"v{x}", x) for x in "abc")
_REP = f"{_A}, {_B}, {_C}, rep AS (SELECT * FROM va UNION ALL SELECT * FROM vb UNION ALL SELECT * FROM vc WHERE doc_id % 10 <> 3)"
_SHORT = "short AS (SELECT * FROM typed WHERE usable AND eff IN ('guidance', 'policy_paper')), mem AS (SELECT key AS content_id, min(url) AS url FROM short GROUP BY key)"
_RUNS = """runs AS (SELECT c_custkey AS run_id, c_custkey % 7 AS category_id, CASE WHEN c_custkey % 2 = 0 THEN 'inclusion' ELSE 'exclusion' END AS phase,
  strftime(DATE '2026-01-01' + CAST(c_custkey % 20 AS INTEGER), '%Y-%m-%d') AS day, day || 'T' || lpad((c_custkey % 24)::VARCHAR, 2, '0') || ':00:00' AS started_at,
  CASE WHEN c_custkey % 10 <> 1 AND c_custkey > 10 THEN c_custkey // 10 * 10 + c_custkey % 10 - 1 END AS source_run_id, CASE WHEN c_custkey % 3 = 0 THEN 'running' ELSE 'done' END AS status FROM customer)"""
_BUCKET = "CASE WHEN coalesce(score, 0) <= 0 THEN 0 WHEN score <= 0.12 THEN 1 WHEN score <= 0.23 THEN 2 WHEN score <= 0.35 THEN 3 WHEN score <= 0.65 THEN 4 ELSE 5 END"
_ZONE = "CASE WHEN {b} = 0 THEN 'drop' WHEN {b} <= 3 THEN 'borderline' ELSE 'confident' END"
_CONF = "CASE WHEN score IS NULL THEN '' WHEN score <= 0 THEN 'Wrong sense' WHEN score <= 0.35 THEN 'Mentioned in passing' WHEN score <= 0.65 THEN 'Discussed a moderate amount' ELSE 'Major focus' END"
_BAND = "CASE WHEN score IS NULL THEN 'unscored' WHEN score <= 0 THEN '0' WHEN score <= 0.35 THEN '0.1-0.3' WHEN score <= 0.65 THEN '0.4-0.6' ELSE '0.7-1.0' END"
_REASON = "CASE WHEN {v}.keep IS NULL THEN 'unparseable model reply' ELSE '{r}' || {v}.doc_id % 7 END"
_CELLS = """cells AS (SELECT bound, keep, CASE WHEN label = 'borderline' THEN CASE bound WHEN 'in' THEN true WHEN 'out' THEN false END ELSE label = 'in' END AS truth, coalesce(keep = 1, false) AS kept
  FROM gold g LEFT JOIN {v} v USING (url), unnest(['exclude', 'in', 'out']) t(bound)),
conf AS (SELECT bound, count(*) FILTER (truth AND kept) AS tp, count(*) FILTER (NOT truth AND kept) AS fp, count(*) FILTER (truth AND NOT kept) AS fn, count(*) FILTER (NOT truth AND NOT kept) AS tn, count(*) AS n, count(*) FILTER (keep IS NULL) AS unparsed FROM cells WHERE truth IS NOT NULL GROUP BY bound)"""
_PEAK = f"substr('{BITMAP}', (isodow(ts) - 1) * 24 + hour(ts) + 1, 1) = '1'"
_PRICED = f"""{LEDGER}, priced AS (SELECT *, {_PEAK} AS peak, CASE WHEN model = 'small' THEN CASE WHEN {_PEAK} THEN miss * 0.30::DOUBLE + hit * 0.006::DOUBLE + out * 1.20::DOUBLE ELSE miss * 0.15::DOUBLE + hit * 0.003::DOUBLE + out * 0.60::DOUBLE END
  ELSE CASE WHEN {_PEAK} THEN (miss + hit) * 1.0::DOUBLE + out * 4.0::DOUBLE ELSE (miss + hit) * 0.5::DOUBLE + out * 2.0::DOUBLE END END / 1e6 AS cost FROM ledger)"""
_PAID = f"""{_PRICED}, per AS (SELECT user_id AS k, p.model, p.phase, sum(cost) AS cost, sum(miss) AS miss, sum(hit) AS hit, sum(out) AS o FROM priced p JOIN events USING (event_id) GROUP BY ALL),
paid AS (SELECT k || ':' || phase AS run_id, CASE WHEN k % 4 <> 0 THEN 'p' || k % 3 ELSE '?' END AS provider, model, phase, cost, CASE WHEN k % 9 <> 0 THEN miss + hit END AS total, CASE WHEN k % 9 <> 0 THEN hit END AS hit, CASE WHEN k % 9 <> 0 THEN miss END AS miss, CASE WHEN k % 9 <> 0 THEN o END AS o, k % 50 AS pages, k % 10 AS kept FROM per)"""
_FINAL = "{n} AS (SELECT i.url, coalesce(i.keep = 1, false) AND (e.url IS NULL OR coalesce(e.keep = 1, false)) AS final FROM {i} i LEFT JOIN {e} e ON e.url = i.url)"
_SECOND = "second AS (SELECT * FROM vb WHERE doc_id % 5 <> 2)"
_AB = "ab AS (SELECT url, a.keep AS ak, b.keep AS bk, a.score AS sa, b.score AS sb FROM va a JOIN vb b USING (url))"
_REPLY = f"{_A}, r AS (SELECT * FROM va)"



def _boot(n: int, bound: str = "exclude", other: str = "va") -> str:
    """Counts of the eight cells, drawn for each resample cell by cell; chances by the log gamma function."""
    cells = metrics.CELLS
    parts = [f"""{GOLD}, {_A}, {_B}, g AS (SELECT CASE WHEN label = 'borderline' THEN CASE '{bound}' WHEN 'in' THEN 1 WHEN 'out' THEN 0 END ELSE (label = 'in')::INT END AS t, coalesce(a.keep = 1, false)::INT AS a, coalesce(b.keep = 1, false)::INT AS b FROM gold LEFT JOIN va a USING (url) LEFT JOIN {other} b USING (url)),
  n AS (SELECT {", ".join(f"count(*) FILTER (t = {t} AND a = {a} AND b = {b}) AS n{i}" for i, (t, a, b) in enumerate(cells))}, count(t) AS l FROM g),
  s0 AS (SELECT rep, n.*, l AS o FROM n, range(0, {n} + 1) r(rep))"""]
    for i in range(8):
        u = f"('0x' || substr(md5('{metrics.SEED}:' || rep || ':{i}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
        parts.append(f"""q{i} AS (SELECT rep, l, n{i}::DOUBLE / nullif(o, 0) AS p, {u} AS u, greatest(0, floor(l * p - 8 * sqrt(l * p * (1 - p)) - 8))::BIGINT AS lo, least(l, ceil(l * p + 8 * sqrt(l * p * (1 - p)) + 8))::BIGINT AS hi FROM s{i} WHERE rep > 0 AND l > 0 AND n{i} > 0 AND n{i} < o),
  x{i} AS (SELECT rep, u, lo, sum(exp(lgamma(l + 1) - lgamma(k + 1) - lgamma(l - k + 1) + k * ln(p) + (l - k) * ln(1 - p))) OVER (PARTITION BY rep ORDER BY k) AS f FROM (SELECT *, unnest(range(lo, hi)) AS k FROM q{i})),
  y{i} AS (SELECT rep, any_value(lo) + count(*) FILTER (f <= u) AS k FROM x{i} GROUP BY rep),
  s{i + 1} AS (SELECT s.* EXCLUDE (l, o), CASE WHEN rep = 0 THEN n{i} WHEN n{i} = 0 OR l <= 0 THEN 0 WHEN n{i} >= o THEN l ELSE coalesce(y.k, 0) END AS c{i}, l - c{i} AS l, o - n{i} AS o FROM s{i} s LEFT JOIN y{i} y USING (rep))""")
    cell = lambda t, side, k: " + ".join(f"c{i}" for i, c in enumerate(cells) if c[0] == t and c[1 + side] == k)
    f1 = lambda side: f"2 * ({cell(1, side, 1)}) / nullif(2 * ({cell(1, side, 1)}) + {cell(0, side, 1)} + {cell(1, side, 0)}, 0)"
    return ", ".join(parts) + f", m AS (SELECT rep, ({cell(1, 0, 1)}) / nullif({cell(1, 0, 1)} + {cell(1, 0, 0)}, 0) AS ra, {f1(0)} AS fa, {f1(1)} AS fb FROM s8)"


ORACLE_SQL = {
    "e_candidates": f"WITH {_HITS}, {_SHORT}, {_A}, c AS (SELECT url, 0 AS rank, 0.0 AS sc FROM mem UNION ALL SELECT url, 1, coalesce(es_score, 0) FROM cmp WHERE source = 'search' AND coalesce(es_score >= 0.3, true)) SELECT url, rank FROM c WHERE url NOT IN (SELECT url FROM va WHERE keep = 1) ORDER BY rank, sc DESC, url LIMIT 400",
    "e_scoped_candidates": f"WITH {CONTENT}, {_A}, {_B} SELECT url FROM typed WHERE usable AND url IN (SELECT url FROM vb WHERE keep = 1) AND url NOT IN (SELECT url FROM va WHERE keep = 0)",
    "e_exclusion_candidates": f"WITH {_A}, {_B}, {_SECOND} SELECT url, 'a' || doc_id % 7 AS pass1_reason, CASE WHEN doc_id % 5 <> 0 THEN 't' || doc_id % 5 END AS pass1_topic FROM va WHERE keep = 1 AND url NOT IN (SELECT url FROM second) ORDER BY url LIMIT 60",
    "e_truncate_body": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 66) || ' … ' || right(text, 34) ELSE text END AS body FROM documents",
    "e_render_prompt": f"WITH {CONTENT}, p AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'in ' || doc_id ELSE '(not specified)' END || ' / ' || CASE WHEN doc_id % 2 = 0 THEN 'out' ELSE '(none given)' END || ' {{{{UNKNOWN}}}}' AS stable, CASE WHEN doc_id % 5 <> 0 AND substr(title, 1, 10) <> '' THEN substr(title, 1, 10) ELSE '(none)' END || ' | (none) | ' || sha256(CASE WHEN length(search_text) > 300 THEN substr(search_text, 1, 200) || ' … ' || right(search_text, 100) ELSE search_text END) AS variable FROM typed) SELECT doc_id, stable || '<<<' || variable AS prompt, stable, variable FROM p",
    "e_render_legacy": f"""WITH {CONTENT} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND substr(title, 1, 10) <> '' THEN 'Page title: ' || substr(title, 1, 10) || chr(10) ELSE '' END || 'Inclusion criteria:' || chr(10) || CASE WHEN doc_id % 3 <> 0 THEN 'in ' || doc_id ELSE '(not specified)' END || chr(10) || chr(10) || 'Exclusion criteria:' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'out' ELSE '(none given)' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'KEEP examples (keep = true) — lean toward keeping when similar content appears:' || chr(10) || 'like this' || chr(10) ELSE '' END || '(not given) ' || CASE doc_id % 6 WHEN 0 THEN '"it''s"' WHEN 1 THEN '''say "x"''' WHEN 2 THEN '''both \\'' and "''' WHEN 3 THEN '''two\\nlines \\\\''' ELSE '''''' END AS prompt FROM typed""",
    "e_template_hash": "SELECT doc_id, substr(sha256(text), 1, 8) AS fingerprint FROM documents",
    "e_parse_decision": f"WITH {_REPLY}, x AS (SELECT *, doc_id % 6 AS m, doc_id % 6 NOT IN (0, 3) AS ok FROM r) SELECT url, CASE WHEN ok THEN keep END AS keep, CASE WHEN ok THEN score END AS score, CASE WHEN ok THEN 'r {{' || doc_id % 3 || '}}' WHEN m = 3 THEN '' END AS reason, CASE WHEN ok THEN 't' || doc_id % 5 END AS primary_topic, CASE WHEN ok THEN 'title' END AS where_hit, CASE WHEN ok THEN 'one {{|two' END AS evidence FROM x",
    "e_confidence": f"WITH {_A} SELECT url, {_CONF} AS confidence, {_BAND} AS band, {_BUCKET} AS bucket, {_ZONE.format(b=_BUCKET)} AS zone FROM va",
    "e_run_totals": f"WITH {_REP}, {_PRICED}, u AS (SELECT ['a', 'b', 'c', 'z'][event_id % 4 + 1] AS run_id, sum(cost) AS cost, sum(miss + hit) AS i, sum(out) AS o, sum(hit) AS h, sum(miss) AS m FROM priced GROUP BY 1), t AS (SELECT run_id, count(*) AS pages, count(*) FILTER (keep = 1) AS kept, count(*) FILTER (keep = 0) AS dropped, count(*) FILTER (keep IS NULL) AS unparsed, CAST(sum(ms) AS BIGINT) AS total_ms FROM rep GROUP BY run_id) "
    "SELECT t.*, round(cost, 6) AS cost, i::BIGINT AS in_tokens, o::BIGINT AS out_tokens, h::BIGINT AS hit_tokens, m::BIGINT AS miss_tokens FROM t JOIN u USING (run_id)",
    "e_latest_runs": f"WITH {_RUNS} SELECT category_id, phase, run_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id, phase ORDER BY started_at DESC, run_id DESC) AS n FROM runs) WHERE n = 1",
    "e_latest_exclusions": f"WITH {_RUNS}, e AS (SELECT source_run_id // 5 * 5 AS source_run_id, run_id, started_at FROM runs WHERE phase = 'exclusion' AND source_run_id IS NOT NULL) SELECT source_run_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY source_run_id ORDER BY started_at DESC, run_id DESC) AS n FROM e) WHERE n = 1",
    "e_reusable_runs": f"WITH {_RUNS} SELECT category_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY started_at DESC, run_id DESC) AS n FROM runs WHERE phase = 'inclusion' AND (source_run_id IS NULL OR run_id % 4 = 0) AND run_id % 5 = 0 AND run_id % 3 <> 0) WHERE n = 1",
    "e_run_name": f"WITH {_RUNS} SELECT run_id, 'Run ' || substr(day, 3) || ' - ' || (1 + coalesce(sum((source_run_id IS NULL)::INT) OVER (PARTITION BY category_id, day ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS name FROM runs",
    "e_run_chain": f"WITH RECURSIVE {_RUNS}, w AS (SELECT run_id, run_id AS root, 0 AS depth FROM runs UNION ALL SELECT w.run_id, r.source_run_id, depth + 1 FROM w JOIN runs r ON r.run_id = w.root WHERE r.source_run_id IS NOT NULL AND depth < 25) SELECT run_id, arg_max(root, depth) AS root, max(depth) AS depth FROM w GROUP BY run_id",
    "e_kept_count": f"WITH {_A} SELECT count(*) AS n FROM va WHERE keep = 1",
    "e_results": f"WITH {_A}, {_B} SELECT b.url, b.keep, b.score, {_REASON.format(v='b', r='b')} AS reason, {_REASON.format(v='a', r='a')} AS src_reason, CASE WHEN b.doc_id % 5 <> 0 THEN 't' || b.doc_id % 5 END AS primary_topic, CASE WHEN b.doc_id % 5 <> 0 THEN 'title|body' END AS where_hit, CASE WHEN b.doc_id % 5 <> 0 THEN 'q' || b.doc_id END AS evidence FROM vb b LEFT JOIN va a USING (url)",
    "e_failures": f"WITH {_A}, {_B} SELECT run_id, url, 'unparseable model reply' AS reason FROM (FROM va UNION ALL FROM vb) WHERE keep IS NULL",
    "e_truncated": f"WITH {_A}, {_B} SELECT run_id, url, keep, CASE doc_id % 4 WHEN 0 THEN 'max_tokens' ELSE 'length' END AS stop_reason FROM (FROM va UNION ALL FROM vb) WHERE doc_id % 4 < 2",
    "e_reconcile": f"WITH {_HITS}, {_SHORT}, {_REP} SELECT run_id, v.url, keep FROM rep v LEFT JOIN typed USING (url) WHERE run_id = 'c' OR key IN (SELECT content_id FROM mem) OR v.url IN (SELECT url FROM cmp WHERE source = 'search')",
    "e_recounted": f"WITH {_HITS}, {_SHORT}, {_REP}, l AS (SELECT run_id, keep FROM rep v LEFT JOIN typed USING (url) WHERE run_id = 'c' OR key IN (SELECT content_id FROM mem) OR v.url IN (SELECT url FROM cmp WHERE source = 'search')) SELECT x.run_id AS run_id, count(l.run_id) AS pages, count(*) FILTER (keep = 1) AS kept, count(*) FILTER (keep = 0) AS dropped FROM (VALUES ('a'), ('b'), ('c'), ('z')) x(run_id) LEFT JOIN l ON l.run_id = x.run_id GROUP BY 1",
    "e_stalled": f"WITH {_RUNS} SELECT run_id, CAST(epoch(TIMESTAMP '2026-01-12 00:14:00') - epoch((day || ' 00:10:00')::TIMESTAMP) AS BIGINT) AS age FROM runs WHERE status = 'running' AND epoch(TIMESTAMP '2026-01-12 00:14:00') - epoch((day || ' 00:10:00')::TIMESTAMP) > 300",
    "e_compare_runs": f"WITH {_A}, {_B}, {_AB} SELECT count(*) AS shared, count(*) FILTER (ak = 1) AS base_kept, count(*) FILTER (bk = 1) AS other_kept, count(*) FILTER (ak IS DISTINCT FROM bk) AS disagree FROM ab",
    "e_disagreements": f"WITH {_A}, {_B}, {_AB} SELECT url, ak AS b_keep, sa AS b_score, bk AS o_keep, sb AS o_score FROM ab WHERE ak IS DISTINCT FROM bk",
    "e_final_keep": f"WITH {_A}, {_B}, {_SECOND}, {_FINAL.format(n='f', i='va', e='second')} SELECT url, final FROM f",
    "e_final_diffs": f"WITH {_A}, {_B}, {_C}, {_SECOND}, {_FINAL.format(n='f', i='va', e='second')}, {_FINAL.format(n='g', i='vb', e='vc')} SELECT url, f.final, g.final AS other_final FROM f JOIN g USING (url) WHERE f.final <> g.final",
    "e_quotes": f"WITH {_REPLY} SELECT url, CASE doc_id % 6 WHEN 0 THEN 'Zwölf Uhr|ok|KEEP' WHEN 3 THEN 'score|high|Zwölf Uhr|ok|KEEP' ELSE 'keep|score|reason|r {{' || doc_id % 3 || '}}|primary_topic|t' || doc_id % 5 || '|where|title|evidence|one {{|two|more|Zwölf Uhr|ok' END AS quotes FROM r",
    "n_phase1": f"WITH {_A}, {_B}, p AS (SELECT a.url AS au, b.url AS bu, a.keep AS x, b.keep AS y FROM (SELECT * FROM va WHERE doc_id % 9 <> 0) a FULL JOIN (SELECT * FROM vb WHERE doc_id % 8 <> 0) b ON a.url = b.url) SELECT count(*) FILTER (au IS NOT NULL AND bu IS NOT NULL) AS shared, count(*) FILTER (bu IS NULL) AS only_base, count(*) FILTER (au IS NULL) AS only_other, count(*) FILTER (x = 1 AND y = 0) AS accepted_rejected, count(*) FILTER (x = 0 AND y = 1) AS rejected_accepted, count(*) FILTER (au IS NOT NULL AND bu IS NOT NULL AND x IS DISTINCT FROM y AND (x IS NULL OR y IS NULL)) AS with_unscored FROM p",
    "n_overall": f"WITH {_A}, {_B}, {_C}, {_SECOND}, {_FINAL.format(n='f', i='va', e='second')}, {_FINAL.format(n='g', i='vb', e='vc')}, j AS (SELECT f.final AS x, g.final AS y, abs(coalesce(a.score, 0) - coalesce(b.score, 0)) AS delta FROM f JOIN g USING (url) JOIN va a USING (url) JOIN vb b USING (url)) SELECT count(*) AS shared, count(*) FILTER (x AND y) AS both_in, count(*) FILTER (NOT x AND NOT y) AS both_out, count(*) FILTER (x AND NOT y) AS base_only, count(*) FILTER (NOT x AND y) AS other_only, round(avg(delta), 9) AS mean_delta, round(count(*) FILTER (x = y) * 100.0::DOUBLE / count(*), 9) AS agreement FROM j",
    "n_discriminability": f"WITH {_A}, s AS (SELECT * FROM va WHERE keep IS NOT NULL), t AS (SELECT round(score, 2) AS v, count(*) AS n FROM s WHERE keep = 1 GROUP BY 1 ORDER BY n DESC, v LIMIT 1), c AS (SELECT count(*) AS scored, count(*) FILTER (keep = 1) AS kept, count(*) FILTER (keep = 0) AS dropped, count(*) FILTER (keep = 1 AND score > 0 AND score <= 0.35) AS low FROM s) SELECT scored, kept, dropped, low AS borderline_keeps, round(low * 100.0::DOUBLE / kept, 9) AS borderline_pct, v AS top_score, round(n * 100.0::DOUBLE / kept, 9) AS top_share FROM c, t",
    "n_score_histogram": f"WITH {_A}, h AS (SELECT {_BUCKET} AS b, keep FROM va WHERE keep IS NOT NULL) SELECT x.b::INT AS bucket, {_ZONE.format(b='x.b')} AS zone, count(h.b) AS n, count(*) FILTER (keep = 1) AS kept FROM unnest(range(6)) x(b) LEFT JOIN h ON h.b = x.b GROUP BY 1, 2",
    "g_weight": "SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 7 BETWEEN 1 AND 5 THEN round(5::DOUBLE / (c_custkey % 7), 9) ELSE 1.0::DOUBLE END AS weight FROM customer",
    "g_forwarded": f"WITH {_HITS}, {_SHORT} SELECT coalesce(m.url, c.url) AS url, CASE WHEN source = 'search' AND coalesce(es_score < 0.3, false) THEN 'search_below_floor' ELSE coalesce(source, 'shortlister') END AS tag FROM mem m FULL JOIN cmp c ON c.url = m.url",
    "g_stratified_order": f"WITH {GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('s1:' || url)) AS rn, count(*) OVER (PARTITION BY label) AS size FROM gold) SELECT url, row_number() OVER (ORDER BY rn, size, label) AS position FROM r",
    "g_sample": f"WITH {GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('s1:' || url)) AS rn, count(*) OVER (PARTITION BY label) AS size FROM gold), t AS (SELECT *, CASE WHEN size <= 25 THEN size ELSE least(40, size) END AS goal FROM r) SELECT url, label, rn, round(goal / size, 9) AS fraction, round(size / goal, 9) AS weight FROM t WHERE rn <= goal",
    "g_votes": f"WITH {VOTES} SELECT * FROM latest",
    "g_consensus": f"""WITH {VOTES}, {GOLD}, s AS (SELECT url, count(*) AS n_votes, count(*) FILTER (label = 'in') AS i, count(*) FILTER (label = 'out') AS o, count(*) FILTER (label = 'borderline') AS b, string_agg(labeller || ': ' || label || ' — ' || CASE WHEN labeller <> 'b' THEN 'why ' || labeller ELSE '' END, ' | ' ORDER BY labeller) AS said, string_agg(labeller, ', ' ORDER BY labeller) AS labelled_by FROM latest GROUP BY url),
      k AS (SELECT *, greatest(i, o, b) AS most, CASE WHEN i >= greatest(o, b) THEN 'in' WHEN o >= b THEN 'out' ELSE 'borderline' END AS top, CASE WHEN n_votes = 1 THEN 'single' WHEN greatest(i, o, b) = n_votes THEN 'unanimous' WHEN greatest(i, o, b) * 2 > n_votes THEN 'majority' ELSE 'split' END AS kind FROM s),
      c AS (SELECT coalesce(k.url, a.url) AS url, coalesce(n_votes, 0) AS n_votes, CASE WHEN a.url IS NOT NULL THEN 'out' WHEN kind = 'split' THEN 'borderline' ELSE top END AS label, CASE WHEN a.url IS NOT NULL THEN 'adjudicated' ELSE kind END AS agreement,
        CASE WHEN a.url IS NOT NULL THEN 'decided' WHEN n_votes = 1 THEN CASE WHEN labelled_by <> 'b' THEN 'why ' || labelled_by ELSE '' END ELSE said END AS rationale, coalesce(labelled_by, '') AS labelled_by FROM k FULL JOIN (SELECT url FROM gold WHERE doc_id % 11 = 0) a ON a.url = k.url)
      SELECT c.*, CAST(CASE WHEN g.url IS NULL THEN 1 WHEN c.label = 'out' AND agreement = CASE WHEN g.doc_id % 11 = 0 THEN 'adjudicated' ELSE 'single' END AND rationale = 'decided' AND n_votes = 3 THEN 4 ELSE 5 END AS INTEGER) AS version FROM c LEFT JOIN (SELECT * FROM gold WHERE doc_id % 3 = 0) g ON g.url = c.url""",
    "g_disagreements": f"WITH {VOTES} SELECT url, string_agg(labeller || '=' || label, ',' ORDER BY labeller || '=' || label) AS votes FROM latest GROUP BY url HAVING count(DISTINCT label) > 1",
    "g_agreement_summary": f"""WITH {VOTES}, u AS (SELECT url, count(*) AS n, count(DISTINCT label) AS kinds, count(*) FILTER (label = 'in') AS i, count(*) FILTER (label = 'out') AS o, count(*) FILTER (label = 'borderline') AS b FROM latest GROUP BY url), w AS (SELECT *, (i * i + o * o + b * b - 3) / 6.0::DOUBLE AS p FROM u WHERE n = 3),
      f AS (SELECT avg(p) AS p, pow(avg(i / 3), 2) + pow(avg(o / 3), 2) + pow(avg(b / 3), 2) AS e FROM w)
      SELECT 3::BIGINT AS labellers, count(*) AS pages_voted, count(*) FILTER (n >= 2) AS pages_multi, count(*) FILTER (n = 3) AS pages_complete, count(*) FILTER (n >= 2 AND kinds = 1) AS unanimous, (SELECT round((p - e) / (1 - e), 9) FROM f) AS fleiss_kappa, (SELECT count(*) FROM latest WHERE labeller = 'a' AND url LIKE '%1') AS blind_votes FROM u""",
    "g_agreement": f"WITH {VOTES}, j AS (SELECT x.labeller AS a, y.labeller AS b, x.label AS la, y.label AS lb FROM latest x JOIN latest y ON x.url = y.url AND x.labeller < y.labeller), n AS (SELECT a, b, count(*) AS n, avg((la = lb)::INT) AS po FROM j GROUP BY ALL), l AS (SELECT a, b, la AS label, count(*) AS x FROM j GROUP BY ALL), r AS (SELECT a, b, lb AS label, count(*) AS y FROM j GROUP BY ALL), c AS (SELECT a, b, sum(x * y) AS xy FROM l JOIN r USING (a, b, label) GROUP BY ALL) SELECT a, b, n, round(po, 9) AS agreement, round((po - xy::DOUBLE / (n * n)) / (1 - xy::DOUBLE / (n * n)), 9) AS kappa FROM n JOIN c USING (a, b)",
    "g_validate_sheet": f"WITH {CONTENT}, {_SHORT}, s AS (SELECT doc_id AS line, CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'https://www.example.org/d/' || doc_id // 2 * 2 END AS url, doc_id FROM documents), e AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY line) AS n FROM s) "
    "SELECT line, 'empty url' AS error FROM e WHERE url = '' UNION ALL SELECT line, 'duplicate url' FROM e WHERE url <> '' AND n > 1 UNION ALL SELECT line, CASE WHEN (doc_id // 2 * 2) % 4 = 0 THEN 'not in corpus' ELSE 'not forwarded' END FROM e WHERE url <> '' AND ((doc_id // 2 * 2) % 4 = 0 OR url NOT IN (SELECT url FROM mem)) UNION ALL SELECT line, 'bad label' FROM e WHERE doc_id % 7 = 0 UNION ALL SELECT line, 'missing rationale' FROM e WHERE doc_id % 5 = 0",
    "g_gold_sha": f"WITH {GOLD} SELECT sha256(string_agg(url || chr(9) || label, chr(10) ORDER BY url || chr(9) || label)) AS gold_sha FROM gold",
    "m_confusion": f"WITH {GOLD}, {_A}, va2 AS (SELECT * FROM va WHERE doc_id % 11 <> 0), {_CELLS.format(v='va2')} SELECT * FROM conf",
    "m_rates": f"WITH {GOLD}, {_A}, {_CELLS.format(v='va')} SELECT bound, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tn / nullif(tn + fp, 0), 9) AS specificity, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM conf",
    "m_borderline": f"WITH {GOLD}, {_A} SELECT round(avg(coalesce(keep = 1, false)::INT), 9) AS kept_share FROM gold LEFT JOIN va USING (url) WHERE label = 'borderline'",
    "m_value_add": f"""WITH {GOLD}, {_A}, {_B}, m AS (SELECT bound, CASE WHEN label = 'borderline' THEN CASE bound WHEN 'in' THEN true WHEN 'out' THEN false END ELSE label = 'in' END AS t, coalesce(a.keep = 1, false) AS k, coalesce(a.keep = 1 AND b.keep = 0, false) AS x FROM gold LEFT JOIN va a USING (url) LEFT JOIN vb b USING (url), unnest(['exclude', 'in', 'out']) u(bound)),
      c AS (SELECT bound, count(*) FILTER (k) AS p1_keeps, count(*) FILTER (x) AS p2_drops, count(*) FILTER (x AND NOT t) AS fp_removed, count(*) FILTER (x AND t) AS tp_lost, count(*) FILTER (t) AS g FROM m WHERE t IS NOT NULL GROUP BY bound)
      SELECT bound, p1_keeps, p2_drops, fp_removed, tp_lost, fp_removed - tp_lost AS net, round(fp_removed / nullif(fp_removed + tp_lost, 0), 9) AS drop_precision, round(tp_lost / nullif(g, 0), 9) AS lost_share FROM c""",
    "m_stability": f"WITH {_REP}, k AS (SELECT url, count(*) FILTER (keep = 1) AS k FROM rep GROUP BY url) SELECT count(*) AS pages, count(*) FILTER (k BETWEEN 1 AND 2) AS flip_pages, round(avg((k IN (0, 3))::INT), 9) AS unanimous FROM k",
    "m_rates_by_repeat": f"""WITH {GOLD}, {_REP}, m AS (SELECT url, CASE WHEN count(keep) > 0 THEN (2 * count(*) FILTER (keep = 1) >= 3)::INT END AS keep FROM rep GROUP BY url), v AS (SELECT x.arm AS arm, g.url, label, keep FROM gold g CROSS JOIN (VALUES ('a'), ('b'), ('c')) x(arm) LEFT JOIN rep ON rep.url = g.url AND run_id = x.arm UNION ALL SELECT 'majority', g.url, label, keep FROM gold g LEFT JOIN m USING (url)),
      c AS (SELECT arm, bound, CASE WHEN label = 'borderline' THEN CASE bound WHEN 'in' THEN true WHEN 'out' THEN false END ELSE label = 'in' END AS truth, coalesce(keep = 1, false) AS kept FROM v, unnest(['exclude', 'in', 'out']) t(bound)),
      n AS (SELECT arm, bound, count(*) FILTER (truth AND kept) AS tp, count(*) FILTER (NOT truth AND kept) AS fp, count(*) FILTER (truth AND NOT kept) AS fn, count(*) FILTER (NOT truth AND NOT kept) AS tn FROM c WHERE truth IS NOT NULL GROUP BY ALL),
      e AS (SELECT * FROM n UNION ALL SELECT 'micro', bound, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), CAST(sum(tn) AS BIGINT) FROM n WHERE arm <> 'majority' GROUP BY bound)
      SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tn / nullif(tn + fp, 0), 9) AS specificity, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM e""",
    "m_fleiss": f"WITH {_REP}, k AS (SELECT url, count(*) FILTER (keep = 1) AS k FROM rep WHERE doc_id % 10 <> 3 GROUP BY url), p AS (SELECT avg((k * k + (3 - k) * (3 - k) - 3) / 6.0::DOUBLE) AS p, avg(k / 3) AS q FROM k) SELECT round((p - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 9) AS kappa FROM p",
    "m_majority": f"WITH {_REP} SELECT url, CASE WHEN count(keep) > 0 THEN (2 * count(*) FILTER (keep = 1) >= 3)::INT END AS keep FROM rep GROUP BY url",
    "m_score_stability": f"WITH {_REP}, p AS (SELECT url, stddev_samp(score) AS sd, count(DISTINCT {_BAND}) AS bands FROM rep GROUP BY url) SELECT round(avg(sd), 9) AS mean_sd, round(avg((sd > 0.15)::INT), 9) AS unstable, round(avg((bands = 1)::INT), 9) AS one_band FROM p",
    "m_calibration": f"WITH {GOLD}, {_A}, j AS (SELECT label = 'in' AS truth, score FROM gold LEFT JOIN (SELECT url, score FROM va WHERE doc_id % 9 <> 0) v USING (url) WHERE label <> 'borderline'), t AS (SELECT {_BAND} AS band, count(*) AS n, avg(truth::INT) AS share FROM j GROUP BY 1), o AS (SELECT list(share ORDER BY band) AS s FROM t WHERE band <> 'unscored') SELECT band, n, round(share, 9) AS share_in, (SELECT CASE WHEN len(s) > 1 THEN s = list_sort(s) END FROM o) AS monotone, (SELECT round(avg(pow(score - truth::INT, 2)), 9) FROM j) AS brier FROM t",
    "m_bootstrap": f"""WITH {_boot(metrics.RESAMPLES)} SELECT max(CASE WHEN rep = 0 THEN ra END) AS point, round(s[floor(0.025 * (len(s) - 1))::INT + 1], 9) AS low, round(s[floor(0.975 * (len(s) - 1))::INT + 1], 9) AS high, CAST(len(s) AS INTEGER) AS draws FROM (SELECT rep, round(ra, 9) AS ra FROM m), (SELECT list(ra ORDER BY ra) AS s FROM m WHERE rep > 0 AND ra IS NOT NULL) GROUP BY s""",
    "m_bootstrap_difference": f"""WITH {_boot(metrics.RESAMPLES, 'in', 'vb')}, d AS (SELECT rep, fa - fb AS x FROM m) SELECT max(CASE WHEN rep = 0 THEN round(x, 9) END) AS point, round(s[floor(0.025 * (len(s) - 1))::INT + 1], 9) AS low, round(s[floor(0.975 * (len(s) - 1))::INT + 1], 9) AS high, CAST(len(s) AS INTEGER) AS draws FROM d, (SELECT list(x ORDER BY x) AS s FROM d WHERE rep > 0 AND x IS NOT NULL) GROUP BY s""",
    "m_mcnemar": f"WITH {GOLD}, {_A}, {_B}, m AS (SELECT coalesce(a.keep = 1, false) = (label = 'in') AS ra, coalesce(b.keep = 1, false) = (label = 'in') AS rb FROM gold LEFT JOIN va a USING (url) LEFT JOIN vb b USING (url) WHERE label <> 'borderline'), c AS (SELECT count(*) FILTER (ra AND NOT rb) AS only_a, count(*) FILTER (NOT ra AND rb) AS only_b FROM m) SELECT only_a, only_b, round(CASE WHEN only_a + only_b > 0 THEN least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM unnest(range(0, least(only_a, only_b) + 1)) t(i))) END, 9) AS p FROM c",
    "m_kappa": f"WITH {_A}, {_B}, {_AB}, p AS (SELECT avg((coalesce(ak = 1, false) = coalesce(bk = 1, false))::INT) AS po, avg(coalesce(ak = 1, false)::INT) AS pa, avg(coalesce(bk = 1, false)::INT) AS pb FROM ab) SELECT round(po, 9) AS po, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa, round(2 * asin(sqrt(pa)) - 2 * asin(sqrt(pb)), 9) AS h FROM p",
    "m_percentile": f"WITH {_REP} SELECT run_id, round(quantile_cont(ms::DOUBLE, 0.5), 9) AS p50, round(quantile_cont(ms::DOUBLE, 0.9), 9) AS p90 FROM rep GROUP BY run_id",
    "k_usage_norm": "WITH u AS (SELECT event_id AS k, event_id % 1000 AS fresh, event_id % 300 AS cached FROM events), v AS (SELECT k, CASE WHEN k % 6 <> 0 AND k % 2 = 1 AND k % 3 = 0 THEN 0 ELSE cached END AS hit, CASE WHEN k % 6 = 0 THEN greatest(fresh - cached, 0) WHEN k % 2 = 0 OR k % 3 = 0 THEN fresh ELSE fresh + k % 40 END AS miss, CASE WHEN k % 6 = 0 THEN fresh END AS prompt FROM u) "
    "SELECT k AS event_id, CASE WHEN ok THEN coalesce(prompt, miss + hit) END AS total, CASE WHEN ok THEN hit END AS hit, CASE WHEN ok THEN miss END AS miss, CASE WHEN ok THEN k % 70 END AS out FROM (SELECT *, k % 11 <> 0 AND k % 7 <> 0 AS ok FROM v)",
    "k_peak": f"SELECT event_id, {_PEAK} AS peak FROM events",
    "k_call_cost": f"WITH {_PRICED} SELECT event_id, round(cost, 9) AS cost FROM priced",
    "k_footprint": f"WITH {LEDGER}, t AS (SELECT sum(miss) AS miss, sum(hit) AS hit, sum(out) AS o FROM ledger), f AS (SELECT * FROM (VALUES ('point', 0.3, 1.5, 0.25, 1.2, 1.0, 0.2, 0.0), ('low', 0.1, 0.5, 0.1, 1.1, 0.3, 0.05, 0.0), ('high', 1.0, 5.0, 0.5, 1.5, 2.0, 0.4, 0.3)) v(level, ein, eout, cache, pue, water, grid, uplift)), k AS (SELECT *, (miss * ein::DOUBLE + hit * ein::DOUBLE * cache + o * eout::DOUBLE) * pue::DOUBLE * (1 + uplift::DOUBLE) / 3.6e6 AS kwh FROM t, f) "
    "SELECT m AS measure, level, round(CASE m WHEN 'kwh' THEN kwh WHEN 'water_l' THEN kwh * water::DOUBLE ELSE kwh * grid::DOUBLE END, 9) AS amount FROM k, unnest(['kwh', 'water_l', 'co2_kg']) u(m)",
    "k_equivalents": f"WITH {LEDGER}, t AS (SELECT (sum(miss) * 0.3::DOUBLE + sum(hit) * 0.3::DOUBLE * 0.25 + sum(out) * 1.5::DOUBLE) * 1.2 / 3.6e6 AS kwh FROM ledger) SELECT label, round(kwh * 1000 * per / one, 9) AS amount FROM t, (VALUES ('phone charges', 1.0::DOUBLE, 10), ('kettles boiled', 1.0, 100), ('web searches', 1.0, 0.3), ('cups of water', 1.0, 250), ('km driven', 0.2, 120)) v(label, per, one)",
    "k_footprint_summary": f"""WITH {_PAID}, g AS (SELECT CASE WHEN grouping(phase) = 0 THEN 'phase' WHEN grouping(model) = 0 THEN 'model' ELSE 'all' END AS scope, provider, model, phase, count(*) AS runs, sum(cost) AS cost, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(hit), 0) AS BIGINT) AS hit,
      CAST(coalesce(sum(miss), 0) AS BIGINT) AS miss, CAST(coalesce(sum(o), 0) AS BIGINT) AS out, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(kept) AS BIGINT) AS kept, sum(CASE WHEN tokens > 0 THEN cost ELSE 0 END) AS metered_cost,
      count(*) FILTER (tokens = 0 AND cost > 0) AS untracked_runs, sum(CASE WHEN tokens = 0 THEN cost ELSE 0 END) AS untracked_cost FROM (SELECT *, coalesce(total, 0) + coalesce(o, 0) AS tokens FROM paid) GROUP BY GROUPING SETS ((provider, model), (phase), ())),
      k AS (SELECT *, (miss * 0.3::DOUBLE + hit * 0.3::DOUBLE * 0.25 + out * 1.5::DOUBLE) * 1.2 / 3.6e6 AS kwh, nullif(total + out, 0) / 1e6 AS mega FROM g)
      SELECT scope, provider, model, phase, runs, round(cost, 6) AS cost, total, hit, miss, out, pages, kept, round(metered_cost, 6) AS metered_cost, untracked_runs, round(untracked_cost, 6) AS untracked_cost, round(kwh, 9) AS kwh, round(kwh * 1.0::DOUBLE, 9) AS water_l, round(kwh * 0.2::DOUBLE, 9) AS co2_kg,
      round(metered_cost / mega, 6) AS cost_per_mtok, round(kwh / mega, 9) AS kwh_per_mtok, round(kwh / mega, 9) AS water_l_per_mtok, round(kwh * 0.2::DOUBLE / mega, 9) AS co2_kg_per_mtok, round(cost / nullif(pages, 0), 6) AS cost_per_page, round(cost / nullif(kept, 0), 6) AS cost_per_kept,
      round(kwh / nullif(pages, 0), 9) AS kwh_per_page, round(kwh * 0.2::DOUBLE * 1000 / nullif(pages, 0), 9) AS co2_g_per_page, round(hit / nullif(total, 0), 9) AS cached_share, round((total + out) / nullif(pages, 0), 9) AS tokens_per_page FROM k""",
    "k_data_issues": f"WITH {_PAID} SELECT run_id, round(cost, 6) AS cost FROM paid WHERE cost > 0 AND coalesce(total, 0) + coalesce(o, 0) = 0",
    "a_spend_by_phase": f"WITH {_PRICED} SELECT phase, round(sum(cost), 9) AS spend, count(*) AS calls FROM priced GROUP BY phase",
    "a_spend_by_day": f"WITH {_PRICED}, x AS (SELECT ts::DATE AS day, sum(cost) AS spend FROM priced GROUP BY 1) SELECT day, round(spend, 6) AS spend, round(sum(spend) OVER (ORDER BY day), 6) AS running FROM x",
    "a_run_health": "WITH r AS (SELECT c_custkey AS k, strftime(DATE '2026-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') || 'T10:00:00' AS started_at, c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AS ok FROM customer), h AS (SELECT *, CASE WHEN ok THEN k % 7 + 1 ELSE 0 END AS errors, CASE WHEN ok THEN k % 50 ELSE 0 END AS processed FROM r ORDER BY started_at DESC, k DESC LIMIT 40) SELECT k AS run_id, 'align' AS stage, CASE WHEN k % 3 = 0 THEN 'running' ELSE 'done' END AS status, started_at, CASE WHEN k % 3 <> 0 THEN (k % 10 * 60 + 30.5)::DOUBLE END AS elapsed_s, errors, processed, round(CASE WHEN errors + processed > 0 THEN processed * 100.0::DOUBLE / (errors + processed) ELSE 100 END, 9) AS success_rate FROM h",
    "a_runs_active": "SELECT count(*) AS n FROM customer WHERE c_custkey % 3 = 0",
    "a_fetch_log": "SELECT user_id % 10 AS run_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
}
