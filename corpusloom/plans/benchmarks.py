"""Queries over benchmark runs, their report and active runs, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import bench
from corpusloom.plans import evaluation as ev
from corpusloom.plans.roles import GOLD, table
from corpusloom.plans.roles import gold as gold_labels
from corpusloom.sources import writers
from corpusloom.sources.scratch import checkpoint_dir

_RUNS = [  # run, name, phase, source, started, sha, p1, p2, repeat, template
    ("a", "bench/a", "inclusion", None, "1", "g1", "small", None, 1, "t1"),
    ("b", "bench/b", "inclusion", None, "2", "g1", "small", None, 2, "old"),
    ("c", "bench/c", "exclusion", "a", "3", "g1", "small", "large", 1, "t2"),
    ("x", "bench/x", "exclusion", "a", "2", "g1", "small", "large", 1, "t2"),
    ("y", "bench/y", "inclusion", None, "4", "g0", "small", None, 3, "t1"),
    ("z", "trial", "inclusion", None, "5", "g1", "small", None, 4, "t1"),
]


def bench_runs(s, d):
    rows = [(*r[:5], f'{{"scope":{{"sha":"{r[5]}"}},"bench":{{"p1":"{r[6]}"' + (f',"p2":"{r[7]}"' if r[7] else "") + f',"repeat":{r[8]}}},"template_hash":"{r[9]}"}}') for r in _RUNS]
    made = s.createDataFrame(rows, "run_id string, name string, phase string, source_run_id string, started_at string, spec string")
    return bench.bench_runs(made, "g1", {"inclusion": "t1", "exclusion": "t2"})


def joined(s, d):
    """Labels of every labelled document, verdicts of every document; hashes differ for some."""
    gold = gold_labels(s, d).groupBy("url", "doc_id").agg(F.min("label").alias("label")).withColumn("content_hash_at_label", F.when(F.col("doc_id") % 5 != 0, "h1"))
    results = ev.repeats(s, d).withColumn("content_hash", F.when(F.col("doc_id") % 8 == 1, "h2").when(F.col("doc_id") % 8 != 2, "h1"))
    return bench.bench_join(bench_runs(s, d), results, gold)


def snk_bench_report(s, d):
    path = f"{checkpoint_dir(s)}/report-{uuid.uuid4().hex}"
    pages = joined(s, d)
    writers.write_report({"per_page": pages, "per_run": bench.per_run(pages)}, pages.agg(F.countDistinct("url").alias("n")), path)
    runs = s.read.csv(f"{path}/per_run", header=True, schema="p1 string, repeat int, p2 string, tp long, fp long, fn long, tn long, unparsed long, mismatch boolean")
    return runs.withColumn("n", s.read.schema("n long").json(f"{path}/summary").scalar())


def chained(s, d):
    """Customers as runs, four to a category, with their orders as results."""
    k = F.col("c_custkey")
    source = F.when(k % 4 > 1, k - k % 4 + 1)
    phase = F.when(k % 4 > 1, "exclusion").otherwise("inclusion")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (k % len(CODES) + 1).cast("int"))
    runs = table(s, d, "customer").select(k.alias("run_id"), F.floor(k / 4).alias("category_id"), phase.alias("phase"), source.alias("source_run_id"), F.lpad((k * 7 % 10).cast("string"), 2, "0").alias("started_at"), (k % 9 != 0).alias("finished"), F.when(k % 5 == 0, "stopped").alias("status"), code.alias("stop_reason"))
    active = runs.groupBy("category_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    state = F.col("o_orderstatus")
    results = table(s, d, "orders").select(F.col("o_custkey").alias("run_id"), F.when(state == "F", 1).when(state == "O", 0).alias("keep"), F.when(F.col("o_orderkey") % 7 == 0, "length").alias("stop_reason"))
    totals = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("keep") == 1).alias("kept"), F.count_if(F.col("keep") == 0).alias("dropped"))
    shortlists = runs.select("category_id", (F.col("category_id") % 5 * F.when(F.col("category_id") % 7 == 0, 1000).otherwise(1)).alias("shortlist_total")).distinct()
    return bench.active_chains(runs, active, totals, shortlists, runs.where("run_id % 26 = 0")), runs, results


CODES = ["budget", "provider_errors", "balance", "cap", "manual", None, "other"]


def e_active_run(s, d):
    return chained(s, d)[0].drop("state")


def e_outcome(s, d):
    return bench.run_outcomes(*chained(s, d))


QUERIES = {"m_bench_join": joined, "snk_bench_report": snk_bench_report, "e_active_run": e_active_run, "e_outcome": e_outcome}

_JOIN = f"""{ev._REP}, {GOLD}, g AS (SELECT url, doc_id, min(label) AS label FROM gold GROUP BY 1, 2),
sound AS (SELECT url, label FROM g WHERE NOT (doc_id % 8 = 1 AND doc_id % 5 <> 0 AND url IN (SELECT url FROM rep))),
pairs(run, p1, repeat, p2, run2, mismatch) AS (VALUES ('a', 'small', 1, 'large', 'c', false), ('b', 'small', 2, NULL, NULL, true)),
joined AS (SELECT p1, repeat, p2, s.url, label, x.keep AS keep1, y.keep AS keep2, mismatch FROM sound s CROSS JOIN pairs p LEFT JOIN rep x ON x.run_id = p.run AND x.url = s.url LEFT JOIN rep y ON y.run_id = p.run2 AND y.url = s.url)"""

_CHAINS = """WITH r AS (SELECT c_custkey AS run_id, c_custkey // 4 AS category_id, CASE WHEN c_custkey % 4 > 1 THEN 'exclusion' ELSE 'inclusion' END AS phase, c_custkey % 4 > 0 AS chained, c_custkey * 7 % 10 AS started, c_custkey % 9 <> 0 AS finished FROM customer),
t AS (SELECT o_custkey AS run_id, count(*) AS pages, count(*) FILTER (o_orderstatus = 'F') AS kept, count(*) FILTER (o_orderstatus = 'O') AS dropped FROM orders GROUP BY 1),
c AS (SELECT r.*, coalesce(pages, 0) AS pages, coalesce(kept, 0) AS kept, coalesce(dropped, 0) AS dropped FROM r LEFT JOIN t USING (run_id)),
w AS (SELECT *, last_value(run_id) OVER a AS active_run, last_value(chained) OVER a AS live, max(kept) FILTER (chained AND phase = 'inclusion') OVER (PARTITION BY category_id) AS source_kept FROM c WINDOW a AS (PARTITION BY category_id ORDER BY started, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, CASE WHEN phase = 'exclusion' THEN source_kept ELSE category_id % 5 * CASE WHEN category_id % 7 = 0 THEN 1000 ELSE 1 END END AS target, coalesce(pages < target, false) AS short FROM w WHERE chained = live),
s AS (SELECT active_run, sum(pages)::BIGINT AS all_pages, arg_min(phase, (started, run_id)) FILTER (NOT finished) AS open, arg_min(phase, (started, run_id)) FILTER (short) AS sp, arg_min(pages, (started, run_id)) FILTER (short) AS sn, arg_min(target, (started, run_id)) FILTER (short) AS st, CASE WHEN NOT bool_or(phase = 'exclusion') THEN arg_min(kept, (started, run_id)) FILTER (phase = 'inclusion') END AS waiting FROM m GROUP BY 1),
q AS (SELECT active_run, all_pages, CASE WHEN open IS NOT NULL THEN 'running' WHEN sp IS NOT NULL THEN 'short' WHEN waiting > 0 THEN 'no exclusion' END AS reason,
  CASE WHEN open IS NOT NULL THEN open || ' is still in progress.' WHEN sp IS NOT NULL THEN sp || format(' evaluated {:,} of {:,} — {:,} still to do (input ≠ kept + dropped).', sn, st, st - sn) WHEN waiting > 0 THEN format('Phase 2 (Exclusion) hasn''t run over the {:,} kept pages.', waiting) END AS message FROM s)"""

ORACLE_SQL = {
    "m_bench_join": f"WITH {_JOIN} SELECT * FROM joined",
    "snk_bench_report": f"""WITH {_JOIN}, f AS (SELECT *, CASE WHEN keep1 = 1 AND p2 IS NOT NULL THEN coalesce(keep2, 0) ELSE keep1 END AS final FROM joined)
SELECT p1, repeat, p2, count(*) FILTER (label = 'in' AND final = 1) AS tp, count(*) FILTER (label = 'out' AND final = 1) AS fp, count(*) FILTER (label = 'in' AND final = 0) AS fn, count(*) FILTER (label = 'out' AND final = 0) AS tn,
count(*) FILTER (final IS NULL) AS unparsed, bool_or(mismatch) AS mismatch, (SELECT count(DISTINCT url) FROM joined) AS n FROM f GROUP BY p1, repeat, p2""",
    "e_active_run": f"{_CHAINS} SELECT category_id, active_run, run_id, phase, pages, kept, dropped, CASE WHEN bool_or(run_id % 26 = 0) OVER (PARTITION BY active_run) THEN 'in_progress' WHEN reason IS NULL THEN 'complete' ELSE 'incomplete' END AS status, reason, message FROM m JOIN q USING (active_run)",
    "e_outcome": f"""{_CHAINS}, u AS (SELECT active_run, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS unparsed, count(*) FILTER (o_orderkey % 7 = 0) AS truncated FROM m JOIN orders ON o_custkey = run_id GROUP BY 1),
z AS (SELECT active_run, CASE WHEN reason IS NULL THEN 'complete' WHEN all_pages > 0 THEN 'partial' ELSE 'fresh' END AS state, message, {CODES!r}[active_run % {len(CODES)} + 1] AS code, active_run % 5 = 0 AS stopped FROM q)
SELECT active_run AS run_id, CASE state WHEN 'complete' THEN 'Completed' WHEN 'fresh' THEN 'Not started' ELSE 'Did not complete' END AS label, CASE state WHEN 'complete' THEN 'good' WHEN 'fresh' THEN 'muted' ELSE CASE WHEN code IN {bench.FAILED} THEN 'bad' ELSE 'warn' END END AS kind,
CASE WHEN state = 'partial' THEN CASE code {" ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2).replace('{hint}', 'Check your credit balance.')}'" for k, v in bench.STOPPED.items())} WHEN 'cap' THEN message || ' {bench.CAP.replace("'", "''")}' ELSE CASE WHEN stopped THEN '{bench.UNKNOWN_STOP}' ELSE message || ' {bench.REST}' END END END AS why,
coalesce(unparsed, 0) AS unparsed, coalesce(truncated, 0) AS truncated, CASE WHEN state = 'partial' THEN code END AS stop_reason FROM z LEFT JOIN u USING (active_run)""".replace("None", "NULL"),
}
