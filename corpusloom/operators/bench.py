"""Benchmark runs joined to the gold set, and the phase chain of each active run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.runs import CUT_OFF, run_roots

_SPEC = "scope struct<sha: string>, bench struct<p1: string, p2: string, repeat: int>, template_hash string"


def bench_runs(runs: DataFrame, sha: str, templates: dict[str, str]) -> DataFrame:
    """Runs named ``bench/…`` and stamped with this gold set and a benchmark tag.

    ``mismatch`` marks runs whose template is not their phase's in ``templates``; a broken or
    missing stamp leaves the run out.
    """
    stamped = runs.where(F.col("name").startswith("bench/")).withColumn("s", F.from_json("spec", _SPEC))
    expected = F.element_at(F.create_map(*[F.lit(x) for pair in templates.items() for x in pair]), F.col("phase"))
    own = stamped.where((F.col("s.scope.sha") == sha) & F.col("s.bench").isNotNull())
    return own.select("run_id", "phase", "source_run_id", "started_at", "s.bench.p1", "s.bench.p2", F.coalesce("s.bench.repeat", F.lit(0)).alias("repeat"), (~F.col("s.template_hash").eqNullSafe(expected)).alias("mismatch"))


def drifted(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Urls that some run saw with another content hash than the labeller; unknown hashes don't count."""
    held = gold.select("url", "content_hash_at_label")
    return results.select("url", "content_hash").join(held, "url").where("content_hash <> content_hash_at_label").select("url").distinct()


def bench_join(runs: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """``p1, repeat, p2, url, label, keep1, keep2, mismatch``: every page of the gold set for each first-phase run and each second phase over it.

    ``runs`` comes from ``bench_runs``: tens of runs, listed beside each page. Results and labels
    join by url. Of second-phase runs with the same tag over one run the last counts. A first-phase
    run without a second gives one row a page with null ``p2`` and ``keep2``. Pages that drifted
    in any of these runs are left out; a page without a verdict has a null one.
    """
    used = results.join(runs.select("run_id"), "run_id", "left_semi")
    sound = gold.join(drifted(used, gold), "url", "left_anti").select("url", "label")
    last = F.max_by(F.struct("run_id", "mismatch"), F.struct("started_at", "run_id"))
    second = runs.where("phase = 'exclusion'").groupBy(F.col("source_run_id").alias("run_id"), "p2").agg(last.alias("x"))
    first = runs.where("phase = 'inclusion'").select("run_id", "p1", "repeat", F.col("mismatch").alias("m"))
    paired = first.join(second, "run_id", "left").select("run_id", "p1", "repeat", "p2", F.col("x.run_id").alias("run2"), (F.col("m") | F.coalesce("x.mismatch", F.lit(False))).alias("mismatch"))
    listed = paired.agg(F.collect_list(F.struct(*paired.columns)).alias("pairs")).scalar()
    pages = sound.select("*", F.inline(listed))
    one = used.select("run_id", "url", F.col("keep").alias("keep1"))
    two = used.select(F.col("run_id").alias("run2"), "url", F.col("keep").alias("keep2"))
    return pages.join(one, ["run_id", "url"], "left").join(two, ["run2", "url"], "left").select("p1", "repeat", "p2", "url", "label", "keep1", "keep2", "mismatch")


def per_run(joined: DataFrame) -> DataFrame:
    """Counts of each run pair over in and out labels; unparsed and missing verdicts of the first phase in ``unparsed``."""
    final = F.when(F.col("keep1") == 1, F.when(F.col("p2").isNull(), 1).otherwise(F.coalesce("keep2", F.lit(0)))).otherwise(F.col("keep1"))
    n = lambda text: F.count_if(F.expr(text)).alias
    return joined.withColumn("final", final).groupBy("p1", "repeat", "p2").agg(
        n("label = 'in' AND final = 1")("tp"), n("label = 'out' AND final = 1")("fp"), n("label = 'in' AND final = 0")("fn"), n("label = 'out' AND final = 0")("tn"), n("final IS NULL")("unparsed"), F.bool_or("mismatch").alias("mismatch")
    )


def active_chains(runs: DataFrame, active: DataFrame, totals: DataFrame, shortlists: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """``category_id, active_run, run_id, phase, pages, kept, dropped, status, reason, message``: the runs of each active run's lineage.

    ``runs`` (``run_id, category_id, phase, source_run_id, started_at, finished``) of one lineage
    share a category; ``active`` is ``category_id, run_id``. A run without totals has zeros. The
    first reason that holds makes the chain incomplete: ``running``, ``short`` (fewer pages than
    the shortlist, or than its source run kept; an unknown target is met) and ``no exclusion``
    (kept pages that no second phase has read). ``message`` is its sentence, about the first run that
    is in that state.
    """
    runs = runs.select("run_id", "category_id", "phase", "source_run_id", "started_at", "finished")
    roots = run_roots(runs).select("run_id", "root")
    lineage = active.join(roots, "run_id").select("category_id", F.col("run_id").alias("active_run"), "root").join(roots, "root").drop("root")
    counted = runs.drop("category_id").join(totals.select("run_id", "pages", "kept", "dropped"), "run_id", "left").na.fill(0, ["pages", "kept", "dropped"])
    chain = lineage.join(counted, "run_id").join(shortlists.select("category_id", "shortlist_total"), "category_id", "left")
    chain = chain.join(counted.select(F.col("run_id").alias("source_run_id"), F.col("kept").alias("source_kept")), "source_run_id", "left")
    target = F.when(F.col("phase") == "exclusion", F.col("source_kept")).otherwise(F.col("shortlist_total"))
    met = chain.withColumns({"target": target, "short": F.coalesce(F.col("pages") < target, F.lit(False)), "open": ~F.coalesce("finished", F.lit(False))})
    order = F.struct("started_at", "run_id")
    first = lambda flag: F.min_by(F.struct("phase", "pages", "target"), F.when(F.col(flag), order))
    said = met.groupBy("active_run").agg(
        F.bool_or("open").alias("running"), F.bool_or("short").alias("short"), F.bool_or(F.col("phase") == "exclusion").alias("checked"), first("open").alias("r"), first("short").alias("x"), F.sum("pages").alias("all_pages"),
        F.min_by("kept", F.when(F.col("phase") == "inclusion", order)).alias("waiting"),
    )
    reason = F.when(F.col("running"), "running").when(F.col("short"), "short").when(~F.col("checked") & (F.col("waiting") > 0), "no exclusion")
    n = lambda c: F.format_number(c, 0)
    # The sentences that users read.
    message = (
        F.when(reason == "running", F.concat(F.coalesce("r.phase", F.lit("A phase")), F.lit(" is still in progress.")))
        .when(reason == "short", F.concat("x.phase", F.lit(" evaluated "), n(F.col("x.pages")), F.lit(" of "), n(F.col("x.target")), F.lit(" — "), n(F.col("x.target") - F.col("x.pages")), F.lit(" still to do (input ≠ kept + dropped).")))
        .when(reason == "no exclusion", F.concat(F.lit("Phase 2 (Exclusion) hasn't run over the "), n(F.col("waiting")), F.lit(" kept pages.")))
    )
    working = F.lit(False).alias("alive") if live is None else F.col("alive")
    alive = said.select("active_run", working) if live is None else met.join(live.select("run_id").distinct(), "run_id", "left_semi").select("active_run", F.lit(True).alias("alive")).distinct()
    said = said.join(alive, "active_run", "left")
    state = F.when(reason.isNull(), "complete").when(F.col("all_pages") > 0, "partial").otherwise("fresh")
    status = said.select("active_run", F.when(F.coalesce("alive", F.lit(False)), "in_progress").when(reason.isNull(), "complete").otherwise("incomplete").alias("status"), reason.alias("reason"), message.alias("message"), state.alias("state"))
    return met.join(status, "active_run").select("category_id", "active_run", "run_id", "phase", "pages", "kept", "dropped", "status", "reason", "message", "state")


# Why a run stopped, by its stored code, and the codes that are failures.
STOPPED = {
    "budget": "Stopped early because the daily AI budget was reached. Re-execute to continue where it left off.",
    "provider_errors": "Stopped after repeated provider errors in a row — the provider was likely down or rate-limiting. Re-execute to resume where it left off.",
    "balance": "Stopped — the provider rejected the calls for a low credit balance. {hint} Top up, then re-execute to resume where it left off.",
    "config": "Stopped because of a configuration problem — e.g. no API key set for this run's provider. Fix it in Settings, then re-execute.",
    "manual": "Stopped manually (you pressed Stop). Re-execute to continue where it left off.",
    "error": "Stopped after an unexpected error. Re-execute to continue where it left off.",
}
FAILED = ("provider_errors", "balance", "config", "error")
CAP = "It reached this execution's page cap — re-execute to evaluate the rest."
UNKNOWN_STOP = "Stopped early — the daily AI budget was reached, a provider error occurred, or it was stopped manually. Re-execute to continue where it left off."
REST, SOME_LEFT = "Re-execute to evaluate the rest.", "Some pages were not evaluated. "


def run_outcomes(chains: DataFrame, runs: DataFrame, results: DataFrame, balance_hint: str = "Check your credit balance.") -> DataFrame:
    """``run_id, label, kind, why, unparsed, truncated, stop_reason`` of each active run of ``active_chains``.

    ``runs`` has ``run_id, status, stop_reason``; ``results`` ``run_id, keep, stop_reason`` of pages,
    counted over the whole chain. A run is Completed, Not started, or Did not complete; then ``why``
    says why by its code, else by its status, else by what is left to do. A failure's kind is bad,
    any other stop's warn.
    """
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    counted = chains.select("active_run", "run_id").join(results.select("run_id", "keep", F.col("stop_reason").alias("cut")), "run_id").groupBy("active_run").agg(n(F.col("keep").isNull(), "unparsed"), n(F.col("cut").isin(*CUT_OFF), "truncated"))
    one = chains.groupBy("active_run").agg(F.first("state").alias("state"), F.first("message").alias("message"))
    met = one.join(runs.select(F.col("run_id").alias("active_run"), "status", "stop_reason"), "active_run", "left").join(counted, "active_run", "left").na.fill(0, ["unparsed", "truncated"])
    code, partial = F.col("stop_reason"), F.col("state") == "partial"
    lead = lambda other: F.coalesce(F.concat("message", F.lit(" ")), F.lit(other))
    known = F.create_map(*[F.lit(x.replace("{hint}", balance_hint)) for pair in STOPPED.items() for x in pair])
    why = F.when(code == "cap", F.concat(lead(""), F.lit(CAP))).when(F.map_contains_key(known, code), F.element_at(known, code)).when(F.col("status") == "stopped", UNKNOWN_STOP).otherwise(F.concat(lead(SOME_LEFT), F.lit(REST)))
    label = F.when(F.col("state") == "complete", "Completed").when(F.col("state") == "fresh", "Not started").otherwise("Did not complete")
    kind = F.when(F.col("state") == "complete", "good").when(F.col("state") == "fresh", "muted").when(code.isin(*FAILED), "bad").otherwise("warn")
    return met.select(F.col("active_run").alias("run_id"), label.alias("label"), kind.alias("kind"), F.when(partial, why).alias("why"), "unparsed", "truncated", F.when(partial, code).alias("stop_reason"))
