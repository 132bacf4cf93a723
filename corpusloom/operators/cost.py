"""Token usage, prices and footprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The footprint factors as point, low and high. Joules a token in and out, share of a
# cached token, data-centre overhead, litres and kg of CO2 a kWh, uplift for the hardware.
FACTORS = {
    "e_in_j_per_tok": (0.30, 0.10, 1.00),
    "e_out_j_per_tok": (1.50, 0.50, 5.00),
    "cache_factor": (0.25, 0.10, 0.50),
    "pue": (1.20, 1.10, 1.50),
    "water_l_per_kwh": (1.00, 0.30, 2.00),
    "grid_kg_per_kwh": (0.20, 0.05, 0.40),
    "embodied_uplift": (0.00, 0.00, 0.30),
}
LEVELS = ("point", "low", "high")
# Everyday equivalents, with the measure each belongs to and how much of it one takes (Wh, ml, g).
EQUIVALENTS = {"phone charges": ("kwh", 10.0), "kettles boiled": ("kwh", 100.0), "web searches": ("kwh", 0.3), "cups of water": ("water_l", 250.0), "km driven": ("co2_kg", 120.0)}


def usage(payload: Column) -> list[Column]:
    """Total, hit, miss and output tokens of a usage payload in either shape.

    A payload with ``prompt_tokens`` gives the total and maybe the miss; one with ``input_tokens``
    gives fresh tokens, to which those that wrote the cache are added as misses. Missing hits are 0.
    Without output tokens, and for bad JSON, all four are null.
    """
    get = lambda *paths: F.coalesce(*[F.get_json_object(payload, f"$.{p}").cast("double").cast("long") for p in paths])
    out = get("output_tokens", "completion_tokens")
    hit = F.coalesce(get("prompt_cache_hit_tokens", "cache_read_input_tokens"), F.lit(0))
    prompt, fresh = get("prompt_tokens"), get("input_tokens")
    miss = F.coalesce(get("prompt_cache_miss_tokens"), fresh + F.coalesce(get("cache_creation_input_tokens"), F.lit(0)), F.greatest(prompt - hit, F.lit(0)), F.lit(0))
    total = F.coalesce(prompt, miss + hit)
    return [F.when(out.isNotNull(), c).alias(name) for name, c in (("total", total), ("hit", hit), ("miss", miss), ("out", out))]


def is_peak(ts: Column, bitmap: str) -> Column:
    """Bit of the hour of the week; Monday 00 UTC is the first. Use a session in UTC."""
    if len(bitmap) != 168:
        raise ValueError("a week has 168 hours")
    return F.substring(F.lit(bitmap), F.weekday(ts) * 24 + F.hour(ts) + 1, F.lit(1)) == "1"


def call_cost(calls: DataFrame, grid: DataFrame) -> DataFrame:
    """``cost`` of each call by model and peak; a missing hit rate is the miss rate, no rates give null."""
    pick = lambda name: F.when(F.col("peak"), F.col(f"{name}_peak")).otherwise(F.col(f"{name}_off"))
    miss = pick("in_miss")
    total = F.col("miss") * miss + F.col("hit") * F.coalesce(pick("in_hit"), miss) + F.col("out") * pick("out")
    return calls.join(grid, "model", "left").withColumn("cost", total / 1e6).select(*calls.columns, "cost")


def footprint_at(total: Column, hit: Column, miss: Column, out: Column, level: int) -> dict[str, Column]:
    """kWh, litres and kg of CO2 of so many tokens, with the factors' point (0), low (1) or high (2) values.

    Tokens in without a split by the cache count as fresh.
    """
    f = {name: values[level] for name, values in FACTORS.items()}
    some = lambda c: F.coalesce(c, F.lit(0))
    fresh = F.when(some(hit) + some(miss) == 0, some(total)).otherwise(some(miss))
    joules = fresh * f["e_in_j_per_tok"] + some(hit) * f["e_in_j_per_tok"] * f["cache_factor"] + some(out) * f["e_out_j_per_tok"]
    kwh = joules * f["pue"] * (1 + f["embodied_uplift"]) / 3.6e6
    return {"kwh": kwh, "water_l": kwh * f["water_l_per_kwh"], "co2_kg": kwh * f["grid_kg_per_kwh"]}


def footprint(usage_rows: DataFrame) -> DataFrame:
    """``measure, level, amount`` of all tokens (``total, hit, miss, out``); zeros for an empty table."""
    sums = usage_rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "hit", "miss", "out")])
    cells = [F.struct(F.lit(measure).alias("measure"), F.lit(level).alias("level"), amount.alias("amount")) for k, level in enumerate(LEVELS) for measure, amount in footprint_at(*map(F.col, ("total", "hit", "miss", "out")), k).items()]
    return sums.select(F.inline(F.array(*cells)))


def equivalents(of_footprint: DataFrame) -> DataFrame:
    """``label, amount``: everyday equivalents of the point values of ``footprint``."""
    point = of_footprint.where("level = 'point'").groupBy().pivot("measure", ["kwh", "water_l", "co2_kg"]).agg(F.first("amount"))
    return point.select(F.inline(F.array(*[F.struct(F.lit(label).alias("label"), (F.col(measure) * 1000 / one).alias("amount")) for label, (measure, one) in EQUIVALENTS.items()])))


def footprint_summary(runs: DataFrame) -> DataFrame:
    """Runs by model (with provider), by phase and in all: sums, footprint of the point values, and averages, in one pass.

    ``runs`` has ``provider, model, phase, cost, total, hit, miss, out, pages, kept``. ``scope`` is
    model, phase or all; a missing provider, model or phase counts as ``?``. What cost money but
    has no tokens is ``untracked`` and stays out of the averages for a million tokens. Averages
    with nothing to divide by are null.
    """
    keyed = runs.withColumns({c: F.coalesce(c, F.lit("?")) for c in ("provider", "model", "phase")}).withColumn("tokens", F.coalesce("total", F.lit(0)) + F.coalesce("out", F.lit(0)))
    paid = F.coalesce("cost", F.lit(0.0))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "hit", "miss", "out", "tokens", "pages", "kept")]
    bare = (F.col("tokens") == 0) & (paid > 0)
    grouped = keyed.groupingSets([["provider", "model"], ["phase"], []], "provider", "model", "phase").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("runs"), F.sum(paid).alias("cost"), *sums,
        F.sum(F.when(F.col("tokens") > 0, paid).otherwise(0.0)).alias("metered_cost"), F.sum(F.when(bare, 1).otherwise(0)).alias("untracked_runs"), F.sum(F.when(bare, paid).otherwise(0.0)).alias("untracked_cost"),
    )
    point = footprint_at(*map(F.col, ("total", "hit", "miss", "out")), 0)
    by = lambda a, b: F.when(b > 0, a / b)
    mega = F.col("tokens") / 1e6
    scope = F.when(F.col("gid") == 1, "model").when(F.col("gid") == 6, "phase").otherwise("all")
    return grouped.select(
        scope.alias("scope"), "provider", "model", "phase", "runs", "cost", "total", "hit", "miss", "out", "pages", "kept", "metered_cost", "untracked_runs", "untracked_cost", *[c.alias(k) for k, c in point.items()],
        by(F.col("metered_cost"), mega).alias("cost_per_mtok"), *[by(c, mega).alias(f"{k}_per_mtok") for k, c in point.items()],
        by(F.col("cost"), F.col("pages")).alias("cost_per_page"), by(F.col("cost"), F.col("kept")).alias("cost_per_kept"), by(point["kwh"], F.col("pages")).alias("kwh_per_page"), by(point["co2_kg"] * 1000, F.col("pages")).alias("co2_g_per_page"),
        by(F.col("hit"), F.col("total")).alias("cached_share"), by(F.col("tokens"), F.col("pages")).alias("tokens_per_page"),
    )


def data_issues(runs: DataFrame) -> DataFrame:
    """``runs`` that cost money but have no tokens in or out, dearest first."""
    return runs.where((F.col("cost") > 0) & (F.coalesce("total", F.lit(0)) + F.coalesce("out", F.lit(0)) == 0)).orderBy(F.desc("cost"), "run_id")
