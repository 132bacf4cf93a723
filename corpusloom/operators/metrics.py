"""Quality of verdicts against gold labels, and their stability over repeats."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.replies import let
from corpusloom.sources.scratch import cut

#: How borderline pages count: left out, in, or out.
BOUNDS = ("exclude", "in", "out")


def _flag(c: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, weight).otherwise(0)), F.lit(0))


def confusion(gold: DataFrame, verdicts: DataFrame, weight: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, n and unparsed for each bound, all weighted; a missing or unparsed verdict counts as a drop."""
    met = gold.join(verdicts.select("url", "keep"), "url", "left")
    w = F.col(weight) if weight else F.lit(1)
    kept = F.coalesce(F.col("keep") == 1, F.lit(False))
    used = bounded(met)
    return used.groupBy("bound").agg(
        _flag(F.col("truth") & kept, w).alias("tp"), _flag(~F.col("truth") & kept, w).alias("fp"), _flag(F.col("truth") & ~kept, w).alias("fn"), _flag(~F.col("truth") & ~kept, w).alias("tn"),
        _flag(F.lit(True), w).alias("n"), _flag(F.col("keep").isNull(), w).alias("unparsed"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, specificity, accuracy and F1; null for an empty denominator."""
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def rates_by_repeat(gold: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rates of each repeat, of their majority verdict, and of all counts together (micro), by bound: ``arm`` is the run's id, majority or micro.

    ``repeats`` has ``run_id, url, keep``. A page that a repeat lacks counts as a drop in it.
    """
    names = repeats.select(F.col("run_id").cast("string").alias("arm")).distinct()
    asked = gold.select("url", "label").crossJoin(F.broadcast(names))
    met = asked.join(repeats.select("url", F.col("run_id").cast("string").alias("arm"), "keep"), ["url", "arm"], "left")
    vote = majority(repeats).select("url", F.lit("majority").alias("arm"), "keep")
    every = met.unionByName(gold.select("url", "label").join(vote, "url", "left").withColumn("arm", F.lit("majority")))
    kept = F.coalesce(F.col("keep") == 1, F.lit(False))
    used = bounded(every)
    one = lambda c: F.count(F.when(c, 1))
    counts = used.groupBy("arm", "bound").agg(one(F.col("truth") & kept).alias("tp"), one(~F.col("truth") & kept).alias("fp"), one(F.col("truth") & ~kept).alias("fn"), one(~F.col("truth") & ~kept).alias("tn"))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    micro = counts.where("arm <> 'majority'").groupBy("bound").agg(*sums).select(F.lit("micro").alias("arm"), "bound", "tp", "fp", "fn", "tn")
    return rates(counts.unionByName(micro))


def borderline_kept(gold: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``kept_share``: share of borderline pages that are kept; a missing verdict is a drop, no such page gives null."""
    met = gold.where("label = 'borderline'").join(verdicts.select("url", "keep"), "url", "left")
    return met.agg(F.avg(F.when(F.col("keep") == 1, 1.0).otherwise(0.0)).alias("kept_share"))


def bounded(gold: DataFrame) -> DataFrame:
    """Labelled pages under each bound: ``bound`` and ``truth`` beside the columns; borderline pages only where a bound counts them."""
    each = gold.withColumn("bound", F.explode(F.array(*map(F.lit, BOUNDS))))
    truth = F.when(F.col("label") == "borderline", F.when(F.col("bound") == "in", True).when(F.col("bound") == "out", False)).otherwise(F.col("label") == "in")
    return each.withColumn("truth", truth).where("truth IS NOT NULL")


def value_add(gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """What the second phase does to the first one's keeps, by bound.

    ``p1_keeps, p2_drops`` (a verdict of 0; an unparsed one drops nothing), ``fp_removed, tp_lost,
    net``, the share of drops that are right, and the share of all pages that belong in which are
    lost; null for no drops or no such pages.
    """
    met = bounded(gold.select("url", "label")).join(first.select("url", F.col("keep").alias("k1")), "url", "left").join(second.select("url", F.col("keep").alias("k2")), "url", "left")
    kept = F.coalesce(F.col("k1") == 1, F.lit(False))
    dropped = kept & F.coalesce(F.col("k2") == 0, F.lit(False))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    out = met.groupBy("bound").agg(n(kept, "p1_keeps"), n(dropped, "p2_drops"), n(dropped & ~F.col("truth"), "fp_removed"), n(dropped & F.col("truth"), "tp_lost"), n(F.col("truth"), "gold_in"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.select("bound", "p1_keeps", "p2_drops", "fp_removed", "tp_lost", (F.col("fp_removed") - F.col("tp_lost")).alias("net"), ratio(F.col("fp_removed"), F.col("fp_removed") + F.col("tp_lost")).alias("drop_precision"), ratio(F.col("tp_lost"), F.col("gold_in")).alias("lost_share"))


def keep_counts(repeats: DataFrame, n_repeats: int) -> DataFrame:
    """``url, keeps, drops``; a missing verdict is a drop."""
    kept = F.sum(F.when(F.col("keep") == 1, 1).otherwise(0))
    return repeats.groupBy("url").agg(kept.alias("keeps"), (F.lit(n_repeats) - kept).alias("drops"))


def stability(repeats: DataFrame, n_repeats: int) -> DataFrame:
    """``pages, flip_pages, unanimous``: pages, those with both verdicts over the repeats, and the share without."""
    flips = (F.col("keeps") > 0) & (F.col("drops") > 0)
    return keep_counts(repeats, n_repeats).agg(F.count(F.lit(1)).alias("pages"), F.sum(flips.cast("int")).alias("flip_pages"), F.avg((~flips).cast("int")).alias("unanimous"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Fleiss' kappa of ``ratings`` (``url, keep``) into keep and drop; an unparsed one is a drop.

    Null without pages, with one rating a page, or if pages have different numbers of ratings; 1
    where chance agreement is certain.
    """
    kept = F.count(F.when(F.col("keep") == 1, 1))
    per = ratings.groupBy("url").agg(F.count(F.lit(1)).alias("n"), kept.alias("k"))
    d = F.col("n") - F.col("k")
    got = per.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.avg((F.col("k") * F.col("k") + d * d - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("p"), F.avg(F.col("k") / F.col("n")).alias("q"))
    chance = F.col("q") * F.col("q") + (1 - F.col("q")) * (1 - F.col("q"))
    return got.select(F.when((F.col("low") == F.col("high")) & (F.col("low") >= 2), F.when(chance < 1, (F.col("p") - chance) / (1 - chance)).otherwise(1.0)).alias("kappa"))


def majority(repeats: DataFrame, n_repeats: int | None = None) -> DataFrame:
    """Verdict that half of ``n_repeats`` or more give to each page, a tie keeps; null where no repeat has a verdict.

    A repeat that lacks a page counts as a drop. ``n_repeats`` is the number of runs in ``repeats``
    if it is not given.
    """
    kept, known = F.sum(F.when(F.col("keep") == 1, 1).otherwise(0)), F.count("keep")
    votes = repeats.groupBy("url").agg(kept.alias("kept"), known.alias("known"))
    if n_repeats is None:
        votes = votes.crossJoin(F.broadcast(repeats.agg(F.countDistinct("run_id").alias("n"))))  # one row
    n = F.col("n") if n_repeats is None else F.lit(n_repeats)
    return votes.select("url", F.when(F.col("known") > 0, (2 * F.col("kept") >= n).cast("int")).alias("keep"))


def score_stability(repeats: DataFrame, band: Column, threshold: float = 0.15) -> DataFrame:
    """Over the pages with two scores or more: mean of their sample deviations, share over the threshold, share that stays in one band; null without such pages."""
    per = repeats.where("score IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("score").alias("sd"), F.countDistinct(band).alias("bands")).where("n >= 2")
    return per.agg(F.avg("sd").alias("mean_sd"), F.avg((F.col("sd") > threshold).cast("int")).alias("unstable"), F.avg((F.col("bands") == 1).cast("int")).alias("one_band"))


def calibration(gold: DataFrame, scores: DataFrame, band: Column, order: tuple[str, ...]) -> DataFrame:
    """``band, n, share_in`` over labelled pages, with ``monotone`` and ``brier`` of all beside each.

    ``band`` is over the column ``score``; pages without a score are in its band for none, and out
    of the Brier score. ``monotone``: the shares never fall along the bands of ``order``; null with
    fewer than two of them. Borderline pages are left out; no pages give no rows.
    """
    met = gold.where("label <> 'borderline'").join(scores.select("url", "score"), "url", "left")
    truth = (F.col("label") == "in").cast("double")
    table = met.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(truth).alias("share_in"), F.sum(F.pow(F.col("score") - truth, F.lit(2.0))).alias("squares"), F.count("score").alias("scored"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("band"))
    shares = F.transform(F.array_sort(F.collect_list(F.when(rank > 0, F.struct(rank.alias("r"), "share_in")))), lambda x: x["share_in"])
    whole = table.agg(shares.alias("s"), (F.sum("squares") / F.nullif(F.sum("scored"), F.lit(0))).alias("brier"))
    steps = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i) <= F.element_at("s", i + 1))
    flag = whole.select(F.when(F.size("s") > 1, steps).alias("monotone"), "brier")
    return table.select("band", "n", "share_in").crossJoin(F.broadcast(flag))


def mcnemar(gold: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages that only one of two verdict sets gets right, and the exact two-sided p; null without any."""
    right = lambda keep: (F.coalesce(F.col(keep) == 1, F.lit(False))) == (F.col("label") == "in")
    met = gold.where("label <> 'borderline'").join(a.select("url", F.col("keep").alias("ka")), "url", "left").join(b.select("url", F.col("keep").alias("kb")), "url", "left")
    counts = met.agg(_flag(right("ka") & ~right("kb"), F.lit(1)).alias("only_a"), _flag(~right("ka") & right("kb"), F.lit(1)).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # Each term follows from the one before it, so the tail takes one pass; in logarithms, as 2^-n vanishes.
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    places = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(places, start, step, lambda s: s["sum"])
    return counts.withColumn("p", F.when(n > 0, F.least(F.lit(1.0), 2 * tail)))


def cohen_kappa(a: DataFrame, b: DataFrame) -> DataFrame:
    """Kappa of keep against drop over the pages of both, and Cohen's h of their keep shares, negative where the second keeps more."""
    x, y = F.coalesce(F.col("ka") == 1, F.lit(False)).cast("int"), F.coalesce(F.col("kb") == 1, F.lit(False)).cast("int")
    met = a.select("url", F.col("keep").alias("ka")).join(b.select("url", F.col("keep").alias("kb")), "url")
    per = met.agg(F.avg((x == y).cast("int")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    h = 2 * F.asin(F.sqrt("pa")) - 2 * F.asin(F.sqrt("pb"))
    return per.select("po", F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).otherwise(1.0).alias("kappa"), h.alias("h"))


def latency(results: DataFrame, column: str = "ms") -> DataFrame:
    """Exact interpolated p50 and p90 by run."""
    return results.groupBy("run_id").agg(F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.9).alias("p90"))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, brought back by the eight factors between; right to about 1e-13."""
    product = reduce(lambda a, b: a * b, [n.cast("double") + k for k in range(1, 9)])
    series = lambda x: (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return let(n.cast("double") + 8, series) - F.log(product)


def binomial_draw(u: Column, n: Column, p: Column) -> Column:
    """The least k whose chance of k or fewer of ``n`` events of chance ``p`` exceeds ``u`` (0 to 1).

    Chances are summed from 8 deviations below the mean to 8 above, so the work grows with the root
    of n; what lies outside is less than a double can show.
    """

    def drawn(x: Column) -> Column:
        """``x``: u, n, p, and the least and largest k that are tried."""
        u, n, p, low, high = (x[k] for k in ("u", "n", "p", "low", "high"))
        first = F.exp(_log_factorial(n) - _log_factorial(low) - _log_factorial(n - low) + low * F.log(p) + (n - low) * F.log(1 - p))
        start = let(first, lambda f: F.struct(f.alias("chance"), f.alias("sum"), low.alias("k")))

        def step(s: Column, k: Column) -> Column:
            chance = s["chance"] * (n - k + 1) / k * (p / (1 - p))
            return let(chance, lambda c: F.struct(c.alias("chance"), (s["sum"] + c).alias("sum"), F.when(s["sum"] <= u, k).otherwise(s["k"]).alias("k")))

        places = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(places, start, step, lambda s: s["k"])

    mean, width = n * p, 8 * F.sqrt(n * p * (1 - p)) + 8
    made = F.struct(u.alias("u"), n.alias("n"), p.alias("p"), F.greatest(F.lit(0).cast("bigint"), F.floor(mean - width).cast("bigint")).alias("low"), F.least(n, F.ceil(mean + width).cast("bigint")).alias("high"))
    return F.when((n <= 0) | (p <= 0), F.lit(0).cast("bigint")).when(p >= 1, n).otherwise(let(made, drawn))


#: Resamples and seed that are reported.
RESAMPLES, SEED = 2000, 20260924
#: Cells of a page: whether it belongs, and whether each side kept it.
CELLS = [(t, a, b) for t in (1, 0) for a in (1, 0) for b in (1, 0)]


def bootstrap(gold: DataFrame, verdicts: DataFrame, other: DataFrame | None = None, metric: str = "recall", repeats: int = RESAMPLES, seed: int = SEED, bound: str = "exclude") -> DataFrame:
    """``point, low, high, draws`` of a metric of ``rates`` under a bound, or of its difference to that of ``other``, by resampling pages with replacement.

    A metric depends only on how many pages are in each of eight cells, and a resample of n pages
    has multinomial counts of them. These are drawn cell by cell as binomials from md5 of seed,
    resample and cell: pages are counted once, and the resamples cost the same however many there
    are (up to the root of their number). low and high are the values at 2.5 and 97.5 % of the
    sorted resamples in which the metric is defined; null without any. A missing verdict is a drop.
    """
    met = bounded(gold.select("url", "label")).where(F.col("bound") == bound).join(verdicts.select("url", F.col("keep").alias("ka")), "url", "left")
    met = met.join((verdicts if other is None else other).select("url", F.col("keep").alias("kb")), "url", "left")
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")
    met = met.select(F.col("truth").cast("int").alias("t"), flag("ka").alias("a"), flag("kb").alias("b"))
    n = lambda t, a, b: F.count(F.when((F.col("t") == t) & (F.col("a") == a) & (F.col("b") == b), 1))
    counts = met.agg(F.array(*[n(*c) for c in CELLS]).alias("n"))
    # Resample 0 is the table itself.
    rows = counts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats)))).repartition("rep")
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b)

    def draw(s: Column, i: Column) -> Column:
        """The draws of cell ``i`` among what is left of the resample, by its share of what is left of the pages."""
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
        pages = F.try_element_at(F.col("n"), i + 1)
        p = F.coalesce(pages / F.nullif(s["open"].cast("double"), F.lit(0.0)), F.lit(0.0))
        taken = let(F.struct(u.alias("u"), p.alias("p")), lambda x: binomial_draw(x["u"], s["left"], x["p"]))
        return let(taken, lambda k: F.struct((s["left"] - k).alias("left"), (s["open"] - pages).alias("open"), F.concat(s["c"], F.array(k)).alias("c")))

    start = F.struct(total.alias("left"), total.alias("open"), F.array().cast("array<bigint>").alias("c"))
    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(len(CELLS) - 1)), start, draw, lambda s: s["c"])
    rows = cut(rows.select("rep", F.when(F.col("rep") == 0, F.col("n")).otherwise(drawn).alias("c")))

    def value(side: int) -> Column:
        cell = lambda t, k: sum((F.col("c")[i] for i, c in enumerate(CELLS) if c[0] == t and c[1 + side] == k), F.lit(0))
        return F.struct(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))

    def of(side: int) -> DataFrame:
        return rates(rows.select("rep", value(side).alias("v")).select("rep", "v.*")).select("rep", F.col(metric).alias(f"m{side}"))

    found = of(0) if other is None else of(0).join(of(1), "rep").withColumn("m0", F.col("m0") - F.col("m1"))
    got = found.agg(F.max(F.when(F.col("rep") == 0, F.col("m0"))).alias("point"), F.array_sort(F.collect_list(F.when(F.col("rep") > 0, F.col("m0")))).alias("all"))
    at = lambda share: F.try_element_at("all", (F.floor(F.lit(share) * (F.size("all") - 1)) + 1).cast("int"))
    return got.select("point", F.when(F.size("all") > 0, at(0.025)).alias("low"), F.when(F.size("all") > 0, at(0.975)).alias("high"), F.size("all").alias("draws"))
