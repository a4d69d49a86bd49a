"""Two groups, two submissions, two faults: differences with intervals, tests in families, and what may be compared at all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..status import finite, q9, ratio, wilson
from . import stats
from .drift import _sides, rearrangements
from .ordering import kept
from .replicates import Draws, number, order_statistics, ordered, replicate_sums
from .resampling import _corrected
from .selection import quantiles

CORRECTIONS = ("none", "bonferroni", "benjamini_hochberg")


def corrected(df: DataFrame, family: Sequence[str], key: str, method: str, alpha: float) -> DataFrame:
    """df with m, adjusted and rejected: each family of p corrected by the named method. Rows without p stay and aren't counted in m; "none" decides nothing."""
    if method not in CORRECTIONS:
        raise ValueError(f"method must be one of {CORRECTIONS}")
    if method == "bonferroni":
        out = stats.bonferroni(df, family)
    else:
        out = stats.benjamini_hochberg(df, family, key)
    if method == "none":
        return out.withColumn("adjusted", F.col("p")).withColumn("rejected", F.lit(None).cast("boolean"))
    return out.withColumn("rejected", F.col("adjusted") <= alpha)


def _median_side(rows: DataFrame, draws: Draws) -> DataFrame:
    """(replicate, n, e, jack): the group's median in each replicate, and the values that it takes as one row after another is left out, with how often."""
    half = F.floor(F.col("n") / 2)
    ranks = {"lo": F.floor((F.col("n") + 1) / 2), "hi": half + 1, "under": half, "over": F.when(F.col("n") >= 3, half + 2).otherwise(0)}
    found = order_statistics(ordered(rows, "v", F.col("x")), draws, ranks)
    item = lambda v, c: F.struct(v.cast("double").alias("v"), c.cast("double").alias("c"))
    u, h, o, n = F.col("under"), F.col("hi"), F.col("over"), F.col("n")
    even = F.array(item(h, n / 2), item(u, n / 2))
    odd = F.array(item((h + o) / 2, (n - 1) / 2), item((u + o) / 2, F.lit(1.0)), item((u + h) / 2, (n - 1) / 2))
    return found.select("replicate", "n", ((F.col("lo") + F.col("hi")) / 2).alias("e"), F.when(n % 2 == 0, even).otherwise(odd).alias("jack"))


def difference_interval(df: DataFrame, group: str, value: str, key: str, a: str, b: str, estimator: str = "mean", replicates: int = 200, seed: int = 53) -> DataFrame:
    """(n_a, n_b, estimate, lower, upper, percentile_lower, percentile_upper, z0, acceleration, status): 95 % intervals of est(b) - est(a), est a mean or a median.

    Each group is drawn on its own, row by row and Poisson(1) times; the key tells a group's rows apart. The jackknife leaves out
    the rows of both groups one by one: for means its deviations follow from the values in a pass of sums, for medians from the values next to the
    middle. lower and upper are bias-corrected and accelerated. Nulls, NaN and infinities are left out. A group of fewer than two values is INCONCLUSIVE;
    where all replicates agree the interval is that point; a constant jackknife or an estimate beyond all replicates is UNDEFINED.
    """
    if estimator not in ("mean", "median"):
        raise ValueError("estimator must be mean or median")
    side = F.when(F.col(group) == a, False).when(F.col(group) == b, True)
    rows = df.select(side.alias("own"), finite(value).alias("v"), number(seed, F.col(group), F.col(key)).alias("x")).filter("own is not null and v is not null")
    draws = Draws("counts", seed, replicates)
    if estimator == "mean":
        sums = replicate_sums(rows, draws, F.col("x"), {"n": F.lit(1.0), "s": F.col("v")}, ["own"])
        each = kept(sums.select("own", "replicate", F.col("n").cast("long").alias("n"), ratio("s", "n").alias("e")))
        point = each.filter("replicate = 0").select("own", "n", F.col("e").alias("m"))
        off = rows.join(F.broadcast(point), "own").select((F.when(F.col("own"), 1.0).otherwise(-1.0) * F.try_divide(F.col("v") - F.col("m"), F.col("n") - 1)).alias("d"))  # a row for each group
        spread = off.agg(F.sum(F.pow("d", F.lit(2))).alias("s2"), F.sum(F.pow("d", F.lit(3))).alias("s3"))
    else:
        sides = [_median_side(rows.filter(F.col("own") == own), draws).withColumn("own", F.lit(own)) for own in (False, True)]
        each = kept(sides[0].unionByName(sides[1]))
        point = each.filter("replicate = 0").select("own", "n", F.col("e").alias("m"), "jack")
        sign = F.when(F.col("own"), 1.0).otherwise(-1.0)
        left = point.select(sign.alias("sign"), "m", F.inline("jack")).select((F.col("sign") * (F.col("v") - F.col("m"))).alias("t"), "c")  # three rows a group at most
        mean = left.agg(F.try_divide(F.sum(F.col("t") * F.col("c")), F.sum("c")).alias("bar"))
        power = lambda k: F.sum(F.col("c") * F.pow(F.col("bar") - F.col("t"), F.lit(k)))
        spread = left.crossJoin(F.broadcast(mean)).agg(power(2).alias("s2"), power(3).alias("s3"))
    wide = each.groupBy("replicate").agg(*[F.max(F.when(F.col("own") == own, F.col(c))).alias(f"{c}_{k}") for k, own in (("a", False), ("b", True)) for c in ("n", "e")])
    theta = F.col("e_b") - F.col("e_a")
    drawn = wide.filter("replicate > 0").agg(F.sort_array(F.collect_list(theta)).alias("draws"))  # `replicates` values
    now = wide.filter("replicate = 0").agg(F.coalesce(F.max("n_a"), F.lit(0)).alias("n_a"), F.coalesce(F.max("n_b"), F.lit(0)).alias("n_b"), F.max(theta).alias("m"))
    row = kept(now.crossJoin(spread).crossJoin(drawn))  # one row each
    flat = F.when(F.col("s2") <= 1e-18 * F.pow("m", F.lit(2)), None).otherwise(F.try_divide(F.col("s3"), 6 * F.pow("s2", F.lit(1.5))))
    out = _corrected(row.withColumn("n", F.least("n_a", "n_b")).withColumn("a", flat))
    head = row.select("n_a", "n_b", (F.array_min("draws") == F.array_max("draws")).alias("__one"), F.array_min("draws").alias("__v"))
    one = F.coalesce(F.col("__one") & (F.col("n") >= 2), F.lit(False))
    enough = F.when(F.col("n") >= 2, F.col("estimate"))
    return head.crossJoin(out).select(
        "n_a", "n_b", enough.alias("estimate"), F.when(one, q9("__v")).otherwise(F.col("lower")).alias("lower"), F.when(one, q9("__v")).otherwise(F.col("upper")).alias("upper"),
        "percentile_lower", "percentile_upper", "z0", "acceleration", F.when(one, "DERIVED").otherwise(F.col("status")).alias("status"),
    )


def compare_pairs(pairs: DataFrame, key: str, replicates: int = 200, flips: int = 999, seed: int = 59) -> DataFrame:
    """(n, mean_x, mean_y, mean_difference, std_difference, dz, p, lower, upper, status) of pairs(key, x, y): the paired comparison of y with x.

    Effects, a sign-flip test and a percentile interval of the mean difference; pairs are drawn Poisson(1) times, never their sides alone. Fewer than two pairs are
    INCONCLUSIVE. No correction for several comparisons is made here.
    """
    p = pairs.select(key, finite("x").alias("x"), finite("y").alias("y")).filter("x is not null and y is not null")
    effect = stats.paired_effect(p).crossJoin(p.agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")))
    test = stats.sign_flip_test(p.select("x", "y"), flips).select("p")
    sums = replicate_sums(p, Draws("counts", seed, replicates), number(seed, F.col(key)), {"n": F.lit(1.0), "s": F.col("y") - F.col("x")})
    interval = sums.filter("replicate > 0").agg(F.percentile(ratio("s", "n"), F.lit(0.025)).alias("low"), F.percentile(ratio("s", "n"), F.lit(0.975)).alias("high"))  # `replicates` values
    some = F.col("n") >= 2
    return effect.crossJoin(interval).join(test, F.lit(True), "left").select(  # one row each
        "n", q9("mean_x").alias("mean_x"), q9("mean_y").alias("mean_y"), "mean_difference", "std_difference", "dz", F.when(some, F.col("p")).alias("p"),
        q9(F.when(some, F.col("low"))).alias("lower"), q9(F.when(some, F.col("high"))).alias("upper"), F.when(some, "DERIVED").otherwise("INCONCLUSIVE").alias("status"),
    )


def group_comparison(
    df: DataFrame, group: str, reference: str, comparison: str, key: str, aspects: Mapping[str, Mapping[str, Column]],
    method: str = "benjamini_hochberg", alpha: float = 0.05, replicates: int = 199, seed: int = 61, minimum: int = 30,
) -> DataFrame:
    """(aspect, feature, n_reference, n_comparison, k_reference, k_comparison, rate_reference, rate_comparison, lower_*, upper_*, difference, p, m, adjusted, rejected, status).

    aspects[aspect][feature] is a boolean column, such as that the feature is missing or breaks its bounds; null counts as false. Rates have Wilson intervals, their
    difference a two-sided permutation test: all features take part in the same rearrangements of the rows, whose sums are one pass over df.
    Each aspect is a family of its own. A feature that neither group marks has no p unless the aspect is "missingness"; a group of fewer than `minimum` rows
    is INSUFFICIENT_EVIDENCE, with rates and without p, an empty one INCONCLUSIVE.
    """
    names = [(a, f) for a, features in aspects.items() for f in features]
    flags = {f"f{i}": F.coalesce(aspects[a][f], F.lit(False)).cast("double") for i, (a, f) in enumerate(names)}
    side = F.when(F.col(group) == reference, False).when(F.col(group) == comparison, True)
    rows = df.select(side.alias("own"), number(seed, F.col(key)).alias("x"), *[c.alias(k) for k, c in flags.items()]).filter("own is not null")
    n_a, n_b = _sides(rows)
    enough = min(n_a, n_b) >= max(1, minimum)
    draws, exact = Draws("split", seed, 0), False
    if enough:
        rows, draws, exact = rearrangements(rows, n_a, n_b, replicates, seed)
    sums = replicate_sums(rows, draws, F.col("x"), {"m": F.lit(1.0), **{k: F.col(k) for k in flags}}, label=F.col("own"))
    long = kept(sums.select("replicate", "m", F.inline(F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(f).alias("feature"), F.col(f"f{i}").alias("y")) for i, (a, f) in enumerate(names)]))))
    totals = rows.agg(*[F.sum(k).alias(k) for k in flags])
    totals = totals.select(F.inline(F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(f).alias("feature"), F.coalesce(F.col(f"f{i}"), F.lit(0.0)).alias("k")) for i, (a, f) in enumerate(names)])))
    met = totals.join(long, ["aspect", "feature"], "left")  # a row for each feature and replicate
    gap = ratio("y", "m") - ratio(F.col("k") - F.col("y"), F.lit(n_a + n_b) - F.col("m"))
    met = met.withColumn("gap", gap)
    one = met.groupBy("aspect", "feature", "k").agg(F.max(F.when(F.col("replicate") == 0, F.col("y"))).alias("kc"), F.max(F.when(F.col("replicate") == 0, F.col("gap"))).alias("observed"), F.collect_list(F.when(F.col("replicate") > 0, F.abs("gap"))).alias("gaps"))  # `replicates` values
    hits = F.size(F.filter("gaps", lambda g: g >= F.abs("observed") - 1e-12))
    count = float(draws.replicates)
    p = F.when(F.lit(enough) & ((F.col("k") > 0) | (F.col("aspect") == "missingness")), hits / F.lit(max(count, 1.0)) if exact else (hits + 1) / F.lit(count + 1))
    kc, nr, nc = F.coalesce("kc", F.lit(0.0)), F.lit(n_a).cast("long"), F.lit(n_b).cast("long")
    kr = F.col("k") - kc
    (rl, ru), (cl, cu) = wilson(kr, nr), wilson(kc, nc)
    status = "INCONCLUSIVE" if min(n_a, n_b) == 0 else "DERIVED" if enough else "INSUFFICIENT_EVIDENCE"
    out = one.select(
        "aspect", "feature", nr.alias("n_reference"), nc.alias("n_comparison"), kr.cast("long").alias("k_reference"), kc.cast("long").alias("k_comparison"), q9(ratio(kr, nr)).alias("rate_reference"), q9(ratio(kc, nc)).alias("rate_comparison"),
        q9(rl).alias("lower_reference"), q9(ru).alias("upper_reference"), q9(cl).alias("lower_comparison"), q9(cu).alias("upper_comparison"), q9("observed").alias("difference"), q9(p).alias("p"), F.lit(status).alias("status"),
    )
    return corrected(out, ["aspect"], "feature", method, alpha)


def paired_family(df: DataFrame, by: str, key: str, difference: Column, method: str = "benjamini_hochberg", alpha: float = 0.05, replicates: int = 999, seed: int = 67) -> DataFrame:
    """(by, n, mean_difference, hits, p, m, adjusted, rejected): a sign-flip test for each group of df, corrected as one named family.

    All replicates of all groups are summed in one pass over df. p = (hits + 1) / (replicates + 1); groups of fewer than two differences have none.
    """
    rows = df.select(by, F.col(key).alias("__k"), finite(difference).alias("d")).filter("d is not null")
    drawn = replicate_sums(rows, Draws("swap", seed, replicates), number(seed, F.col("__k")), {"s": F.col("d")}, [by], label=F.lit(False))
    size = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.sum(F.abs("d")).alias("size"))
    met = size.join(drawn.filter("replicate > 0"), by)
    far = F.abs(F.col("total") - 2 * F.col("s")) >= F.abs("total") - 1e-12 * F.greatest(F.lit(1.0), F.col("size"))
    each = met.groupBy(by, "n", "total").agg(F.count_if(far).alias("hits"))
    out = each.select(by, "n", q9(ratio("total", "n")).alias("mean_difference"), "hits", q9(F.when(F.col("n") >= 2, (F.col("hits") + 1) / F.lit(replicates + 1.0))).alias("p"))
    return corrected(out, [], by, method, alpha)


def compare_submissions(protocols: DataFrame, results: DataFrame, pairs: DataFrame, free: Sequence[str] = ("model",)) -> DataFrame:
    """(a, b, section, key, value_a, value_b, difference, status): results of pairs(a, b) side by side, where one protocol made both.

    protocols(submission, field, value) and results(submission, section, key, value) have a row for each field and measure. A pair whose protocols differ
    in a field that isn't `free`, or that only one of them has, is refused: it gives a row of section "protocol" for each such field, with PROTOCOL_DIFFERS and no value. Other pairs give each
    measure that either has: b - a with BOTH, null with ONLY_A and ONLY_B. Nothing is ranked. A submission that nobody knows has no fields and no results.
    """
    which = ["a", "b"]

    def side(frame: DataFrame, name: str, value: str) -> DataFrame:
        mine = frame.withColumnRenamed("submission", name).withColumnRenamed("value", value).withColumn(f"__{name}", F.lit(True))
        return pairs.select(*which).distinct().join(mine, name)

    fields = protocols.filter(~F.col("field").isin(*free)).select("submission", "field", "value")
    met = side(fields, "a", "x").join(side(fields, "b", "y"), [*which, "field"], "full")
    issues = kept(met.filter(~F.col("x").eqNullSafe(F.col("y")) | F.col("__a").isNull() | F.col("__b").isNull()).select(*which, "field").distinct())
    fair = results.select("submission", "section", "key", F.col("value").cast("double").alias("value"))
    both = side(fair, "a", "value_a").join(side(fair, "b", "value_b"), [*which, "section", "key"], "full").join(issues.select(*which).distinct(), which, "left_anti")
    status = F.when(F.col("__a").isNull(), "ONLY_B").when(F.col("__b").isNull(), "ONLY_A").otherwise("BOTH")
    shown = both.select(*which, "section", "key", q9("value_a").alias("value_a"), q9("value_b").alias("value_b"), q9(F.col("value_b") - F.col("value_a")).alias("difference"), status.alias("status"))
    none = F.lit(None).cast("double")
    refused = issues.select(*which, F.lit("protocol").alias("section"), F.col("field").alias("key"), none.alias("value_a"), none.alias("value_b"), none.alias("difference"), F.lit("PROTOCOL_DIFFERS").alias("status"))
    return shown.unionByName(refused)


def additive_description(trials: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(metric, n_a, n_b, n_ab, effect_a, effect_b, effect_ab, additive_reference, difference_from_additive) of trials(cell, key, metrics).

    An effect is the mean change against CONTROL over the keys that both cells hold; the sum of the two alone is a point of
    comparison, no hypothesis, and the description claims no interaction. Missing effects leave what rests on them null.
    """
    long = trials.select("cell", F.col(key).alias("__k"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    cells = {"c": "CONTROL", "a": "A", "b": "B", "ab": "AB"}
    wide = long.groupBy("metric", "__k").agg(*[F.avg(F.when(F.col("cell") == c, F.col("v"))).alias(k) for k, c in cells.items()])
    change = lambda k: F.col(k) - F.col("c")
    out = wide.groupBy("metric").agg(*[f(change(k)).alias(f"{n}_{k}") for k in ("a", "b", "ab") for n, f in (("n", F.count), ("effect", F.avg))])
    reference = F.col("effect_a") + F.col("effect_b")
    return out.select(
        "metric", "n_a", "n_b", "n_ab", *[q9(f"effect_{k}").alias(f"effect_{k}") for k in ("a", "b", "ab")], q9(reference).alias("additive_reference"), q9(F.col("effect_ab") - reference).alias("difference_from_additive"),
    )


def phase_resources(df: DataFrame, by: Sequence[str], phase: str, state: str, value: str, percentiles: Mapping[str, float]) -> DataFrame:
    """(by..., n_trials, n_warm_up, n_failed, n, mean, std, cv, a column for each percentile, throughput, status): seconds of trials that were measured and completed.

    Trials of the phase WARM_UP are counted and left out; so are those that aren't COMPLETED and those without a finite, non-negative value. Percentiles are of type 7.
    Throughput is n over the sum of seconds. A group without such trials is UNAVAILABLE, one trial has no spread (INCONCLUSIVE).
    """
    v = finite(value)
    warm, done = F.coalesce(F.col(phase) == "WARM_UP", F.lit(False)), F.coalesce(F.col(state) == "COMPLETED", F.lit(False))
    good = F.when(~warm & done & (v >= 0), v)
    rows = df.select(*by, warm.alias("__w"), (~warm & ~done).alias("__f"), good.alias("__v"))
    a = rows.groupBy(*by).agg(F.count("*").alias("n_trials"), F.count_if("__w").alias("n_warm_up"), F.count_if("__f").alias("n_failed"), F.count("__v").alias("n"), F.avg("__v").alias("__m"), F.stddev_samp("__v").alias("__s"), F.sum("__v").alias("__t"))
    q = quantiles(rows, "__v", percentiles, by).drop("n")
    met = a.alias("a").join(q.alias("q"), [F.col(f"a.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by], "left").drop(*[F.col(f"q.{c}") for c in by])
    return met.select(
        *by, "n_trials", "n_warm_up", "n_failed", "n", q9("__m").alias("mean"), q9("__s").alias("std"), q9(ratio("__s", "__m")).alias("cv"), *[q9(c).alias(c) for c in percentiles],
        q9(ratio("n", "__t")).alias("throughput"), F.when(F.col("n") == 0, "UNAVAILABLE").when(F.col("n") == 1, "INCONCLUSIVE").otherwise("DERIVED").alias("status"),
    )
