"""Intervals by resampling: paired and unpaired, percentile and bias-corrected, and what is decided from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..status import Z95, q9, ratio
from . import stats
from .replicates import Draws, number, order_statistics, ordered, replicate_sums

# Acklam's rational approximation of the normal quantile: fixed values.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
#: Terms of the series for the normal distribution function; enough for |x| < 6.
TERMS = 100


def normal_cdf(x: Column) -> Column:
    """Phi(x) = 1/2 + phi(x) (x + x^3/3 + x^5/(3*5) + ...)."""
    x = F.least(F.greatest(x, F.lit(-8.0)), F.lit(8.0))
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, add)["total"]
    return F.lit(0.5) + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series


def _poly(c: Sequence[float], x: Column) -> Column:
    out = F.lit(c[0])
    for v in c[1:]:
        out = out * x + F.lit(v)
    return out


def normal_quantile(p: Column) -> Column:
    """The inverse of Phi on (0, 1): a rational start and one step of third order."""
    r = (p - 0.5) * (p - 0.5)
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    low = _poly(_C, tail) / _poly(_D, tail)
    x = F.when(p < 0.02425, low).when(p > 1 - 0.02425, -low).otherwise((p - 0.5) * _poly(_A, r) / _poly(_B, r))
    u = (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def quantile_of(sorted_values: Column, level: Column) -> Column:
    """Type-7 quantile of a sorted array at a computed level."""
    at = level * (F.size(sorted_values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (at - low) * (b - a)


def bca_interval(df: DataFrame, value: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """(n, estimate, lower, upper, percentile_lower, percentile_upper, z0, acceleration, status): 95 % intervals of the mean.

    The jackknife of a mean needs no second pass: its deviations are those of the
    values over n - 1. The replicates' means, as many as asked for, are sorted in
    one array. Fewer than two values are INCONCLUSIVE; a constant column, and an
    estimate beyond all replicates, have no corrected interval (UNDEFINED).
    """
    means = stats.bootstrap_means(df, value, replicates, seed)
    v = F.col(value).cast("double")
    size = df.agg(F.count(value).alias("n"), F.avg(v).alias("m"))
    dev = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(size)).select((v - F.col("m")).alias("e"))  # size is one row
    cubes = dev.agg(F.sum(F.pow("e", F.lit(3))).alias("s3"), F.sum(F.pow("e", F.lit(2))).alias("s2"))
    draws = means.agg(F.sort_array(F.collect_list("mean")).alias("draws"))  # `replicates` values
    rows = size.crossJoin(cubes).crossJoin(draws)  # one row each
    return _corrected(rows)


def _corrected(rows: DataFrame) -> DataFrame:
    """Both intervals of rows(n, m, draws, a or s2 and s3): m the estimate, draws sorted, a the acceleration."""
    if "a" not in rows.columns:
        rows = rows.withColumn("a", F.try_divide(F.col("s3"), 6 * F.pow("s2", F.lit(1.5))))
    below = F.aggregate("draws", F.lit(0.0), lambda a, x: a + F.when(x < F.col("m") - 1e-12, 1.0).when(x <= F.col("m") + 1e-12, 0.5).otherwise(0.0))
    rows = rows.withColumn("p0", F.try_divide(below, F.size("draws")))
    inside = (F.col("p0") > 0) & (F.col("p0") < 1)
    rows = rows.withColumn("z0", F.when(inside, normal_quantile(F.col("p0"))))
    for name, z in (("low", -Z95), ("high", Z95)):
        rows = rows.withColumn(f"den_{name}", 1 - F.col("a") * (F.col("z0") + z))
        rows = rows.withColumn(name, F.when(F.col(f"den_{name}") > 0, normal_cdf(F.col("z0") + (F.col("z0") + z) / F.col(f"den_{name}"))))
    ok = (F.col("n") >= 2) & F.col("low").isNotNull() & F.col("high").isNotNull()
    some = F.col("n") >= 2
    return rows.select(
        "n", q9("m").alias("estimate"), q9(F.when(ok, quantile_of(F.col("draws"), F.col("low")))).alias("lower"), q9(F.when(ok, quantile_of(F.col("draws"), F.col("high")))).alias("upper"),
        q9(F.when(some, quantile_of(F.col("draws"), F.lit(0.025)))).alias("percentile_lower"), q9(F.when(some, quantile_of(F.col("draws"), F.lit(0.975)))).alias("percentile_upper"),
        q9("z0").alias("z0"), q9("a").alias("acceleration"), F.when(~some, "INCONCLUSIVE").when(ok, "DERIVED").otherwise("UNDEFINED").alias("status"),
    )


def unpaired_means(df: DataFrame, group: str, value: str, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): mean(b) - mean(a), each group resampled on its own."""
    side = lambda g, k, name: stats.bootstrap_means(df.filter(F.col(group) == g), value, replicates, k).withColumnRenamed("mean", name)
    return side(a, seed, "x").join(side(b, seed + 1, "y"), "replicate").select("replicate", (F.col("y") - F.col("x")).alias("mean"))


def compare_groups(df: DataFrame, group: str, value: str, a: str, b: str, replicates: int = 200, permutations: int = 199, seed: int = 7) -> DataFrame:
    """(n_a, n_b, mean_a, mean_b, difference, relative, cohen_d, hedges_g, p, lower, upper, status) of b against a.

    Effects, a permutation test and a bootstrap interval of the difference; the
    last two answer different questions and may disagree. Fewer than two values in a group are INCONCLUSIVE.
    """
    side = lambda g, f: f(F.when(F.col(group) == g, F.col(value).cast("double")))
    means = df.agg(side(a, F.avg).alias("mean_a"), side(b, F.avg).alias("mean_b"))
    effect = stats.unpaired_effect(df, group, value, a, b)
    test = stats.permutation_test(df, group, value, a, b, permutations, seed).select("p")
    m = unpaired_means(df, group, value, a, b, replicates, seed)
    interval = m.agg(F.percentile("mean", F.lit(0.025)).alias("lower"), F.percentile("mean", F.lit(0.975)).alias("upper"))  # `replicates` values
    row = means.crossJoin(effect).crossJoin(test).crossJoin(interval)  # one row each
    some = F.least("n_a", "n_b") >= 2
    return row.select(
        "n_a", "n_b", q9("mean_a").alias("mean_a"), q9("mean_b").alias("mean_b"), "difference", "relative", "cohen_d", "hedges_g", "p",
        q9(F.when(some, F.col("lower"))).alias("lower"), q9(F.when(some, F.col("upper"))).alias("upper"), F.when(some, "DERIVED").otherwise("INCONCLUSIVE").alias("status"),
    )


def trial_bootstrap(contrasts: DataFrame, value: str = "contrast", replicates: int = 200, seed: int = 17, minimum: int = 3) -> DataFrame:
    """(n, estimate, lower, upper, sign_fraction, bootstrap_p, status): whole trials are resampled, never their samples.

    The mean contrast of drawn trial keys is the contrast of the cells' means,
    as every cell takes the same keys. bootstrap_p inverts the interval, with one
    added to either tail; it is no exact test. Below `minimum` trials there is no interval.
    """
    means = stats.bootstrap_means(contrasts, value, replicates, seed)
    point = contrasts.agg(F.count(value).alias("n"), F.avg(value).alias("estimate"))
    rows = point.join(means, F.lit(True), "left")  # point is one row
    same = F.avg(F.when((F.col("mean") > 0) == (F.col("estimate") > 0), 1.0).otherwise(0.0))
    a = rows.groupBy("n", "estimate").agg(
        F.percentile("mean", F.lit(0.025)).alias("lower"), F.percentile("mean", F.lit(0.975)).alias("upper"), same.alias("same"),
        F.least(F.count_if(F.col("mean") <= 0), F.count_if(F.col("mean") >= 0)).alias("tail"), F.count("mean").alias("b"),
    )
    ok = F.col("n") >= minimum
    return a.select(
        "n", q9("estimate").alias("estimate"), q9(F.when(ok, F.col("lower"))).alias("lower"), q9(F.when(ok, F.col("upper"))).alias("upper"),
        q9(F.when(ok & (F.col("estimate") != 0), F.col("same"))).alias("sign_fraction"), q9(F.when(ok, F.least(F.lit(1.0), 2.0 * (F.col("tail") + 1) / (F.col("b") + 1)))).alias("bootstrap_p"),
        F.when(F.col("n") == 0, "UNDEFINED").when(ok, "COMPUTED").otherwise("INSUFFICIENT_DATA").alias("status"),
    )


def interaction_class(contrast: DataFrame, order_effect: DataFrame | None = None, contrast_ba: DataFrame | None = None, least_contrast: float = 0.0, least_sign: float = 0.9) -> DataFrame:
    """(class, excludes_zero, ba_excludes_zero, magnitude_met, order_excludes_zero): what trial_bootstrap results allow to say.

    contrast is that of the cells with A before B, contrast_ba that with B before A; without an order effect
    order plays no part. An order effect counts first: with either contrast's interval
    beyond zero the interaction depends on order, with neither it is only possible. Then it counts whether the contrast's interval excludes
    zero with a stable sign and enough magnitude. A threshold of 0 is no
    criterion of magnitude and never suffices alone.
    """
    out = lambda p: F.coalesce((F.col(f"{p}lower") > 0) | (F.col(f"{p}upper") < 0), F.lit(False))
    row = contrast  # one row each
    for prefix, other in (("o_", order_effect), ("ba_", contrast_ba)):
        if other is None:
            row = row.withColumns({f"{prefix}{c}": F.lit(None).cast("double") for c in ("estimate", "lower", "upper")})
        else:
            row = row.crossJoin(other.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("estimate", "lower", "upper")]))
    big = (F.abs("estimate") >= least_contrast) & (F.col("estimate") != 0)
    order_out = F.coalesce(out("o_") & (F.col("o_estimate") != 0) & (F.abs("o_estimate") >= least_contrast), F.lit(False))
    label = (
        F.when(F.col("estimate").isNull(), "UNDEFINED").when(F.col("status") != "COMPUTED", "INCONCLUSIVE").when(order_out & (out("") | out("ba_")), "ORDER_DEPENDENT_INTERACTION")
        .when(order_out, "POSSIBLE_INTERACTION").when(out("") & big & (F.col("sign_fraction") >= least_sign), "OBSERVED_INTERACTION")
        .when(out("") | (F.lit(least_contrast > 0) & big), "POSSIBLE_INTERACTION").otherwise("NO_EVIDENCE")
    )
    return row.select(label.alias("class"), out("").alias("excludes_zero"), out("ba_").alias("ba_excludes_zero"), F.coalesce(big, F.lit(False)).alias("magnitude_met"), order_out.alias("order_excludes_zero"))




def bootstrap_median(df: DataFrame, value: str, key: str, replicates: int = 200, seed: int = 41) -> DataFrame:
    """(n, estimate, lower, upper, percentile_lower, percentile_upper, z0, acceleration, status): 95 % intervals of the median.

    Rows are drawn Poisson(1) times in each replicate. A replicate's median is where its drawn counts pass half of
    their sum, found by sums over ranges and blocks of the ordered values (see replicates.order_statistics). Left out
    one by one, the values next to the middle give the acceleration: of an even number the two jackknife values are
    as often one as the other, of an odd number three occur. Fewer than two values are INCONCLUSIVE; where the jackknife is constant,
    or the estimate lies beyond all replicates, there is no corrected interval (UNDEFINED).
    """
    rows = ordered(df, value, number(seed, F.col(key)))
    half = F.floor(F.col("n") / 2)
    ranks = {"lo": F.floor((F.col("n") + 1) / 2), "hi": half + 1, "under": half, "over": F.when(F.col("n") >= 3, half + 2).otherwise(0)}
    found = order_statistics(rows, Draws("counts", seed, replicates), ranks).withColumn("median", (F.col("lo") + F.col("hi")) / 2)
    draws = found.filter("replicate > 0").agg(F.sort_array(F.collect_list("median")).alias("draws"))  # `replicates` values
    point = found.filter("replicate = 0").select(F.col("n"), F.col("median").alias("m"), "under", "hi", "over")
    times = F.col("n") / 2
    left, mid, right = (F.col("hi") + F.col("over")) / 2, (F.col("under") + F.col("over")) / 2, (F.col("under") + F.col("hi")) / 2
    parts = F.when(F.col("n") % 2 == 0, F.array(F.struct(F.col("hi").alias("v"), times.alias("c")), F.struct(F.col("under").alias("v"), times.alias("c")))).otherwise(
        F.array(F.struct(left.alias("v"), ((F.col("n") - 1) / 2).alias("c")), F.struct(mid.alias("v"), F.lit(1.0).alias("c")), F.struct(right.alias("v"), ((F.col("n") - 1) / 2).alias("c")))
    )
    total = lambda f: F.aggregate("jack", F.lit(0.0), lambda acc, j: acc + j["c"] * f(j["v"]))
    rows = point.withColumn("jack", parts).withColumn("mean", total(lambda v: v) / F.col("n"))
    rows = rows.withColumns({"s2": total(lambda v: F.pow(F.col("mean") - v, 2)), "s3": total(lambda v: F.pow(F.col("mean") - v, 3))})
    a = F.when(F.col("s2") > 1e-18 * F.greatest(F.lit(1e-300), F.pow("m", F.lit(2))), F.col("s3") / (6 * F.pow("s2", F.lit(1.5))))
    return _corrected(rows.withColumn("a", a).crossJoin(draws))  # one row each


def _resampled(metrics: DataFrame, names: Sequence[str], confidence: float, by: Sequence[str]) -> DataFrame:
    from .calibration import _intervals

    return _intervals(metrics, names, confidence, by).withColumnRenamed("measure", "metric")


def bootstrap_classification(df: DataFrame, key: str, replicates: int = 200, seed: int = 43, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, estimate, lower, upper, replicates, status) of accuracy, balanced accuracy, macro precision, recall and F1.

    All are read off the drawn counts of each pair of true and predicted label: one pass. Rates of a class without rows count as
    absent in balanced accuracy, as 0 in the macro means over the labels that occur in df.
    """
    both = df.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    rows = both.select(*by, F.col("y_true").cast("string").alias("t"), F.col("y_pred").cast("string").alias("p"), F.col(key).alias("__key"))
    cells = replicate_sums(rows, Draws("counts", seed, replicates), number(seed, F.col("__key")), {"n": F.lit(1.0)}, [*by, "t", "p"])
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0)
    sides = cells.select(*by, "replicate", F.inline(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("true"), F.lit(0.0).alias("said"), hit.alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0.0).alias("true"), F.col("n").alias("said"), F.lit(0.0).alias("hit")))))
    label = sides.groupBy(*by, "replicate", "label").agg(*[F.sum(c).alias(c) for c in ("true", "said", "hit")])
    recall, precision = ratio("hit", "true"), ratio("hit", "said")
    f1 = ratio(2 * F.col("hit"), F.col("true") + F.col("said"))
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    found = label.groupBy(*by, "replicate").agg(
        ratio(F.sum("hit"), F.sum("true")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), zero(precision).alias("macro_precision"), zero(recall).alias("macro_recall"), zero(f1).alias("macro_f1"),
    )
    return _resampled(found, ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1"), confidence, by)


def bootstrap_regression(df: DataFrame, key: str, replicates: int = 200, seed: int = 47, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, estimate, lower, upper, replicates, status) of mean absolute and squared error, its root and R²; R² is null where the drawn truths are constant."""
    t, e = F.col("y_true").cast("double"), F.col("y_pred").cast("double") - F.col("y_true").cast("double")
    rows = df.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    sums = replicate_sums(rows, Draws("counts", seed, replicates), number(seed, F.col(key)), {"n": F.lit(1.0), "a": F.abs(e), "s": e * e, "t": t, "tt": t * t}, by)
    spread = F.col("tt") - ratio(F.col("t") * F.col("t"), "n")
    found = sums.select(*by, "replicate", ratio("a", "n").alias("mae"), ratio("s", "n").alias("mse"), F.sqrt(ratio("s", "n")).alias("rmse"), F.when(spread > 1e-12 * F.col("tt"), 1 - ratio("s", spread)).alias("r2"))
    return _resampled(found, ("mae", "mse", "rmse", "r2"), confidence, by)
