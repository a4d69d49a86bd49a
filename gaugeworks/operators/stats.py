"""Statistical inference: summaries, effects, intervals, permutation tests, corrections."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..status import q9, ratio, wilson
from .ordering import kept, running
from .replicates import Draws, number, replicate_sums, split_thresholds
from .selection import beside
from .selection import quantiles as order_quantiles

#: Rearrangements up to which a permutation test is exact.
EXACT_LIMIT = 50_000


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean, median, variance, std, se, min, max, status): sample moments; one value gives a location only."""
    v = F.col(value).cast("double")
    bad = F.count_if(F.isnan(v) | (F.abs(v) == float("inf")))
    agg = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.min(v).alias("lo"), F.max(v).alias("hi"), bad.alias("bad")
    )
    many = F.col("n") > 1
    agg = beside(agg, order_quantiles(df, value, {"median": 0.5}, by).drop("n"), by)
    return agg.select(
        *by, "n", q9("mean").alias("mean"), q9("median").alias("median"), q9(F.when(many, F.col("var"))).alias("variance"), q9(F.when(many, F.sqrt("var"))).alias("std"),
        q9(F.when(many, F.sqrt(ratio("var", "n")))).alias("se"), q9("lo").alias("min"), q9("hi").alias("max"),
        F.when((F.col("bad") > 0) | (F.col("n") == 0), "UNDEFINED").when(F.col("n") == 1, "INCONCLUSIVE").otherwise("OBSERVED").alias("status"),
    )


def moments(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, skewness, excess_kurtosis) of the population; null where the variance is 0."""
    v = F.col(value).cast("double")
    agg = df.groupBy(*by).agg(F.count(value).alias("n"), F.var_pop(v).alias("var"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    some = F.col("var") > 0
    return agg.select(*by, "n", q9(F.when(some, F.col("g1"))).alias("skewness"), q9(F.when(some, F.col("g2"))).alias("excess_kurtosis"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, r); null for fewer than two rows or a constant column."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = both.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return a.select(*by, "n", q9(F.when((F.col("n") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0), F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))))).alias("r"))


def unpaired_effect(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Effects of b against a: (n_a, n_b, difference, relative, cohen_d, hedges_g); zero denominators give null."""
    def side(g: str, f):
        return f(F.when(F.col(group) == g, F.col(value).cast("double")))

    agg = df.agg(*(side(g, f).alias(f"{k}_{i}") for i, g in (("a", a), ("b", b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    free = F.col("n_a") + F.col("n_b") - 2
    pooled = F.sqrt(F.try_divide((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b"), free))
    diff = F.col("m_b") - F.col("m_a")
    d = F.try_divide(diff, pooled)
    return agg.select(
        "n_a", "n_b", q9(diff).alias("difference"), q9(F.try_divide(diff, F.abs(F.col("m_a")))).alias("relative"), q9(d).alias("cohen_d"), q9(d * (1 - F.try_divide(F.lit(3.0), 4 * free - 1))).alias("hedges_g")
    )


def pair_up(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, x, y) of the keys that both sides hold; keys, never positions, make the pairs."""
    return a.select(key, F.col(value).cast("double").alias("x")).join(b.select(key, F.col(value).cast("double").alias("y")), key)


def unmatched_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, only_in): the symmetric difference of the keys."""
    one, two = a.select(key).distinct(), b.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("only_in", F.lit("a")).unionByName(two.join(one, key, "left_anti").withColumn("only_in", F.lit("b")))


def paired_effect(pairs: DataFrame) -> DataFrame:
    """(n, mean_difference, std_difference, dz) of y - x."""
    d = F.col("y") - F.col("x")
    a = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return a.select("n", q9("m").alias("mean_difference"), q9(F.when(F.col("n") > 1, F.col("s"))).alias("std_difference"), q9(F.when(F.col("n") > 1, F.try_divide(F.col("m"), F.col("s")))).alias("dz"))


def draw(seed: int, replicate: Column, index: Column, n: Column) -> Column:
    """A number from 0 to n - 1 from 60 bits of md5(seed:replicate:index): the same in every engine and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), index.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % n


def bootstrap_means(df: DataFrame, value: str, replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., replicate, mean): resampled means.

    Rows are numbered in order of value, by sums of range counts. Each number is
    drawn for each replicate; what meets in the join is, for each replicate and
    number, how often it was drawn.
    """
    values = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    rows = running(values, ["v"], {"i": F.lit(1).cast("long")}, by)
    size = rows.groupBy(*by).agg(F.count("*").alias("n"))  # a row a group
    places = rows.join(size, list(by)) if by else rows.crossJoin(F.broadcast(size))
    places = places.select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = places.select(*by, "n", "replicate", draw(seed, F.col("replicate"), F.col("i"), F.col("n")).alias("i")).groupBy(*by, "n", "replicate", "i").agg(F.count("*").alias("times"))
    joined = drawn.join(rows.select(*by, "i", "v"), [*by, "i"])
    return joined.groupBy(*by, "replicate").agg((F.sum(F.col("times") * F.col("v")) / F.first("n")).alias("mean"))


def bootstrap_interval(df: DataFrame, value: str, key: str, replicates: int = 200, seed: int = 7, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(by..., replicates, lower, upper): percentile interval of the mean, type-7 ends.

    Rows, told apart by key, are drawn Poisson(1) times in each replicate: one pass, without a shuffle of rows.
    Replicates that draw no row are left out; for a few values bootstrap_means draws exactly as many as there are.
    """
    tail = (1 - confidence) / 2
    rows = df.filter(F.col(value).isNotNull())
    sums = replicate_sums(rows, Draws("counts", seed, replicates), number(seed, F.col(key)), {"n": F.lit(1.0), "s": F.col(value)}, by)
    m = sums.filter("replicate > 0 and n > 0").withColumn("mean", F.col("s") / F.col("n"))
    return m.groupBy(*by).agg(F.count("*").alias("replicates"), q9(F.percentile("mean", F.lit(tail))).alias("lower"), q9(F.percentile("mean", F.lit(1 - tail))).alias("upper"))


def sign_flip_test(pairs: DataFrame, replicates: int = 999, seed: int = 11) -> DataFrame:
    """(n, observed, hits, replicates, p) of pairs(x, y): two-sided paired test by sign flips.

    With at most EXACT_LIMIT sign patterns all of them are tried and p = hits /
    patterns; with more, md5 draws `replicates` of them and p = (hits + 1) / (replicates + 1).
    Fewer than two pairs have no p.
    """
    rows = running(pairs.select("x", "y", (F.col("y") - F.col("x")).alias("d")), ["x", "y"], {"i": F.lit(1).cast("long")}).select("d", "i")
    observed = rows.agg(F.count("*").alias("n"), F.avg("d").alias("observed"), F.sum(F.abs("d")).alias("size"))
    n = observed.first()["n"]
    exact = 2 <= n and 2**n <= EXACT_LIMIT
    count = 2**n if exact else replicates
    flips = rows.select("d", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("replicate"), "i")
    sign = F.call_function("shiftright", F.col("replicate"), F.col("i").cast("int")) % 2 if exact else draw(seed, F.col("replicate"), F.col("i"), F.lit(2))
    means = flips.groupBy("replicate").agg(F.avg(F.col("d") * (1 - 2 * sign)).alias("m"))
    hit = F.abs("m") >= F.abs(F.col("observed")) - 1e-12 * F.greatest(F.lit(1.0), F.col("size"))
    hits = observed.join(means, F.lit(True), "left").groupBy("n", "observed").agg(F.count_if(hit).alias("hits"))  # the observed side is one row
    p = F.col("hits") / F.lit(float(count)) if exact else (F.col("hits") + 1) / F.lit(count + 1.0)
    return hits.select("n", q9("observed").alias("observed"), "hits", F.lit(count).alias("replicates"), q9(F.when(F.col("n") >= 2, p)).alias("p"))


def permutation_test(df: DataFrame, group: str, value: str, a: str, b: str, replicates: int = 999, seed: int = 13) -> DataFrame:
    """(n_a, n_b, observed, hits, replicates, p): two-sided test of mean(b) - mean(a) by exchanged labels.

    With at most EXACT_LIMIT splits of the pooled values all of them are tried
    and p = hits / splits. With more, each of `replicates` splits gives group b
    the n_b values of least draw (see replicates.py; the sums of all splits are one
    pass), and p = (hits + 1) / (replicates + 1). Fewer than two values in a group have no p.
    """
    values = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    rows = running(values, ["v", "g"], {"i": F.lit(1).cast("long")})
    side = lambda g, f: f(F.when(F.col("g") == g, F.col("v")))
    observed = rows.agg(side(a, F.count).alias("n_a"), side(b, F.count).alias("n_b"), (side(b, F.avg) - side(a, F.avg)).alias("observed"), F.sum("v").alias("total"))
    n_a, n_b = observed.select("n_a", "n_b").first()
    exact = min(n_a, n_b) >= 2 and n_a + n_b < 63 and math.comb(n_a + n_b, n_b) <= EXACT_LIMIT
    if exact:
        n = n_a + n_b
        masks = df.sparkSession.createDataFrame([(sum(1 << i for i in chosen),) for chosen in itertools.combinations(range(n), n_b)], "replicate long")  # at most EXACT_LIMIT
        inside = F.call_function("shiftright", F.col("replicate"), F.col("i").cast("int")) % 2 == 1
        sums = masks.join(F.broadcast(rows.select("i", "v")), F.lit(True)).groupBy("replicate").agg(F.sum(F.when(inside, F.col("v")).otherwise(0.0)).alias("sb"))
        count = math.comb(n, n_b)
    else:
        rows, x = kept(rows), number(seed, F.col("i"))
        draws = split_thresholds(rows, x, n_b, n_a + n_b, seed, replicates) if min(n_a, n_b) else Draws("split", seed, replicates, thresholds=[0] * replicates)
        sums = replicate_sums(rows, draws, x, {"sb": F.col("v")}, label=F.col("g") == b).filter("replicate > 0")
        count = replicates
    diff = F.col("sb") / F.col("n_b") - (F.col("total") - F.col("sb")) / F.col("n_a")
    hit = F.abs(diff) >= F.abs(F.col("observed")) - 1e-12 * F.greatest(F.lit(1.0), F.abs(F.col("observed")))
    hits = observed.join(sums, F.lit(True), "left").groupBy("n_a", "n_b", "observed").agg(F.count_if(hit).alias("hits"))
    p = F.col("hits") / F.lit(float(count)) if exact else (F.col("hits") + 1) / F.lit(count + 1.0)
    return hits.select("n_a", "n_b", q9("observed").alias("observed"), "hits", F.lit(count).alias("replicates"), q9(F.when(F.least("n_a", "n_b") >= 2, p)).alias("p"))


def proportion(df: DataFrame, success: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, k, p, lower, upper, warning) with the 95 % Wilson interval; fewer than ten rows are warned of."""
    a = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(success).alias("k"))
    low, high = wilson("k", "n")
    return a.select(*by, "n", "k", q9(ratio("k", "n")).alias("p"), q9(low).alias("lower"), q9(high).alias("upper"), (F.col("n") < 10).alias("warning"))


def bonferroni(df: DataFrame, family: Sequence[str], p: str = "p") -> DataFrame:
    """df with m (tests with a p-value in the family) and adjusted = min(1, p * m), null without p."""
    m = F.count(p).over(Window.partitionBy(*family))
    return df.withColumn("m", m).withColumn("adjusted", q9(F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("m")))))


def benjamini_hochberg(df: DataFrame, family: Sequence[str], key: str, p: str = "p") -> DataFrame:
    """df with m and adjusted: the least p * m / rank from the tail on. Rows without p stay, with no adjusted value."""
    w = Window.partitionBy(*family)
    ranked = df.withColumn("m", F.count(p).over(w)).withColumn("rank", F.row_number().over(Window.partitionBy(*family, F.col(p).isNull()).orderBy(p, key)))
    tail = Window.partitionBy(*family, F.col(p).isNull()).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    low = F.min(F.col(p) * F.col("m") / F.col("rank")).over(tail)
    return ranked.withColumn("adjusted", q9(F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), low)))).drop("rank")


def outliers(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """(by..., n, q1, q3, below, above): values beyond k interquartile ranges from the type-7 quartiles."""
    q = kept(order_quantiles(df, value, {"q1": 0.25, "q3": 0.75}, by).drop("n"))  # one row a group
    rows = df.join(q, list(by)) if by else df.crossJoin(F.broadcast(q))
    reach = k * (F.col("q3") - F.col("q1"))
    a = rows.groupBy(*by, "q1", "q3").agg(F.count(value).alias("n"), F.count_if(F.col(value) < F.col("q1") - reach).alias("below"), F.count_if(F.col(value) > F.col("q3") + reach).alias("above"))
    return a.select(*by, "n", q9("q1").alias("q1"), q9("q3").alias("q3"), "below", "above")


def mad_outliers(df: DataFrame, value: str, k: float = 3.5) -> DataFrame:
    """(n, median, mad, outliers): 0.6745 |x - median| / mad > k; none where the mad is 0."""
    med = kept(order_quantiles(df, value, {"median": 0.5}).select("median"))
    rows = df.select(value).crossJoin(F.broadcast(med)).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    mad = kept(order_quantiles(rows, "dev", {"mad": 0.5}).select("mad"))
    a = rows.crossJoin(F.broadcast(mad)).groupBy("median", "mad").agg(F.count(value).alias("n"), F.count_if((F.col("mad") > 0) & (0.6745 * F.col("dev") > k * F.col("mad"))).alias("outliers"))
    return a.select("n", q9("median").alias("median"), q9("mad").alias("mad"), "outliers")


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., q, value): type-7 quantiles."""
    a = order_quantiles(df, value, {f"q{k}": level for k, level in enumerate(at)}, by)
    return a.select(*by, F.inline(F.array(*[F.struct(F.lit(level).alias("q"), q9(f"q{k}").alias("value")) for k, level in enumerate(at)])))


def lag1(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, n, r1): lag-1 autocorrelation in order; null for fewer than three values or constant ones."""
    placed = running(df.select(by, order, F.col(value).cast("double").alias("v")), [order], {"i": F.lit(1).cast("long")}, [by])
    mean = kept(placed.groupBy(by).agg(F.avg("v").alias("m")))  # a row a group
    before = placed.select(by, (F.col("i") + 1).alias("i"), F.col("v").alias("prior"))
    rows = placed.join(before, [by, "i"], "left").join(mean, by)
    a = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum((F.col("v") - F.col("m")) * (F.col("prior") - F.col("m"))).alias("c"), F.sum(F.pow(F.col("v") - F.col("m"), 2)).alias("s"))
    return a.select(by, "n", q9(F.when((F.col("n") >= 3) & (F.col("s") > 0), F.try_divide("c", "s"))).alias("r1"))
