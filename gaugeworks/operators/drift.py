"""Distribution shift between two sides or between windows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..status import finite, q9, ratio, wilson
from .ordering import kept, running
from .replicates import STRIP, Draws, number, replicate_sums, split_thresholds
from .stats import EXACT_LIMIT

#: Categories above which a categorical comparison is undefined.
MAX_CATEGORIES = 200


def _steps(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Both sides' distribution functions at each distinct value: (by..., v, next_v, fx, fy). Counts are aggregated before the windows."""
    clean = df.withColumn("v", finite(value)).filter("v is not null")
    counts = clean.groupBy(*by, "v").agg(F.count_if(F.col("side") == "reference").alias("x"), F.count_if(F.col("side") == "comparison").alias("y"))
    steps = running(counts, ["v"], {"cx": F.col("x"), "cy": F.col("y")}, by, following={"next_v": "v"})
    total = steps.groupBy(*by).agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))  # a row a group
    steps = steps.join(total, list(by)) if by else steps.crossJoin(F.broadcast(total))
    return steps.select(*by, "v", "next_v", ratio(F.col("cx") + F.col("x"), "nx").alias("fx"), ratio(F.col("cy") + F.col("y"), "ny").alias("fy"), "nx", "ny")


def numeric_shift(df: DataFrame, value: str, by: Sequence[str] = (), minimum: int = 10) -> DataFrame:
    """(by..., n_reference, n_comparison, ks, wasserstein, scaled_wasserstein, status) of df(side, value).

    ks is the largest gap of the distribution functions, wasserstein the area
    between them, scaled by the reference's sample deviation (null if that is 0).
    Nulls, NaN and infinities are left out.
    """
    clean = df.withColumn(value, finite(value))
    sd = clean.groupBy(*by).agg(F.stddev_samp(F.when(F.col("side") == "reference", F.col(value))).alias("sd"))
    gap = F.abs(F.col("fx") - F.col("fy"))
    a = _steps(df, value, by).groupBy(*by).agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.max(gap).alias("ks"), F.sum(gap * (F.col("next_v") - F.col("v"))).alias("w"))
    a = a.join(F.broadcast(sd), list(by)) if by else a.crossJoin(F.broadcast(sd))  # a row a group
    status = F.when((F.col("nx") == 0) | (F.col("ny") == 0), "UNDEFINED").when(F.least("nx", "ny") < minimum, "INSUFFICIENT_EVIDENCE").otherwise("DERIVED")
    return a.select(
        *by, F.col("nx").alias("n_reference"), F.col("ny").alias("n_comparison"), q9("ks").alias("ks"), q9("w").alias("wasserstein"),
        q9(F.when(F.col("sd") > 0, F.try_divide("w", "sd"))).alias("scaled_wasserstein"), status.alias("status"),
    )


def ecdf(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., v, reference, comparison): right-continuous distribution functions at each distinct value."""
    return _steps(df, value, by).select(*by, q9("v").alias("v"), q9("fx").alias("reference"), q9("fy").alias("comparison"))


def category_counts(df: DataFrame, category: str) -> DataFrame:
    """(category, x, y): counts of either side."""
    return df.filter(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(
        F.count_if(F.col("side") == "reference").alias("x"), F.count_if(F.col("side") == "comparison").alias("y")
    )


def categorical_shift(df: DataFrame, category: str) -> DataFrame:
    """(n_reference, n_comparison, categories, total_variation, jensen_shannon, status); base 2, between 0 and 1."""
    c = category_counts(df, category)
    total = c.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.count("*").alias("k"))
    p = c.crossJoin(F.broadcast(total)).select("nx", "ny", "k", ratio("x", "nx").alias("p"), ratio("y", "ny").alias("q"))  # the total is one row
    m = (F.col("p") + F.col("q")) / 2
    part = lambda u: F.when(u > 0, u * F.log2(u / m)).otherwise(0.0)
    a = p.groupBy("nx", "ny", "k").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("tv"), F.sum(part(F.col("p")) + part(F.col("q"))).alias("js"))
    ok = F.col("k") <= MAX_CATEGORIES
    return a.select(
        F.col("nx").alias("n_reference"), F.col("ny").alias("n_comparison"), F.col("k").alias("categories"), q9(F.when(ok, F.col("tv") / 2)).alias("total_variation"),
        q9(F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("js") / 2)))).alias("jensen_shannon"), F.when(ok, "DERIVED").otherwise("UNDEFINED").alias("status"),
    )


def category_table(df: DataFrame, category: str) -> DataFrame:
    """(category, x, y, p, q, difference, p_lower, p_upper, q_lower, q_upper, only_in)."""
    c = category_counts(df, category)
    everything = Window.partitionBy(F.lit(1))  # categories, not rows
    c = c.withColumn("nx", F.sum("x").over(everything)).withColumn("ny", F.sum("y").over(everything))
    pl, ph = wilson("x", "nx")
    ql, qh = wilson("y", "ny")
    p, q = ratio("x", "nx"), ratio("y", "ny")
    only = F.when(F.col("y") == 0, "reference").when(F.col("x") == 0, "comparison")
    return c.select("category", "x", "y", q9(p).alias("p"), q9(q).alias("q"), q9(q - p).alias("difference"), q9(pl).alias("p_lower"), q9(ph).alias("p_upper"), q9(ql).alias("q_lower"), q9(qh).alias("q_upper"), only.alias("only_in"))


def windows(spark, start: int, stop: int, width: int, step: int, reference: str = "PREVIOUS") -> DataFrame:
    """Rolling plan over a numeric key: (window, lo, hi, ref_lo, ref_hi, status), half-open; whole windows only are planned, a rest is PARTIAL_WINDOW.

    reference: FIXED compares with the first window, PREVIOUS with the one before, EXPANDING with all before.
    """
    n = F.col("window")
    plan = spark.range(0, max(1, -(-(stop - start) // step))).select(F.col("id").cast("int").alias("window"))
    plan = plan.withColumn("lo", F.lit(start) + n * step).withColumn("hi", F.col("lo") + width)
    ref = {"FIXED": (F.lit(start), F.lit(start + width)), "PREVIOUS": (F.col("lo") - step, F.col("lo") - step + width), "EXPANDING": (F.lit(start), F.col("lo"))}[reference]
    status = F.when(F.col("hi") > stop, "PARTIAL_WINDOW").when(n == 0, "NO_REFERENCE").otherwise("PLANNED")
    return plan.select("window", "lo", "hi", ref[0].cast("int").alias("ref_lo"), ref[1].cast("int").alias("ref_hi"), status.alias("status"))


def in_windows(rows: DataFrame, key: Column, plan: DataFrame, value: str) -> DataFrame:
    """(window, side, value): rows of each planned window and of its reference.

    The plan is a few hundred rows and is broadcast; rows are not compared with each other.
    """
    keyed = rows.select(key.alias("k"), F.col(value))
    p = F.broadcast(plan.filter("status = 'PLANNED'"))
    now = keyed.join(p, (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))).select("window", F.lit("comparison").alias("side"), value)
    ref = keyed.join(p, (F.col("k") >= F.col("ref_lo")) & (F.col("k") < F.col("ref_hi"))).select("window", F.lit("reference").alias("side"), value)
    return now.unionByName(ref)


def ordering_keys(df: DataFrame, key: str) -> DataFrame:
    """(bucket, n): valid, MISSING, NON_FINITE or INVALID text keys."""
    number = F.expr(f"try_cast({key} as double)")
    bucket = F.when(F.col(key).isNull() | (F.trim(key) == ""), "MISSING").when(number.isNull(), "INVALID").when(finite(number).isNull(), "NON_FINITE").otherwise("VALID")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def performance_shift(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., reference, comparison, difference, worse): accuracy of either side of a prediction frame with a side."""
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    a = df.groupBy(*by).agg(F.avg(F.when(F.col("side") == "reference", right)).alias("r"), F.avg(F.when(F.col("side") == "comparison", right)).alias("c"))
    return a.select(*by, q9("r").alias("reference"), q9("c").alias("comparison"), q9(F.col("c") - F.col("r")).alias("difference"), (F.col("c") < F.col("r")).alias("worse"))


def rearrangements(rows: DataFrame, n_a: int, n_b: int, replicates: int, seed: int) -> tuple[DataFrame, Draws, bool]:
    """rows(own, x, ...) with x fit for the draws, the draws, and whether they are all rearrangements.

    All of them are taken where there are at most EXACT_LIMIT, of fewer than 63 rows; else `replicates` are drawn, each
    giving the second group the n_b rows of least draw.
    """
    n = n_a + n_b
    if n < 63 and math.comb(n, n_b) <= EXACT_LIMIT:
        masks = [sum(1 << i for i in chosen) for chosen in itertools.combinations(range(n), n_b)]
        placed = rows.withColumn("x", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("x")) - 1).cast("long"))  # fewer than 63 rows
        return kept(placed), Draws("masks", seed, len(masks), masks=masks), True
    return rows, split_thresholds(rows, F.col("x"), n_b, n, seed, replicates), False


def _gaps(draws: Draws, n_a: int, n_b: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = draws.replicates + 1
        seen, drawn, first, last = 0, np.zeros(width, np.int64), None, None
        high, low, end = np.full(width, -np.inf), np.full(width, np.inf), np.zeros(width)
        for batch in batches:
            for k in range(0, len(batch), STRIP):
                part = batch.slice(k, STRIP)
                v = part.column("v").to_numpy()
                reached = drawn + np.cumsum(draws.matrix(part.column("x").to_numpy(), part.column("own").to_numpy(zero_copy_only=False)), axis=0)
                before = seen + np.arange(1, len(v) + 1)
                gap = reached / n_b - (before[:, None] - reached) / n_a
                if last is not None and v[0] != last:
                    high, low = np.maximum(high, end), np.minimum(low, end)
                steps = gap[np.flatnonzero(v[1:] != v[:-1])]
                if len(steps):
                    high, low = np.maximum(high, steps.max(0)), np.minimum(low, steps.min(0))
                first, last, end, seen, drawn = v[0] if first is None else first, v[-1], gap[-1], seen + len(v), reached[-1]
        if last is not None:
            arrays = [pa.array([x], pa.list_(pa.float64())) for x in (end, np.maximum(high, end), np.minimum(low, end))]
            yield pa.RecordBatch.from_arrays([pa.array([float(first)]), *arrays], names=["first", "total", "high", "low"])

    return run


def _verdict(stats: DataFrame, n_a: int, n_b: int, count: int, exact: bool) -> DataFrame:
    """(n_reference, n_comparison, statistic, hits, replicates, exact, p, status) of stats(replicate, s); 0 is the observed one."""
    observed = stats.filter("replicate = 0").select(F.col("s").alias("observed"))
    hits = stats.filter("replicate > 0").crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.count_if(F.col("s") >= F.col("observed") - 1e-12).alias("hits"))  # observed is one row
    p = F.col("hits") / F.lit(float(count)) if exact else (F.col("hits") + 1) / F.lit(count + 1.0)
    return hits.select(
        F.lit(n_a).cast("long").alias("n_reference"), F.lit(n_b).cast("long").alias("n_comparison"), q9("observed").alias("statistic"), F.col("hits").cast("long").alias("hits"),
        F.lit(count).alias("replicates"), F.lit(exact).alias("exact"), q9(p).alias("p"), F.lit("DERIVED").alias("status"),
    )


def _withheld(df: DataFrame, n_a: int, n_b: int) -> DataFrame:
    status = "UNDEFINED" if min(n_a, n_b) == 0 else "INSUFFICIENT_EVIDENCE"
    schema = "n_reference long, n_comparison long, statistic double, hits long, replicates int, exact boolean, p double, status string"
    return df.sparkSession.createDataFrame([(n_a, n_b, None, None, 0, False, None, status)], schema)


def _sides(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.count_if(~F.col("own")), F.count_if(F.col("own"))).first()
    return r[0], r[1]


def ks_permutation(df: DataFrame, value: str, key: str, replicates: int = 199, seed: int = 23, minimum: int = 10) -> DataFrame:
    """(n_reference, n_comparison, statistic, hits, replicates, exact, p, status): right-tailed permutation test of the largest gap of df(side, value, key).

    The values are sorted once, whatever the number of replicates: in each range of the order a task follows all
    replicates' gaps at once and gives their total, largest and least; what stands before a range is a sum of
    range totals. The key tells rows apart for the draws. Nulls, NaN and infinities are left out. No p with fewer than `minimum`
    values on a side, nor (UNDEFINED) without any. p is the share of all splits, if at most 50,000, else (hits + 1) / (replicates + 1).
    """
    rows = df.select((F.col("side") == "comparison").alias("own"), finite(value).alias("v"), number(seed, F.col(key)).alias("x")).filter("v is not null and own is not null")
    n_a, n_b = _sides(rows)
    if min(n_a, n_b) < max(1, minimum):
        return _withheld(df, n_a, n_b)
    rows, draws, exact = rearrangements(rows, n_a, n_b, replicates, seed)
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    arrays = "first double, total array<double>, high array<double>, low array<double>"
    ranges = rows.select("own", "v", "x").repartitionByRange(n, "v").sortWithinPartitions("v").mapInArrow(_gaps(draws, n_a, n_b), arrays)
    each = ranges.select("first", F.posexplode(F.arrays_zip("total", "high", "low")).alias("replicate", "z")).select("replicate", "first", "z.total", "z.high", "z.low")
    before = F.coalesce(F.sum("total").over(Window.partitionBy("replicate").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row for each range
    gap = F.greatest(F.abs(F.col("before") + F.col("high")), F.abs(F.col("before") + F.col("low")))
    stats = kept(each.withColumn("before", before).groupBy("replicate").agg(F.max(gap).alias("s")))
    return _verdict(stats, n_a, n_b, draws.replicates, exact)


def js_permutation(df: DataFrame, category: str, key: str, replicates: int = 199, seed: int = 23, minimum: int = 10) -> DataFrame:
    """The same columns for the Jensen-Shannon divergence (base 2) of categories: counts of all replicates are summed by category in one pass.

    Nulls are left out; more than MAX_CATEGORIES categories are UNDEFINED.
    """
    rows = df.select((F.col("side") == "comparison").alias("own"), F.col(category).cast("string").alias("category"), number(seed, F.col(key)).alias("x")).filter("category is not null and own is not null")
    n_a, n_b = _sides(rows)
    if min(n_a, n_b) < max(1, minimum):
        return _withheld(df, n_a, n_b)
    if rows.select("category").distinct().limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
        return _withheld(df, n_a, n_b).withColumn("status", F.lit("UNDEFINED"))
    rows, draws, exact = rearrangements(rows, n_a, n_b, replicates, seed)
    drawn = replicate_sums(rows, draws, F.col("x"), {"y": F.lit(1.0)}, ["category"], label=F.col("own"))
    total = rows.groupBy("category").agg(F.count("*").alias("c"))
    met = drawn.join(F.broadcast(total), "category")  # at most MAX_CATEGORIES rows
    size = F.sum("y").over(Window.partitionBy("replicate"))
    parts = met.withColumn("m", size).select("replicate", ratio(F.col("c") - F.col("y"), F.lit(n_a + n_b) - F.col("m")).alias("p"), ratio("y", "m").alias("q"))
    part = lambda u: F.when(u > 0, u * F.log2(2 * u / (F.col("p") + F.col("q")))).otherwise(0.0)
    js = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.sum(part(F.col("p"))) + F.sum(part(F.col("q")))) / 2))
    return _verdict(kept(parts.groupBy("replicate").agg(js.alias("s"))), n_a, n_b, draws.replicates, exact)


def shift_entries(df: DataFrame, order: Column, plan: DataFrame, numeric: Sequence[str], categorical: Sequence[str], minimum: int = 10) -> DataFrame:
    """(feature, kind, window, n_reference, n_comparison, excluded, ks, wasserstein, jensen_shannon, total_variation, status, reason): each feature in each planned window against its reference.

    Rows are cut into features once, and each says by two sets of bits in which windows it is compared and for which it is reference.
    Counts by feature, value and bits are summed before anything is repeated for a window; numbers and categories are then
    put in order together, in one sort. Values that are null, NaN or infinite are counted as excluded. A side without values is UNDEFINED, as are
    more than MAX_CATEGORIES categories; fewer than `minimum` values on a side are INSUFFICIENT_EVIDENCE, with their measures. At most 62 windows.
    """
    windows = plan.filter("status = 'PLANNED'").orderBy("window").collect()  # a plan
    if len(windows) > 62:
        raise ValueError("at most 62 windows")
    bit = lambda lo, hi: sum((F.when((order >= r[lo]) & (order < r[hi]), 1 << k).otherwise(0).cast("long") for k, r in enumerate(windows)), F.lit(0).cast("long"))
    cells = [F.struct(F.lit(c).alias("feature"), F.lit("NUMERIC").alias("kind"), finite(c).alias("v"), F.lit(None).cast("string").alias("category")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("feature"), F.lit("CATEGORICAL").alias("kind"), F.lit(None).cast("double").alias("v"), F.col(c).cast("string").alias("category")) for c in categorical]
    long = df.select(bit("lo", "hi").alias("now"), bit("ref_lo", "ref_hi").alias("ref"), F.inline(F.array(*cells))).filter("now != 0 or ref != 0")
    counts = long.groupBy("feature", "kind", "v", "category", "now", "ref").agg(F.count("*").alias("n"))
    inside = lambda mask, k: F.call_function("shiftright", F.col(mask), k).bitwiseAND(F.lit(1)) == 1
    each = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(len(windows), 1) - 1)))).filter(inside("now", F.col("k")) | inside("ref", F.col("k")))
    group = ["feature", "kind", "k"]
    x, y = F.sum(F.when(inside("ref", F.col("k")), F.col("n")).otherwise(0)), F.sum(F.when(inside("now", F.col("k")), F.col("n")).otherwise(0))
    values = kept(each.groupBy(*group, "v", "category").agg(x.alias("x"), y.alias("y")))
    bad = F.col("v").isNull() & F.col("category").isNull()
    good = F.when(bad, 0).otherwise(1)
    size = values.groupBy(*group).agg(F.sum(good * F.col("x")).alias("nx"), F.sum(good * F.col("y")).alias("ny"), F.sum(F.when(bad, F.col("x") + F.col("y")).otherwise(0)).alias("excluded"), F.count_if(~bad).alias("distinct"))
    steps = running(values.filter(~bad), ["v", "category"], {"cx": F.col("x"), "cy": F.col("y")}, group, following={"next_v": "v"})
    met = steps.join(kept(size), group)
    gap = F.abs(ratio(F.col("cx") + F.col("x"), "nx") - ratio(F.col("cy") + F.col("y"), "ny"))
    p, q = ratio("x", "nx"), ratio("y", "ny")
    part = lambda u: F.when(u > 0, u * F.log2(2 * u / (p + q))).otherwise(0.0)
    sums = met.groupBy(*group).agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next_v") - F.col("v"))).alias("w"), (F.sum(part(p) + part(q)) / 2).alias("js"), (F.sum(F.abs(p - q)) / 2).alias("tv"))
    found = size.join(sums, group, "left")
    numbers, none, many = F.col("kind") == "NUMERIC", F.least("nx", "ny") == 0, (F.col("kind") == "CATEGORICAL") & (F.col("distinct") > MAX_CATEGORIES)
    said = ~none & ~many
    status = F.when(none | many, "UNDEFINED").when(F.least("nx", "ny") < minimum, "INSUFFICIENT_EVIDENCE").otherwise("DERIVED")
    reason = F.when(none, "EMPTY_SIDE").when(many, "TOO_MANY_CATEGORIES").when(F.least("nx", "ny") < minimum, "FEW_VALUES")
    named = F.element_at(F.array(*[F.lit(r["window"]) for r in windows] or [F.lit(None).cast("int")]), F.col("k") + 1)
    return found.select(
        "feature", "kind", named.alias("window"), F.col("nx").alias("n_reference"), F.col("ny").alias("n_comparison"), "excluded",
        q9(F.when(said & numbers, F.col("ks"))).alias("ks"), q9(F.when(said & numbers, F.coalesce("w", F.lit(0.0)))).alias("wasserstein"),
        q9(F.when(said & ~numbers, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("js"))))).alias("jensen_shannon"), q9(F.when(said & ~numbers, F.col("tv"))).alias("total_variation"),
        status.alias("status"), reason.alias("reason"),
    )


def shift_family(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], method: str = "benjamini_hochberg", alpha: float = 0.05, replicates: int = 199, seed: int = 23, minimum: int = 10) -> DataFrame:
    """(feature, kind, statistic, p, m, adjusted, rejected, status) of df(side, key, features): a test for each feature, corrected as one family.

    Numbers are tested by the largest gap, categories by Jensen-Shannon divergence. Features without p stay, are not counted in m and have no adjusted p.
    """
    from .stats import benjamini_hochberg, bonferroni

    out = None
    for kind, test, names in (("NUMERIC", ks_permutation, numeric), ("CATEGORICAL", js_permutation, categorical)):
        for c in names:
            row = test(df, c, key, replicates, seed, minimum).select(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), "statistic", "p", "status")
            out = row if out is None else out.unionByName(row)
    corrected = bonferroni(out, []) if method == "bonferroni" else benjamini_hochberg(out, [], "feature")
    return corrected.select("feature", "kind", "statistic", "p", "m", "adjusted", (F.col("adjusted") <= alpha).alias("rejected"), "status")
