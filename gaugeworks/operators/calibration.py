"""Probability calibration: validity, reliability curves, class-wise measures, calibrators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..status import q9, ratio, wilson
from .ordering import kept, running
from .replicates import STRIP, Draws, number, order_statistics, ordered, replicate_sums, split_thresholds
from .selection import nearest_ranks


def validity(scores: Column, y_true: Column, y_pred: Column, classes: Sequence[str]) -> Column:
    """Reason why a row can't be used, or OK; the first that applies, in a fixed order."""
    bad = lambda f: F.exists(scores, f)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(scores.isNull(), "MISSING_SCORES").when(bad(lambda x: x.isNull()), "NON_NUMERIC_SCORES").when(F.size(scores) != len(classes), "WRONG_WIDTH")
        .when(bad(lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "NON_FINITE").when(bad(lambda x: (x < 0) | (x > 1)), "OUT_OF_RANGE")
        .when(F.abs(total - 1) > 1e-6, "NOT_NORMALIZED").when(~F.coalesce(y_true.isin(*classes), F.lit(False)), "INVALID_TARGET")
        .when(~F.coalesce(y_pred.isin(*classes), F.lit(False)), "INVALID_PREDICTION").otherwise("OK")
    )


def validity_counts(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(reason, n)."""
    return df.groupBy(validity(F.col("scores"), F.col("y_true"), F.col("y_pred"), classes).alias("reason")).agg(F.count("*").alias("n"))


def bin_by_edges(c: Column, edges: Sequence[float]) -> Column:
    """Which half-open bin of the reported edges holds c; the last is closed."""
    inner = F.array(*map(F.lit, edges[1:-1]))
    return F.size(F.filter(inner, lambda e: e <= c))


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Observed order statistics as edges, equal ones merged; `bins` + 1 numbers reach the driver."""
    at = [k / bins for k in range(1, bins)]
    row = nearest_ranks(df, value, {f"q{i + 1}": p for i, p in enumerate(at)}).first()
    inner = sorted({row[f"q{i + 1}"] for i in range(len(at)) if row[f"q{i + 1}"] is not None})
    return [0.0, *[e for e in inner if 0 < e < 1], 1.0]


def reliability(df: DataFrame, edges: Sequence[float], minimum: int = 10) -> DataFrame:
    """(bin, lower, upper, n, confidence, accuracy, gap, acc_lower, acc_upper, evidence), empty bins as well."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lower double, upper double")
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    a = df.groupBy(bin_by_edges(F.col("confidence"), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.sum(right).alias("k"))
    j = bins.join(a, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low, high = wilson("k", "n")
    evidence = F.when(F.col("n") == 0, "EMPTY").when(F.col("n") == 1, "SINGLE").when(F.col("n") < minimum, "SPARSE").otherwise("OK")
    acc = ratio("k", "n")
    return j.select("bin", q9("lower").alias("lower"), q9("upper").alias("upper"), "n", q9("c").alias("confidence"), q9(acc).alias("accuracy"), q9(acc - F.col("c")).alias("gap"), q9(low).alias("acc_lower"), q9(high).alias("acc_upper"), evidence.alias("evidence"))


def bundle(df: DataFrame, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, accuracy, confidence, overconfidence, ece, mce, brier, log_loss) of the top label."""
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    c = F.col("confidence")
    p = F.greatest(F.least(F.when(F.col("y_true") == F.col("y_pred"), c).otherwise(1 - c), F.lit(1 - 1e-15)), F.lit(1e-15))
    per = df.groupBy(*by, bin_by_edges(c, edges).alias("bin")).agg(F.count("*").alias("n"), F.sum(right).alias("k"), F.sum(c).alias("s"), F.sum(F.pow(c - right, 2)).alias("b"), F.sum(-F.log(p)).alias("l"))
    gap = F.abs(F.col("k") - F.col("s"))
    a = per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("b").alias("b"), F.sum("l").alias("l"), F.sum(gap).alias("e"), F.max(gap / F.col("n")).alias("m"))
    return a.select(*by, "n", q9(ratio("k", "n")).alias("accuracy"), q9(ratio("s", "n")).alias("confidence"), q9(ratio(F.col("s") - F.col("k"), "n")).alias("overconfidence"), q9(ratio("e", "n")).alias("ece"), q9("m").alias("mce"), q9(ratio("b", "n")).alias("brier"), q9(ratio("l", "n")).alias("log_loss"))


def vector_scores(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(n, brier, nll) over whole score vectors."""
    names = F.array(*map(F.lit, classes))
    place = F.array_position(names, F.col("y_true"))
    brier = F.aggregate(F.transform("scores", lambda p, k: F.pow(p - (k + 1 == place).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    own = F.element_at("scores", place.cast("int"))
    return df.agg(F.count("*").alias("n"), q9(F.avg(brier)).alias("brier"), q9(F.avg(-F.log(F.greatest(own, F.lit(1e-15))))).alias("nll"))


def classwise(df: DataFrame, classes: Sequence[str], bins: int = 10, minimum: int = 10) -> DataFrame:
    """(label, n, positives, ece, status): calibration of each class's own score, equal-width bins."""
    each = df.select("y_true", F.posexplode("scores").alias("k", "p")).withColumn("label", F.element_at(F.array(*map(F.lit, classes)), F.col("k") + 1))
    hit = (F.col("label") == F.col("y_true")).cast("double")
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    per = each.groupBy("label", b.alias("bin")).agg(F.count("*").alias("n"), F.sum(hit).alias("k"), F.sum("p").alias("s"))
    a = per.groupBy("label").agg(F.sum("n").alias("n"), F.sum("k").cast("long").alias("positives"), F.sum(F.abs(F.col("k") - F.col("s"))).alias("e"))
    enough = F.col("positives") >= minimum
    return a.select("label", "n", "positives", q9(F.when(enough, ratio("e", "n"))).alias("ece"), F.when(enough, "COMPUTED").otherwise("INSUFFICIENT_EVIDENCE").alias("status"))


def entropy(df: DataFrame) -> DataFrame:
    """(sample_id, entropy, normalized, margin): of each score vector, natural logarithms; margin of the two highest scores."""
    h = F.aggregate(F.transform("scores", lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    down = F.sort_array("scores", asc=False)
    return df.select("sample_id", q9(h).alias("entropy"), q9(ratio(h, F.log(F.size("scores").cast("double")))).alias("normalized"), q9(F.get(down, 0) - F.get(down, 1)).alias("margin"))


def hash_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with part: ids in order of sha256(seed:id), the first round(share * n) calibrate and the rest test.

    The place is counted by hash prefix first (65,536 buckets) and then within a
    prefix, so that no task orders all the rows.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = df.withColumn("h", h).withColumn("prefix", F.substring("h", 1, 4))
    sizes = rows.groupBy("prefix").agg(F.count("*").alias("c"))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("prefix", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = rows.join(F.broadcast(start), "prefix").withColumn("r", F.col("start") + F.row_number().over(Window.partitionBy("prefix").orderBy("h", key)))
    part = F.when(F.col("r") <= F.floor(share * F.col("total") + 0.5), "calibrate").otherwise("test")
    return placed.withColumn("part", part).drop("h", "prefix", "start", "total", "r")


def fit_platt(df: DataFrame, rounds: int = 100) -> tuple[float, float]:
    """(slope, intercept) of a logistic map from logit(confidence) to correctness; ridge 1e-6 on the slope.

    Each Newton step is one aggregate of five sums over the table. Where all rows
    are right, or all wrong, no map is best: the slope is 0 and the intercept the
    logit of (right + 1/2) / (rows + 1). No rows give (1, 0), which changes nothing.
    """
    p = F.greatest(F.least(F.col("confidence"), F.lit(1 - 1e-15)), F.lit(1e-15))
    rows = df.select(F.log(p / (1 - p)).alias("x"), (F.col("y_true") == F.col("y_pred")).cast("double").alias("y"))
    rows = rows.groupBy("x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k"))
    n, k = rows.agg(F.sum("n"), F.sum("k")).first()
    if n and k in (0, n):
        return 0.0, math.log((k + 0.5) / (n - k + 0.5))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w = F.col("n") * mu * (1 - mu)
        r = F.col("k") - F.col("n") * mu
        g = rows.agg(F.sum(r * F.col("x")).alias("ga"), F.sum(r).alias("gb"), F.sum(w * F.col("x") * F.col("x")).alias("aa"), F.sum(w * F.col("x")).alias("ab"), F.sum(w).alias("bb")).first()
        if g["bb"] is None:
            return a, b
        hess = np.array([[g["aa"] + 1e-6, g["ab"]], [g["ab"], g["bb"] + 1e-12]])
        step = np.linalg.solve(hess, np.array([g["ga"] - 1e-6 * a, g["gb"]]))
        scale = min(1.0, 10.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a + scale * float(step[0]), b + scale * float(step[1])
        if float(np.abs(step).max()) < 1e-10:
            break
    return a, b


def apply_platt(c: Column, a: float, b: float) -> Column:
    p = F.greatest(F.least(c, F.lit(1 - 1e-15)), F.lit(1e-15))
    return 1 / (1 + F.exp(-(a * F.log(p / (1 - p)) + b)))


def _pooled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators of one ordered range: a stack of blocks (sum, weight, lo, hi) whose means ascend."""
    stack: list[list[float]] = []
    for batch in batches:
        for block in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "lo", "hi"))):
            k, n, lo, hi = block
            while stack and stack[-1][0] * n >= k * stack[-1][1]:
                k0, n0, lo, _ = stack.pop()
                k, n = k + k0, n + n0
            stack.append([k, n, lo, hi])
    for at in range(0, len(stack), 10_000):
        columns = list(zip(*stack[at : at + 10_000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], names=["k", "n", "lo", "hi"])


def fit_isotonic(df: DataFrame) -> DataFrame:
    """(k, n, lo, hi): blocks of confidence with ascending shares k / n of right rows: the monotone map of df(confidence, y_true, y_pred).

    Rows of equal confidence are pooled first. Each range of the order pools its own violators into a stack of blocks; where
    the last block of a range isn't below the first of the next, blocks are put in fewer ranges and pooled again, until all ascend: pooling in
    any order comes to the same blocks, and there are fewer in every round. Blocks of equal means are one. No rows give no blocks.
    """
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    rows = df.filter("confidence is not null and not isnan(confidence)").withColumn("right", right).filter("right is not null")
    blocks = kept(rows.groupBy(F.col("confidence").cast("double").alias("lo")).agg(F.sum("right").alias("k"), F.count("*").cast("double").alias("n")).select("k", "n", "lo", F.col("lo").alias("hi")))
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    while True:
        placed = blocks.repartitionByRange(ranges, "lo").sortWithinPartitions("lo")
        blocks = kept(placed.mapInArrow(_pooled, "k double, n double, lo double, hi double").withColumn("range", F.spark_partition_id()))
        ends = blocks.groupBy("range").agg(F.min_by(F.struct("k", "n"), "lo").alias("first"), F.max_by(F.struct("k", "n"), "lo").alias("last"), F.min("lo").alias("lo"))  # a row a range
        next_first = F.lead("first").over(Window.orderBy("lo"))
        torn = ends.withColumn("next", next_first).filter(F.col("last.k") * F.col("next.n") >= F.col("next.k") * F.col("last.n")).limit(1).count()
        blocks = blocks.drop("range")
        if not torn:
            return blocks
        ranges = max(1, ranges // 2)


#: Cells of [0, 1] by which rows meet the knots next to them.
MAP_CELLS = 4096


def apply_isotonic(df: DataFrame, blocks: DataFrame, confidence: str = "confidence") -> DataFrame:
    """df with calibrated: the blocks' means at their ends and straight lines between, constant beyond the first and last.

    Neighbouring knots make intervals; these and the rows meet by cells of [0, 1], an interval in each cell that it touches. Without blocks, and
    for a confidence that is null or NaN, calibrated is null.
    """
    knots = blocks.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), ratio("k", "n").alias("y"))
    placed = running(knots, ["x"], {}, following={"x1": "x", "y1": "y"})
    ends = knots.agg(F.min("x").alias("first"), F.min_by("y", "x").alias("y_first"), F.max("x").alias("last"), F.max_by("y", "x").alias("y_last"))  # one row
    cell = lambda c: F.least(F.greatest(F.floor(c * MAP_CELLS), F.lit(0)), F.lit(MAP_CELLS - 1))
    spans = placed.filter("x1 is not null").withColumn("__cell", F.explode(F.sequence(cell(F.col("x")), cell(F.col("x1")))))
    rows = df.withColumn("__c", F.when(~F.isnan(F.col(confidence).cast("double")), F.col(confidence).cast("double"))).withColumn("__id", F.monotonically_increasing_id())
    rows = kept(rows)
    met = rows.select("__id", "__c", cell(F.col("__c")).alias("__cell")).join(spans, "__cell").filter((F.col("x") <= F.col("__c")) & (F.col("__c") < F.col("x1")))
    line = met.select("__id", (F.col("y") + (F.col("y1") - F.col("y")) * (F.col("__c") - F.col("x")) / (F.col("x1") - F.col("x"))).alias("__y"))
    out = rows.join(line, "__id", "left").crossJoin(F.broadcast(ends))
    value = F.when(F.col("__c") <= F.col("first"), F.col("y_first")).when(F.col("__c") >= F.col("last"), F.col("y_last")).otherwise(F.col("__y"))
    return out.withColumn("calibrated", value).select(*df.columns, "calibrated")


#: Measures of the top label that are resampled.
MEASURES = ("accuracy", "confidence", "overconfidence", "ece", "mce", "brier", "log_loss")


def _terms() -> dict[str, Column]:
    """What a row adds to each bin."""
    right, c = (F.col("y_true") == F.col("y_pred")).cast("double"), F.col("confidence")
    p = F.greatest(F.least(F.when(F.col("y_true") == F.col("y_pred"), c).otherwise(1 - c), F.lit(1 - 1e-15)), F.lit(1e-15))
    return {"n": F.lit(1.0), "k": right, "s": c, "b": F.pow(c - right, 2), "l": -F.log(p)}


def _measured(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., measures) of bins(by..., n, k, s, b, l); null where no row is drawn."""
    gap = F.abs(F.col("k") - F.col("s"))
    a = bins.groupBy(*by).agg(*[F.sum(c).alias(c) for c in "nksbl"], F.sum(gap).alias("e"), F.max(ratio(gap, "n")).alias("m"))
    found = {"accuracy": ratio("k", "n"), "confidence": ratio("s", "n"), "overconfidence": ratio(F.col("s") - F.col("k"), "n"), "ece": ratio("e", "n"), "mce": F.col("m"), "brier": ratio("b", "n"), "log_loss": ratio("l", "n")}
    return a.select(*by, *[c.alias(k) for k, c in found.items()])


def _intervals(measures: DataFrame, names: Sequence[str], confidence: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., measure, estimate, lower, upper, replicates, status) of measures(by..., replicate, names...): type-7 ends over the replicates that have a value."""
    long = measures.select(*by, "replicate", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("v")) for k in names])))
    tail, drawn = (1 - confidence) / 2, F.when(F.col("replicate") > 0, F.col("v"))
    a = long.groupBy(*by, "measure").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("estimate"), F.percentile(drawn, F.lit(tail)).alias("lower"), F.percentile(drawn, F.lit(1 - tail)).alias("upper"), F.count(drawn).alias("replicates"),
    )  # fmt: skip  # as many values as replicates
    status = F.when((F.col("replicates") == 0) | F.col("estimate").isNull(), "UNDEFINED").otherwise("DERIVED")
    return a.select(*by, "measure", q9("estimate").alias("estimate"), q9("lower").alias("lower"), q9("upper").alias("upper"), "replicates", status.alias("status"))


def bootstrap_bundle(df: DataFrame, edges: Sequence[float], key: str, replicates: int = 200, seed: int = 31, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(by..., measure, estimate, lower, upper, replicates, status): percentile intervals of every top-label measure.

    Rows are drawn Poisson(1) times in each replicate; the sums of all replicates by bin are gathered in one pass, and
    every measure is read off them. The key tells rows apart for the draws.
    """
    rows = df.withColumn("bin", bin_by_edges(F.col("confidence"), edges))
    sums = replicate_sums(rows, Draws("counts", seed, replicates), number(seed, F.col(key)), _terms(), [*by, "bin"])
    return _intervals(_measured(sums.filter("n > 0"), [*by, "replicate"]), MEASURES, confidence, by)


def _binned(draws: Draws, edges: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, edges.shape[1] + 1, draws.replicates + 1))
        for batch in batches:
            for k in range(0, len(batch), STRIP):
                part = batch.slice(k, STRIP)
                value = {c: part.column(c).to_numpy(zero_copy_only=False) for c in "nksbl"}
                drawn = draws.matrix(part.column("x").to_numpy())
                at = (edges[None, :, :] <= value["s"][:, None, None]).sum(2)  # each replicate has edges of its own
                for b in range(total.shape[1]):
                    inside = drawn * (at == b)
                    for i, c in enumerate("nksbl"):
                        total[i, b] += value[c] @ inside
        for b in range(total.shape[1]):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([t[b]], pa.list_(pa.float64())) for t in total)], names=["bin", *"nksbl"])

    return run


def bootstrap_bundle_quantile(df: DataFrame, bins: int, key: str, replicates: int = 200, seed: int = 31, confidence: float = 0.95) -> DataFrame:
    """The same for bins between order statistics of the confidence, worked out anew for each replicate from its drawn counts. Replicates x bins edges reach the driver."""
    x, draws = number(seed, F.col(key)), Draws("counts", seed, replicates)
    terms = _terms()
    rows = ordered(df, "confidence", x, *[c.alias(k) for k, c in terms.items()])
    ranks = {f"e{k}": F.ceil(F.col("n") * k / bins) for k in range(1, bins)}
    found = {r["replicate"]: [r[e] for e in ranks] for r in order_statistics(rows, draws, ranks).collect()}
    edges = np.array([[np.inf if e is None or not 0 < e < 1 else e for e in found.get(r, [None] * (bins - 1))] for r in range(replicates + 1)]).reshape(replicates + 1, bins - 1)
    arrays = rows.select("x", *terms).mapInArrow(_binned(draws, edges), "bin int, " + ", ".join(f"{c} array<double>" for c in terms))
    each = arrays.select("bin", F.posexplode(F.arrays_zip(*terms)).alias("replicate", "z")).select("bin", "replicate", "z.*")
    sums = each.groupBy("bin", "replicate").agg(*[F.sum(c).alias(c) for c in terms])
    return _intervals(_measured(sums.filter("n > 0"), ["replicate"]), MEASURES, confidence)


def calibration_difference(df: DataFrame, edges: Sequence[float], key: str, paired: bool, replicates: int = 200, permutations: int = 199, seed: int = 37, confidence: float = 0.95) -> DataFrame:
    """(measure, estimate, lower, upper, replicates, status, permutations, p) of b minus a, from df(side, key, ...) with sides a and b.

    Paired: the key names a sample, which both sides must hold (others are left out); replicates draw samples, and
    the test swaps the two sides within samples. Unpaired: each side is drawn on its own, and the test splits all
    rows anew. p = (hits + 1) / (permutations + 1), two-sided. Each of the two is one pass over the table.
    """
    rows = df.filter(F.col("side").isin("a", "b")).withColumn("bin", bin_by_edges(F.col("confidence"), edges))
    if paired:
        both = rows.groupBy(key).agg(F.countDistinct("side").alias("sides")).filter("sides = 2").select(key)
        rows = rows.join(both, key, "left_semi")
    rows = kept(rows)
    terms = _terms()
    x = number(seed, F.col(key)) if paired else number(seed, F.col("side"), F.col(key))

    def differences(bins: DataFrame) -> DataFrame:
        side = _measured(bins.filter("n > 0"), ["replicate", "side"])
        wide = side.groupBy("replicate").agg(*[F.max(F.when(F.col("side") == g, F.col(k))).alias(f"{k}_{g}") for k in MEASURES for g in "ab"])
        return wide.select("replicate", *[(F.col(f"{k}_b") - F.col(f"{k}_a")).alias(k) for k in MEASURES])

    drawn = replicate_sums(rows, Draws("counts", seed, replicates), x, terms, ["side", "bin"])
    intervals = _intervals(differences(drawn), MEASURES, confidence)
    whole = rows.groupBy("side", "bin").agg(*[F.sum(c).alias(f"all_{k}") for k, c in terms.items()])
    if paired:
        moved = replicate_sums(rows, Draws("swap", seed + 1, permutations), number(seed + 1, F.col(key)), terms, ["side", "bin"], label=F.lit(False))
        stay = moved.join(F.broadcast(whole), ["side", "bin"]).select("replicate", "side", "bin", *[(F.col(f"all_{k}") - F.col(k)).alias(k) for k in terms])  # two rows a bin
        gone = moved.withColumn("side", F.when(F.col("side") == "a", "b").otherwise("a")).select("replicate", "side", "bin", *terms)
        again = stay.unionByName(gone)
    else:
        sizes = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count("*").alias("n")).collect()}
        n_b, n = sizes.get("b", 0), sum(sizes.values())
        if not 0 < n_b < n:
            return intervals.withColumns({"permutations": F.lit(0), "p": F.lit(None).cast("double")})
        other = number(seed + 1, F.col("side"), F.col(key))
        moved = replicate_sums(rows, split_thresholds(rows, other, n_b, n, seed + 1, permutations), other, terms, ["bin"], label=F.col("side") == "b")
        pooled = whole.groupBy("bin").agg(*[F.sum(f"all_{k}").alias(f"all_{k}") for k in terms])
        met = moved.join(F.broadcast(pooled), "bin")  # a row a bin
        again = met.select("replicate", F.lit("b").alias("side"), "bin", *terms).unionByName(met.select("replicate", F.lit("a").alias("side"), "bin", *[(F.col(f"all_{k}") - F.col(k)).alias(k) for k in terms]))
    summed = again.groupBy("replicate", "side", "bin").agg(*[F.sum(k).alias(k) for k in terms]).filter("n > 0.5")
    long = differences(summed).select("replicate", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("v")) for k in MEASURES])))
    point = F.max(F.when(F.col("replicate") == 0, F.abs("v"))).over(Window.partitionBy("measure"))  # as many rows as permutations
    hits = long.withColumn("point", point).groupBy("measure").agg(F.count_if((F.col("replicate") > 0) & (F.abs("v") >= F.col("point") - 1e-12)).alias("hits"))
    p = hits.select("measure", F.lit(permutations).alias("permutations"), q9((F.col("hits") + 1) / F.lit(permutations + 1.0)).alias("p"))
    return intervals.join(p, "measure")
