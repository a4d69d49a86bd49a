"""Seeded faults as column expressions, and what they do to a measure."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import normal, uniform
from ..status import q9, ratio
from .calibration import hash_split

Fault = Callable[[Column, Column, int], Column]


def gaussian_noise(sigma: float) -> Fault:
    return lambda x, key, seed: x + sigma * normal(seed, key)


def uniform_noise(width: float) -> Fault:
    return lambda x, key, seed: x + width * (2 * uniform(seed, key) - 1)


def dropout(p: float, value: float = 0.0) -> Fault:
    return lambda x, key, seed: F.when(uniform(seed, key) < p, F.lit(value)).otherwise(x)


def missing(p: float) -> Fault:
    return lambda x, key, seed: F.when(uniform(seed, key) >= p, x)


def scaling(factor: float) -> Fault:
    return lambda x, key, seed: x * factor


def offset(by: float) -> Fault:
    return lambda x, key, seed: x + by


def outlier(p: float, magnitude: float) -> Fault:
    return lambda x, key, seed: F.when(uniform(seed, key) < p, x + F.when(uniform(seed, key, F.lit("sign")) < 0.5, -magnitude).otherwise(magnitude)).otherwise(x)


def salt_and_pepper(p: float, low: float, high: float) -> Fault:
    return lambda x, key, seed: F.when(uniform(seed, key) < p / 2, F.lit(low)).when(uniform(seed, key) < p, F.lit(high)).otherwise(x)


def brightness(delta: float, low: float = 0.0, high: float = 1.0) -> Fault:
    return lambda x, key, seed: F.least(F.greatest(x + delta, F.lit(low)), F.lit(high))


def compound(*faults: Fault) -> Fault:
    """Applied in order; each with a seed of its own place, so A then B isn't B then A."""

    def run(x: Column, key: Column, seed: int) -> Column:
        for k, f in enumerate(faults):
            x = f(x, key, seed + 1000 * k)
        return x

    return run


def label_flip(y: Column, key: Column, labels: Sequence, rate: float, seed: int) -> Column:
    """With the given rate another label than y, each as likely."""
    others = F.filter(F.array(*map(F.lit, labels)), lambda v: v != y)
    pick = F.floor(uniform(seed, key, F.lit("pick")) * (len(labels) - 1)).cast("int")
    return F.when(uniform(seed, key) < rate, F.get(others, pick)).otherwise(y)


def label_randomize(y: Column, key: Column, labels: Sequence, rate: float, seed: int) -> Column:
    """With the given rate any label."""
    pick = F.floor(uniform(seed, key, F.lit("pick")) * len(labels)).cast("int")
    return F.when(uniform(seed, key) < rate, F.get(F.array(*map(F.lit, labels)), pick)).otherwise(y)


def image_contrast(pixels: Column, factor: float) -> Column:
    """Pixels moved away from their mean, within 0 and 1."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    return F.transform(pixels, lambda x: F.least(F.greatest((x - mean) * factor + mean, F.lit(0.0)), F.lit(1.0)))


def cyclic_roll(values: Column, by: int) -> Column:
    n = F.size(values)
    return F.concat(F.slice(values, n - by + 1, by), F.slice(values, 1, n - by))


def feature_mask(values: Column, share: float, width: int, seed: int, constant: float = 0.0) -> Column:
    """A fixed set of round(share * width) places, chosen by seed, set to a constant."""
    import hashlib

    order = sorted(range(width), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    places = order[: int(share * width + 0.5)]
    return F.transform(values, lambda x, i: F.when(i.isin(*places) if places else F.lit(False), F.lit(constant)).otherwise(x))


def box_blur(values: Column, side: int) -> Column:
    """Mean of the 3 x 3 neighbours of a side x side image, edges repeated."""
    def at(r, c):
        return F.get(values, F.greatest(F.lit(0), F.least(F.lit(side - 1), r)) * side + F.greatest(F.lit(0), F.least(F.lit(side - 1), c)))

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: sum((at(F.floor(i / side).cast("int") + dr, i % side + dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)), F.lit(0.0)) / 9)


def occlusion(values: Column, key: Column, side: int, patch: int, seed: int) -> Column:
    """A square patch at a seeded place set to 0."""
    top = F.floor(uniform(seed, key, F.lit("r")) * (side - patch + 1)).cast("int")
    left = F.floor(uniform(seed, key, F.lit("c")) * (side - patch + 1)).cast("int")
    inside = lambda i: (F.floor(i / side) >= top) & (F.floor(i / side) < top + patch) & (i % side >= left) & (i % side < left + patch)
    return F.transform(values, lambda x, i: F.when(inside(i), F.lit(0.0).cast("float")).otherwise(x))


def random_subset(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Exactly round(share * n) rows, those first in the order of the seeded hash; places are counted by hash prefix, not in one task."""
    return hash_split(df, key, share, seed).filter("part = 'calibrate'").drop("part")


def degradation(df: DataFrame, key: str, measure: str, higher_is_better: bool = True) -> DataFrame:
    """(measure, baseline, treated, delta, relative, deterioration, change) of df(measure, baseline, treated)."""
    delta = F.col("treated") - F.col("baseline")
    worse = -delta if higher_is_better else delta
    change = F.when(worse > 0, "DETERIORATED").when(worse < 0, "IMPROVED").otherwise("UNCHANGED")
    return df.select(measure, q9("baseline").alias("baseline"), q9("treated").alias("treated"), q9(delta).alias("delta"), q9(F.try_divide(delta, F.abs("baseline"))).alias("relative"), q9(worse).alias("deterioration"), change.alias("change"))


def sweep(df: DataFrame, key: str, column: str, rule: Callable[[Column], Column], faults: dict[str, Fault], seeds: Sequence[int]) -> DataFrame:
    """(fault, seed, n, accuracy, baseline, delta, newly_wrong): a predictor's rule on the faulty column, for each fault and seed in one pass."""
    right0 = (rule(F.col(column)) == F.col("y_true"))
    units = [(name, seed, rule(f(F.col(column), F.col(key), seed)) == F.col("y_true")) for name, f in faults.items() for seed in seeds]
    aggs = [
        F.struct(F.lit(name).alias("fault"), F.lit(seed).alias("seed"), F.count("*").alias("n"), F.avg(r.cast("double")).alias("a"), F.avg(right0.cast("double")).alias("b"), F.count_if(right0 & ~r).alias("newly_wrong"))
        for name, seed, r in units
    ]
    a = df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return a.select("fault", "seed", "n", q9("a").alias("accuracy"), q9("b").alias("baseline"), q9(F.col("a") - F.col("b")).alias("delta"), "newly_wrong")


def assessment(trials: DataFrame) -> DataFrame:
    """(fault, trials, mean_delta, worst, effect): over seeds; effects from 0.02, 0.05, 0.10 and 0.20 on."""
    a = trials.groupBy("fault").agg(F.count("*").alias("trials"), F.avg("delta").alias("m"), F.min("delta").alias("w"), F.stddev_samp("delta").alias("s"))
    size = F.abs("m")
    effect = F.when(F.col("trials") < 2, "INCONCLUSIVE").when(size < 0.02, "NO_MEASURED").when(size < 0.05, "MEASURED").when(size < 0.10, "MODERATE").when(size < 0.20, "SUBSTANTIAL").otherwise("SEVERE")
    return a.select("fault", "trials", q9("m").alias("mean_delta"), q9("w").alias("worst"), effect.alias("effect"))


def stability(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n, agreement, max_difference, deterministic): predictions and scores of two runs over the same ids."""
    j = a.select(key, F.col("y_pred").alias("p"), F.col("score").alias("s")).join(b.select(key, F.col("y_pred").alias("p2"), F.col("score").alias("s2")), key)
    g = F.abs(F.col("s") - F.col("s2"))
    x = j.agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("p2")).alias("same"), F.max(g).alias("g"))
    return x.select("n", q9(ratio("same", "n")).alias("agreement"), q9("g").alias("max_difference"), ((F.col("same") == F.col("n")) & (F.col("g") == 0)).alias("deterministic"))


