"""Failure signals, their similarity and clusters, and interaction contrasts between faults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..status import q9, ratio
from .graph import components
from .ordering import kept


def confusion_signals(df: DataFrame, run: str, threshold: float = 0.15) -> DataFrame:
    """(run, kind, class_label, predicted_label, magnitude, samples): wrong pairs that take at least the threshold of a class, by run."""
    cells = df.groupBy(run, "y_true", "y_pred").agg(F.count("*").alias("samples"))
    share = ratio("samples", F.sum("samples").over(Window.partitionBy(run, "y_true")))
    out = cells.withColumn("m", share).filter((F.col("y_true") != F.col("y_pred")) & (F.col("m") >= threshold))
    return out.select(run, F.lit("CONFUSION_PAIR").alias("kind"), F.col("y_true").alias("class_label"), F.col("y_pred").alias("predicted_label"), q9("m").alias("magnitude"), "samples")


def recall_signals(df: DataFrame, run: str, below: float = 0.8) -> DataFrame:
    """(run, kind, class_label, magnitude, samples): classes whose recall is low."""
    a = df.groupBy(run, "y_true").agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("k"))
    r = ratio("k", "n")
    return a.filter(r < below).select(run, F.lit("PER_CLASS_RECALL_LOW").alias("kind"), F.col("y_true").alias("class_label"), q9(1 - r).alias("magnitude"), (F.col("n") - F.col("k")).alias("samples"))


def signature(kind: Column, label: Column, predicted: Column, band: Column) -> Column:
    """Text by which equal signals are grouped."""
    return F.concat_ws("|", kind, F.concat(F.lit("class="), label), F.concat(F.lit("pred="), predicted), F.concat(F.lit("sev="), band.cast("string")))


def _alike(features: Sequence[Feature]) -> Column:
    """Weighted mean of the features' likenesses, of columns l_<name> and r_<name>; a feature that both lack doesn't count, one that one lacks counts 0."""
    parts, weights = [], []
    for f in features:
        l, r = F.col(f"l_{f.column}"), F.col(f"r_{f.column}")
        if f.kind == "equal":
            s = (l == r).cast("double")
        elif f.kind == "number":
            top = F.greatest(F.abs(l), F.abs(r))
            s = F.when(top == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(l - r), top)))
        else:
            s = F.when(F.size(F.array_union(l, r)) == 0, 1.0).otherwise(F.size(F.array_intersect(l, r)) / F.size(F.array_union(l, r)))
        parts.append(F.when(l.isNotNull() & r.isNotNull(), s * f.weight).otherwise(0.0))
        weights.append(F.when(l.isNotNull() | r.isNotNull(), F.lit(f.weight)).otherwise(0.0))
    return F.try_divide(sum(parts[1:], parts[0]), sum(weights[1:], weights[0]))


@dataclass(frozen=True)
class Feature:
    """What two signals are compared by: kind "equal" (1 or 0), "number" (1 - difference / larger) or "set" (shared / all members of an array)."""

    column: str
    weight: float
    kind: str = "equal"


def prefix(features: Sequence[Feature], threshold: float, distinct: Mapping[str, int]) -> list[Feature]:
    """The fewest features of "equal" kind, those of most distinct values first, of which a pair that reaches the threshold shares one.

    Pairs that share none of them lose their weights, and with these more than the threshold leaves. Empty if
    the others' weight alone can reach it.
    """
    every, out = sum(f.weight for f in features), []
    for f in sorted((f for f in features if f.kind == "equal"), key=lambda f: (-distinct[f.column], f.column)):
        out.append(f)
        if sum(g.weight for g in out) > (1 - threshold) * every + 1e-12:
            return out
    return []


def similar_pairs(signals: DataFrame, key: str, block: Sequence[str], features: Sequence[Feature], threshold: float, budget: int = 1_000_000) -> DataFrame:
    """(a, b, similarity, exact): signals of a block whose likeness reaches the threshold.

    Signals equal in block and all features are taken as one, the least key, to which the others are linked; pairs are sought
    between these. A pair that reaches the threshold shares one of the prefix's features (see prefix), so that only signals with a
    common value of one meet, in the first such feature; where the threshold leaves no prefix, all of a block meet.
    A block in which more than `budget` pairs would meet isn't compared: its signals are linked by equal signature
    alone, which is what equal ones have been, and exact is false for them. Null features that both lack don't count.
    """
    columns = [f.column for f in features]
    text = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    named = signals.select(F.col(key).alias("__key"), text(block).alias("block"), text([*block, *dict.fromkeys(columns)]).alias("signature"), *[F.col(c).alias(f"f_{c}") for c in dict.fromkeys(columns)])
    groups = named.groupBy("signature", "block").agg(F.min("__key").alias("rep"), F.count("*").alias("copies"), *[F.first(f"f_{c}").alias(c) for c in dict.fromkeys(columns)])
    groups = kept(groups)
    copies = groups.filter("copies > 1").select("signature", F.col("rep").alias("a"), "block")
    equal = named.select("signature", F.col("__key").alias("b")).join(copies, "signature").filter("a != b")
    countable = [f.column for f in features if f.kind == "equal"]
    distinct = groups.agg(*[F.count_distinct(c).alias(c) for c in dict.fromkeys(countable)]).first() if countable else {}
    chosen = prefix(features, threshold, distinct.asDict() if countable else {})
    if chosen:
        spread = groups.select("*", F.posexplode(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(f.column).cast("string")), F.lit("")) for f in chosen])).alias("nth", "value"))  # nulls meet as well
    else:
        spread = groups.select("*", F.lit(0).alias("nth"), F.lit("").alias("value"))
    met = spread.groupBy("block", "nth", "value").agg(F.count("*").alias("n"))
    over = kept(met.groupBy("block").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).filter(F.col("pairs") > budget).select("block", F.lit(True).alias("over")))
    some = spread.join(over, "block", "left_anti")
    side = lambda p: some.select("block", "nth", "value", F.col("rep").alias(f"{p}_rep"), *[F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys(columns)])
    pairs = side("l").join(side("r"), ["block", "nth", "value"]).filter("l_rep < r_rep")
    for k, f in enumerate(chosen):  # an earlier feature of the prefix has the pair
        pairs = pairs.filter((F.col("nth") <= k) | ~F.col(f"l_{f.column}").eqNullSafe(F.col(f"r_{f.column}")))
    scored = pairs.select(F.col("l_rep").alias("a"), F.col("r_rep").alias("b"), q9(_alike(features)).alias("similarity"), F.lit(True).alias("exact")).filter(F.col("similarity") >= threshold)
    return scored.unionByName(equal.join(over, "block", "left").select("a", "b", F.lit(1.0).alias("similarity"), F.col("over").isNull().alias("exact")))


def clusters(signals: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, cluster): connected components of similar pairs; a signal alone is its own cluster."""
    linked = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return signals.select(F.col(key).alias("node")).distinct().join(linked, "node", "left").select(F.col("node").alias(key), F.coalesce("component", "node").alias("cluster"))


def cluster_stability(signals: DataFrame, pairs: DataFrame, key: str, threshold: float, delta: float = 0.1) -> DataFrame:
    """(cluster, size, finer, coarser, stability): how far each cluster holds when the threshold moves by delta either way.

    pairs must go down to threshold - delta. Clusters of a higher threshold lie within those of a lower one, so the
    graph is contracted step by step, from the highest threshold down: each step joins clusters, not signals, by the links it adds. Of
    the clusters within a cluster the largest has the best Jaccard overlap, its share; of those around it there is one. stability is
    the worse of the two.
    """
    steps = [min(1.0, threshold + delta), threshold, max(0.0, threshold - delta)]
    label = signals.select(F.col(key).alias("node")).distinct().withColumn("c0", F.col("node"))
    last = "c0"
    for k, t in enumerate(steps, 1):
        now = label.select("node", F.col(last).alias("c"))
        links = pairs.filter(F.col("similarity") >= t - 1e-12).select("a", "b")
        moved = links.join(now.select(F.col("node").alias("a"), F.col("c").alias("src")), "a").join(now.select(F.col("node").alias("b"), F.col("c").alias("dst")), "b")
        joined = components(moved.select("src", "dst").distinct())
        label = kept(label.join(joined.select(F.col("node").alias(last), "component"), last, "left").withColumn(f"c{k}", F.coalesce("component", last)).drop("component"))
        last = f"c{k}"
    own = label.groupBy(F.col("c2").alias("cluster"), F.col("c3").alias("around")).agg(F.count("*").alias("size"))
    inner = label.groupBy(F.col("c2").alias("cluster"), "c1").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max("n").alias("inner"))
    outer = label.groupBy(F.col("c3").alias("around")).agg(F.count("*").alias("outer"))
    found = own.join(inner, "cluster").join(outer, "around")
    finer, coarser = ratio("inner", "size"), ratio("size", "outer")
    return found.select("cluster", "size", q9(finer).alias("finer"), q9(coarser).alias("coarser"), q9(F.least(finer, coarser)).alias("stability"))


def cluster_measures(signals: DataFrame, by: Sequence[str], run: str, magnitude: str, samples: str, total_runs: int) -> DataFrame:
    """(by..., signals, runs, prevalence, mean_magnitude, worst, samples).

    Magnitudes count in whole units of 1e-9, so that their sum, and with it a mean halfway between two units, is the same in any order.
    """
    units = F.round(F.col(magnitude).cast("double") * 1e9).cast("long")
    a = signals.groupBy(*by).agg(F.count("*").alias("signals"), F.count_distinct(run).alias("runs"), F.sum(units).alias("m"), F.count(magnitude).alias("k"), F.max(magnitude).alias("w"), F.sum(samples).alias("samples"))
    mean = F.floor(ratio("m", "k") + 0.5) / F.lit(1e9)
    return a.select(*by, "signals", "runs", q9(F.col("runs") / F.lit(float(total_runs))).alias("prevalence"), mean.alias("mean_magnitude"), q9("w").alias("worst"), "samples")


def cooccurrence(signals: DataFrame, mode: str, run: str) -> DataFrame:
    """(a, b, both, either, jaccard): modes that share a run. Distinct (mode, run) pairs meet by run."""
    seen = signals.select(F.col(mode).alias("m"), F.col(run).alias("r")).distinct()
    size = seen.groupBy("m").agg(F.count("*").alias("n"))
    pairs = seen.alias("x").join(seen.alias("y"), (F.col("x.r") == F.col("y.r")) & (F.col("x.m") < F.col("y.m"))).groupBy(F.col("x.m").alias("a"), F.col("y.m").alias("b")).agg(F.count("*").alias("both"))
    j = pairs.join(size.select(F.col("m").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("m").alias("b"), F.col("n").alias("nb")), "b")
    either = F.col("na") + F.col("nb") - F.col("both")
    return j.select("a", "b", "both", either.alias("either"), q9(ratio("both", either)).alias("jaccard"))


def strongest(signals: DataFrame, run: str, magnitude: str, key: str) -> DataFrame:
    """The signal of greatest magnitude (ties: greatest key) of each run: by aggregation, not by window."""
    best = F.max(F.struct(F.col(magnitude).alias("magnitude"), F.col(key).alias("key"))).alias("best")
    return signals.groupBy(run).agg(best).select(run, F.col("best.key").alias(key), q9("best.magnitude").alias("magnitude"))


def contrast(trials: DataFrame, measure: str) -> DataFrame:
    """(n, dropped, control, a, b, ab, effect_a, effect_b, contrast, relative, status): YAB - YA - YB + Y0 over trial keys that all four cells have."""
    wide = trials.groupBy("trial_key").agg(*[F.max(F.when(F.col("cell") == c, F.col(measure))).alias(n) for c, n in (("CONTROL", "y0"), ("A", "ya"), ("B", "yb"), ("AB", "yab"))])
    whole = F.col("y0").isNotNull() & F.col("ya").isNotNull() & F.col("yb").isNotNull() & F.col("yab").isNotNull()
    m = lambda c: F.avg(F.when(whole, F.col(c)))
    g = wide.agg(F.count_if(whole).alias("n"), F.count_if(~whole).alias("dropped"), m("y0").alias("y0"), m("ya").alias("ya"), m("yb").alias("yb"), m("yab").alias("yab"))
    c = F.col("yab") - F.col("ya") - F.col("yb") + F.col("y0")
    return g.select(
        "n", "dropped", q9("y0").alias("control"), q9("ya").alias("a"), q9("yb").alias("b"), q9("yab").alias("ab"), q9(F.col("ya") - F.col("y0")).alias("effect_a"), q9(F.col("yb") - F.col("y0")).alias("effect_b"),
        q9(c).alias("contrast"), q9(F.try_divide(c, F.abs("y0"))).alias("relative"), F.when(F.col("n") == 0, "UNDEFINED").otherwise("DERIVED").alias("status"),
    )


def trial_contrasts(trials: DataFrame, measure: str) -> DataFrame:
    """(trial_key, contrast) of each complete trial."""
    wide = trials.groupBy("trial_key").agg(*[F.max(F.when(F.col("cell") == c, F.col(measure))).alias(n) for c, n in (("CONTROL", "y0"), ("A", "ya"), ("B", "yb"), ("AB", "yab"))])
    return wide.select("trial_key", q9(F.col("yab") - F.col("ya") - F.col("yb") + F.col("y0")).alias("contrast")).filter("contrast is not null")
