"""Rules, classes of interaction, similar signals and their clusters, against plain versions."""

import hashlib
import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import failures, reports, resampling
from gaugeworks.operators.failures import Feature
from gaugeworks.sources import records

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rule", reports.RULES, ids=lambda r: f"{r.name}:{r.measure}")
def test_each_rule_finds_from_its_threshold_on(spark, rule):
    step = {">": (0.0, 1e-6), ">=": (-1e-6, 0.0), "<": (0.0, -1e-6)}[rule.comparison]  # just not, and just
    rows = [("not", rule.measure, rule.threshold + step[0]), ("yes", rule.measure, rule.threshold + step[1]), ("null", rule.measure, None), ("nan", rule.measure, float("nan")), ("other", "unknown", 1e9)]
    got = reports.findings(spark.createDataFrame(rows, "affected string, measure string, value double")).collect()
    assert [(r["rule"], r["severity"], r["affected"]) for r in got] == [(rule.name, rule.severity, "yes")]


def test_measures_that_do_not_exist_find_nothing(spark):
    one = spark.createDataFrame([(1, 1, 0.8, "x")] * 12, "y_true int, y_pred int, confidence double, s string")
    got = {(r["affected"], r["measure"]): r["value"] for r in reports.classification_measures(one, "s").collect()}
    assert got["overall", "imbalance_ratio"] is None and got["class:1", "minority_recall"] is None and got["slice:x", "accuracy_drop"] == 0
    few = spark.createDataFrame([(1.0,), (100.0,)], "v double")
    assert reports.latency_measures(few, "v").first()["value"] is None


def boot(spark, low, high, estimate, status="COMPUTED", sign=1.0):
    return spark.createDataFrame([(estimate, low, high, sign, status)], "estimate double, lower double, upper double, sign_fraction double, status string")


# contrast, order effect and contrast of the other order as (lower, upper), least contrast, sign share, class
BRANCHES = [
    ((1, 2), (1, 2), (-1, 1), 0, 1, "ORDER_DEPENDENT_INTERACTION"),
    ((-1, 1), (1, 2), (1, 2), 0, 1, "ORDER_DEPENDENT_INTERACTION"),
    ((-1, 1), (1, 2), (-1, 1), 0, 1, "POSSIBLE_INTERACTION"),
    ((1, 2), (-1, 1), (1, 2), 0, 1, "OBSERVED_INTERACTION"),
    ((1, 2), None, None, 0, 1, "OBSERVED_INTERACTION"),
    ((1, 2), None, None, 0, 0.5, "POSSIBLE_INTERACTION"),
    ((1, 2), None, None, 5, 1, "POSSIBLE_INTERACTION"),
    ((-1, 3), None, None, 0.5, 1, "POSSIBLE_INTERACTION"),
    ((-1, 3), None, None, 0, 1, "NO_EVIDENCE"),
    ((1, 2), (1, 2), (1, 2), 5, 1, "POSSIBLE_INTERACTION"),
]


@pytest.mark.parametrize("c, o, ba, least, sign, want", BRANCHES)
def test_every_class_of_interaction(spark, c, o, ba, least, sign, want):
    part = lambda x, s=1.0: None if x is None else boot(spark, float(x[0]), float(x[1]), (x[0] + x[1]) / 2, sign=s)
    got = resampling.interaction_class(part(c, float(sign)), part(o), part(ba), float(least)).first()
    assert got["class"] == want


def test_interaction_without_trials(spark):
    assert resampling.interaction_class(boot(spark, None, None, None, "UNDEFINED")).first()["class"] == "UNDEFINED"
    assert resampling.interaction_class(boot(spark, None, None, 1.0, "INSUFFICIENT_DATA")).first()["class"] == "INCONCLUSIVE"


FEATURES = [Feature("kind", 1.0), Feature("band", 2.0), Feature("size", 2.0, "number"), Feature("ids", 1.0, "set")]
SCHEMA = "id string, block string, kind string, band int, size double, ids array<int>"


def alike(a, b):
    top = weight = 0.0
    for f, x, y in zip(FEATURES, a[2:], b[2:]):
        if x is None and y is None:
            continue
        weight += f.weight
        if x is None or y is None:
            continue
        if f.kind == "equal":
            s = float(x == y)
        elif f.kind == "number":
            s = 1.0 if max(abs(x), abs(y)) == 0 else max(0.0, 1 - abs(x - y) / max(abs(x), abs(y)))
        else:
            s = len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 1.0
        top += f.weight * s
    return top / weight if weight else 0.0


def some_signals(n=60, seed=3):
    r = random.Random(seed)
    maybe = lambda v: None if r.random() < 0.15 else v
    return [(f"s{k:03}", r.choice(["x", "y", None]), maybe(r.choice("ab")), maybe(r.randint(0, 2)), maybe(float(r.randint(0, 6))), maybe(r.sample(range(4), r.randint(0, 3)))) for k in range(n)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_similar_signals_equal_comparing_all(spark, threshold):
    rows = some_signals()
    got = {(r["a"], r["b"]): r["similarity"] for r in failures.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", ["block"], FEATURES, threshold).collect()}
    rep = {r[0]: min(o[0] for o in rows if (o[1:5], o[5]) == (r[1:5], r[5])) for r in rows}
    want = {(rep[r[0]], r[0]): 1.0 for r in rows if rep[r[0]] != r[0]}
    for a, b in itertools.combinations([r for r in rows if rep[r[0]] == r[0]], 2):
        if a[1] == b[1] and alike(a, b) >= threshold - 1e-10:
            want[a[0], b[0]] = alike(a, b)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())


def test_a_block_of_many_equal_signals(spark):
    many = spark.range(100_000).select(F.format_string("s%06d", "id").alias("id"), F.lit("x").alias("block"), F.lit("a").alias("kind"), F.lit(1).alias("band"), F.lit(2.0).alias("size"), F.lit(None).cast("array<int>").alias("ids"))
    pairs = failures.similar_pairs(many, "id", ["block"], FEATURES, 0.8)
    assert pairs.count() == 99_999 and pairs.filter("not exact or a != 's000000'").count() == 0
    assert failures.clusters(many, pairs, "id").select("cluster").distinct().count() == 1


def test_beyond_the_budget_equal_signatures_are_linked(spark):
    rows = some_signals()
    pairs = failures.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", ["block"], FEATURES, 0.3, budget=5).collect()
    assert pairs and all(r["similarity"] == 1.0 and not r["exact"] for r in pairs)


def test_stability_is_the_worst_best_overlap(spark):
    rows = some_signals(40, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = failures.similar_pairs(df, "id", ["block"], FEATURES, 0.6).cache()

    def clusters(t):
        group = {r[0]: {r[0]} for r in rows}
        for p in pairs.collect():
            if p["similarity"] >= t - 1e-12 and group[p["a"]] is not group[p["b"]]:
                both = group[p["a"]] | group[p["b"]]
                for k in both:
                    group[k] = both
        return {min(g): g for g in group.values()}

    base, jaccard = clusters(0.7), lambda a, b: len(a & b) / len(a | b)
    want = {c: min(max(jaccard(g, o) for o in clusters(t).values()) for t in (0.6, 0.8)) for c, g in base.items()}
    got = {r["cluster"]: r["stability"] for r in failures.cluster_stability(df, pairs, "id", 0.7, 0.1).collect()}
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}


def test_manifest_holds_each_files_size_and_hash(spark):
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in records.manifest(spark, SF).collect()}
    files = [p for p in Path(SF).iterdir() if p.suffix == ".parquet"]
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files}
