"""Values worked out by hand or by plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import identity
from gaugeworks.operators import calibration, drift, graph, ordering, resampling, slices, stats


def plain_splits(a, b):
    """(hits, splits) over all splits of the pooled values."""
    pool, n = [*a, *b], len(b)
    gap = lambda chosen: abs(sum(pool[i] for i in chosen) / n - (sum(pool) - sum(pool[i] for i in chosen)) / len(a))
    seen = gap(range(len(a), len(pool)))
    gaps = [gap(c) for c in itertools.combinations(range(len(pool)), n)]
    return sum(g >= seen - 1e-12 for g in gaps), len(gaps)


@pytest.mark.parametrize("a,b", [((3.5, 1.0, 9.0, 2.0), (8.0, 7.5, 3.0)), ((1.0, 1.0), (1.0, 1.0, 1.0)), ((0.0, 2.0, 2.0, 5.0, 7.0), (6.0, 9.0, 9.0, 1.0))])
def test_all_splits_of_few_values_are_tried(spark, a, b):
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("c", 99.0), ("a", None)], "g string, v double")
    r = stats.permutation_test(df, "g", "v", "a", "b").first()
    hits, splits = plain_splits(a, b)
    assert (r["hits"], r["replicates"], r["p"]) == (hits, splits, pytest.approx(hits / splits, abs=1e-9))


def test_one_value_in_a_group_has_no_p(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    assert stats.permutation_test(df, "g", "v", "a", "b", 9).first()["p"] is None


@pytest.mark.parametrize("d", [(0.5, -2.0, 3.0, 4.5, 1.0), (0.0, 0.0, 0.0), (7.0, 7.0)])
def test_all_signs_of_few_pairs_are_tried(spark, d):
    r = stats.sign_flip_test(spark.createDataFrame([(10.0, 10.0 + x) for x in d], "x double, y double")).first()
    means = [abs(sum(s * x for s, x in zip(signs, d))) for signs in itertools.product((1, -1), repeat=len(d))]
    assert (r["hits"], r["replicates"]) == (sum(m >= abs(sum(d)) - 1e-9 for m in means), 2 ** len(d))


def test_normal_distribution_function_and_its_inverse(spark):
    from statistics import NormalDist

    x = [-5.0, -1.3, 0.0, 0.4, 2.2, 4.9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(resampling.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(v) for v in x], abs=1e-12)
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.995]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(resampling.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(v) for v in p], abs=1e-9)


def test_running_sums_cross_ranges_and_groups(spark):
    rows = [(g, float(k * 7 % 50), k) for g in "ab" for k in range(60)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    out = ordering.running(df, ["v", "w"], {"before": F.col("w")}, ["g"], following={"next": "v"}).collect()
    for r in out:
        mine = sorted((v, w) for g, v, w in rows if g == r["g"])
        assert r["before"] == sum(w for v, w in mine if (v, w) < (r["v"], r["w"]))
        assert r["next"] == next((v for v, w in mine if (v, w) > (r["v"], r["w"])), None)
    assert len(out) == len(rows)


def test_quantile_and_summary_of_one_value(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 10, 11)], "v double")
    assert stats.quantiles(df, "v", [0.3]).first()["value"] == pytest.approx(2.4)
    one = stats.summary(df.limit(1), "v").first()
    assert one["status"] == "INCONCLUSIVE" and one["std"] is None


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert stats.pearson(df, "x", "y").first()["r"] is None


def test_wilson_ends_are_exact(spark):
    df = spark.createDataFrame([(1,), (1,)], "y int")
    r = stats.proportion(df, F.col("y") == 0).first()
    assert (r["k"], r["lower"]) == (0, 0.0) and r["warning"]


def test_shift_without_comparison_is_undefined(spark):
    df = spark.createDataFrame([("reference", 1.0), ("reference", float("nan"))], "side string, v double")
    r = drift.numeric_shift(df, "v").first()
    assert (r["status"], r["n_reference"], r["ks"]) == ("UNDEFINED", 1, None)


def test_predicates_are_three_valued(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, float("nan"), None)], "id int, x double, s string")
    types = dict(df.dtypes)
    out = lambda c: [r[0] for r in df.orderBy("id").select(slices.compile_predicate(c, types)).collect()]
    assert out({"op": "range", "field": "x", "low": 0, "high": 3}) == [True, None, None]
    assert out({"op": "not", "arg": {"op": "eq", "field": "s", "value": "a"}}) == [False, True, None]
    assert out({"op": "eq", "field": "x", "value": "2"}) == [None, None, None]
    assert out({"op": "in", "field": "s", "values": ["a", 3]}) == [True, None, None]
    with pytest.raises(ValueError):
        slices.compile_predicate({"op": "like", "field": "s"}, types)


def plain_isotonic(points):
    """Pool adjacent violators over (confidence, right): a value for each distinct confidence."""
    blocks = []
    for c in sorted({c for c, _ in points}):
        right = [r for x, r in points if x == c]
        blocks.append([sum(right), len(right), [c]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            k, n, cs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k, blocks[-1][1] + n, blocks[-1][2] + cs]
    return {c: k / n for k, n, cs in blocks for c in cs}


def graded(spark, points):
    return spark.createDataFrame([(c, r, 1) for c, r in points], "confidence double, y_true int, y_pred int")


@pytest.mark.parametrize("seed, ranges", [(3, 1), (4, 4), (5, 9), (6, 40)])
def test_isotonic_equals_pooled_violators(spark, seed, ranges):
    draw = random.Random(seed)
    points = [(draw.randint(1, 99) / 100, int(draw.random() < 0.4)) for _ in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        blocks = calibration.fit_isotonic(graded(spark, points))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = plain_isotonic(points)
    got = {c: r["k"] / r["n"] for r in blocks.collect() for c in want if r["lo"] <= c <= r["hi"]}
    assert got == pytest.approx(want, abs=1e-12)


def test_a_falling_curve_is_one_block_and_is_applied(spark):
    points = [(k / 200, int(k < 100)) for k in range(1, 200)]
    blocks = calibration.fit_isotonic(graded(spark, points))
    assert [(r["n"], r["lo"], r["hi"]) for r in blocks.collect()] == [(199, 0.005, 0.995)]
    rows = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 1.0), (4, None), (5, float("nan"))], "id int, confidence double")
    got = {r["id"]: r["calibrated"] for r in calibration.apply_isotonic(rows, blocks).collect()}
    assert got == {1: pytest.approx(99 / 199), 2: pytest.approx(99 / 199), 3: pytest.approx(99 / 199), 4: None, 5: None}
    none = calibration.fit_isotonic(graded(spark, []))
    assert none.count() == 0 and [r["calibrated"] for r in calibration.apply_isotonic(rows, none).collect()] == [None] * 5


def test_between_knots_the_map_is_a_straight_line(spark):
    blocks = calibration.fit_isotonic(graded(spark, [(0.2, 0), (0.4, 1), (0.4, 0), (0.8, 1)]))
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,), (0.5,), (0.9,)], "confidence double")
    got = [r["calibrated"] for r in calibration.apply_isotonic(rows, blocks).orderBy("confidence").collect()]
    assert got == pytest.approx([0, 0, 0.25, 0.5, 0.625, 1])


def plain_platt(points):
    """Newton steps in plain Python."""
    a, b = 1.0, 0.0
    rows = [(math.log(c / (1 - c)), r) for c, r in points]
    for _ in range(200):
        p = [1 / (1 + math.exp(-(a * x + b))) for x, _ in rows]
        ga, gb = sum((y - q) * x for (x, y), q in zip(rows, p)) - 1e-6 * a, sum(y - q for (_, y), q in zip(rows, p))
        aa, ab, bb = sum(q * (1 - q) * x * x for (x, _), q in zip(rows, p)) + 1e-6, sum(q * (1 - q) * x for (x, _), q in zip(rows, p)), sum(q * (1 - q) for q in p)
        det = aa * bb - ab * ab
        a, b = a + (bb * ga - ab * gb) / det, b + (aa * gb - ab * ga) / det
    return a, b


def test_platt_equals_plain_newton(spark):
    draw = random.Random(5)
    points = [(c, int(draw.random() < c * c)) for c in (draw.uniform(0.2, 0.95) for _ in range(200))]
    a, b = calibration.fit_platt(graded(spark, points))
    assert a > 0.5 and (a, b) == pytest.approx(plain_platt(points), abs=1e-6)


def test_platt_of_one_class_has_no_slope(spark):
    assert calibration.fit_platt(graded(spark, [(0.5, 1), (0.9, 1)])) == (0.0, pytest.approx(math.log(5)))
    assert calibration.fit_platt(graded(spark, [])) == (1.0, 0.0)


def test_long_chains_are_followed_to_the_end(spark):
    chain = spark.createDataFrame([(f"n{k + 1:03}", f"n{k:03}") for k in range(30)], "src string, dst string")
    start = spark.createDataFrame([("n000",)], "node string")
    assert dict(graph.blocked(chain, start).collect()) == {f"n{k:03}": k for k in range(1, 31)}
    edges = chain.withColumn("relation", F.lit("r"))
    assert {r["component"] for r in graph.components(edges).collect()} == {"n000"}


def test_components_leave_leaves_out_of_their_rounds(spark, monkeypatch):
    seen, stars = [], graph._stars
    monkeypatch.setattr(graph, "_stars", lambda now, total: seen.append(total) or stars(now, total))
    rows = [("a", "b"), ("b", "c"), ("c", "a")] + [("b", f"z{k}") for k in range(60)] + [("x1", "x2"), ("a", "a"), ("z7", "b"), ("c", "0")]
    got = dict(graph.components(spark.createDataFrame(rows, "src string, dst string")).collect())
    assert seen == [4]  # 61 edges of leaves, of the pair x1 and x2 one, are gone; "0" is less than its neighbour and stays
    assert got == {n: "0" for n in ["0", "a", "b", "c", *(f"z{k}" for k in range(60))]} | {"x1": "x1", "x2": "x1"}
    assert graph.components(spark.createDataFrame([("a", "a")], "src string, dst string")).collect() == []


def test_components_of_random_graphs_equal_a_plain_search(spark):
    r = random.Random(5)
    for nodes, count in ((40, 25), (60, 45), (12, 30)):
        rows = [(f"n{r.randrange(nodes):02}", f"n{r.randrange(nodes):02}") for _ in range(count)]
        low = {n: n for e in rows if e[0] != e[1] for n in e}
        for _ in low:
            for a, b in (e for e in rows if e[0] != e[1]):
                low[a] = low[b] = min(low[a], low[b])
        found = graph.components(spark.createDataFrame(rows, "src string, dst string")).collect()
        assert len(found) == len(low) and dict(found) == low


def test_difference_of_snapshots_is_each_edge_once_over_enough_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 10)
    kind = "src string, dst string, relation string"
    old = spark.createDataFrame([("a", f"b{k}", "r") for k in range(60)] * 2 + [(None, "x", "r")], kind)
    new = spark.createDataFrame([("a", f"b{k}", "r") for k in range(2, 62)] + [("a", "b61", "r"), ("a", "b5", "s"), (None, "x", "r")], kind)
    found = graph.difference(old, new)
    assert found.rdd.getNumPartitions() == 19  # 184 rows
    want = {("a", "b0", "r", "removed"), ("a", "b1", "r", "removed"), ("a", "b60", "r", "added"), ("a", "b61", "r", "added"), ("a", "b5", "s", "added")}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_joined_fields_are_told_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "-;")], "x string, y string")
    ids = [r[0] for r in df.select(identity.entity_id("t", "T", F.col("x"), F.col("y"))).collect()]
    assert len(set(ids)) == 4
