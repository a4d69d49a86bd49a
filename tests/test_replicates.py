"""Draws, order statistics and tests of many replicates at once, against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import calibration, drift, replicates, resampling, selection


def values(spark, rows, schema="key long, g string, v double"):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("limit", [1, 3, 1_000_000])
def test_order_statistics_are_exact_whatever_a_task_may_order(spark, monkeypatch, limit):
    monkeypatch.setattr(selection, "LIMIT", limit)
    monkeypatch.setattr(selection, "RANGES", 4)
    rng = np.random.default_rng(1)
    rows = [(k, "ab"[k % 2], float(rng.integers(12)) if k % 3 else 5.0) for k in range(200)] + [(900, None, 2.0), (901, None, None), (902, "c", float("nan")), (903, "d", 1.5)]
    df = values(spark, rows)
    got = {r["g"]: r for r in selection.quantiles(df, "v", {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}, ["g"]).collect()}
    near = {r["g"]: r["m"] for r in selection.nearest_ranks(df, "v", {"m": 0.95}, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g in ("a", "b", None, "d"):
        own = np.sort([v for _, h, v in rows if h == g and v is not None and not math.isnan(v)])
        assert [got[g][k] for k in "abcd"] == pytest.approx(np.quantile(own, [0, 0.31, 0.5, 1]).tolist()) and got[g]["n"] == len(own)
        assert near[g] == own[math.ceil(0.95 * len(own)) - 1]
    whole = selection.quantiles(df, "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["m"] == np.median([v for *_, v in rows if v is not None and not math.isnan(v)])


def test_order_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "key long, g string, v double")
    assert selection.quantiles(empty, "v", {"m": 0.5}, ["g"]).collect() == []
    assert [tuple(r) for r in selection.quantiles(empty, "v", {"m": 0.5}).collect()] == [(0, None)]


@pytest.mark.parametrize("bits, strip", [(2, 3), (12, 2048)])
def test_replicates_medians_follow_their_draws(spark, monkeypatch, bits, strip):
    monkeypatch.setattr(replicates, "BLOCK_BITS", bits)
    monkeypatch.setattr(replicates, "STRIP", strip)
    rng = np.random.default_rng(2)
    rows = [(k, "a", float(rng.integers(15))) for k in range(120)]
    df = values(spark, rows)
    draws = replicates.Draws("counts", 3, 20)
    placed = replicates.ordered(df, "v", replicates.number(3, F.col("key")))
    all_rows = placed.collect()
    w = draws.matrix(np.array([r["x"] for r in all_rows], np.int64))
    v = np.array([r["v"] for r in all_rows])
    got = {r["replicate"]: r for r in replicates.order_statistics(placed, draws, {"lo": F.floor((F.col("n") + 1) / 2), "last": F.col("n")}).collect()}
    for r in range(21):
        own = np.sort(np.repeat(v, w[:, r]))
        assert (got[r]["n"], got[r]["lo"], got[r]["last"]) == (len(own), own[(len(own) + 1) // 2 - 1], own[-1])
    sums = {(r["g"], r["replicate"]): r["s"] for r in replicates.replicate_sums(df, draws, replicates.number(3, F.col("key")), {"s": F.col("v")}, ["g"]).collect()}
    assert [sums["a", r] for r in range(21)] == pytest.approx((w * v[:, None]).sum(0).tolist())


def test_counts_are_drawn_as_poisson():
    x = np.random.default_rng(4).integers(0, replicates.PRIME, 20_000)
    w = replicates.Draws("counts", 5, 30).matrix(x)[:, 1:]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert np.abs(np.corrcoef(w.T) - np.eye(30)).max() < 0.04


@pytest.mark.parametrize("reach", [6.0, 0.01])
def test_splits_have_the_size_asked_for(spark, monkeypatch, reach):
    monkeypatch.setattr(replicates, "REACH", reach)
    df = spark.range(500).select(replicates.number(9, F.col("id")).alias("x"))
    draws = replicates.split_thresholds(df, F.col("x"), 173, 500, 9, 25)
    x = np.array([r["x"] for r in df.collect()], np.int64)
    assert (draws.matrix(x, np.zeros(500, bool))[:, 1:].sum(0) == 173).all()


def sided(spark, seed=6, n=90, shift=0.4):
    rng = np.random.default_rng(seed)
    rows = [(k, "comparison" if k % 3 == 0 else "reference", float(np.round(rng.normal(shift if k % 3 == 0 else 0), 1))) for k in range(n)]
    return rows, spark.createDataFrame(rows + [(1000, "reference", None), (1001, "comparison", float("inf")), (1002, None, 1.0)], "key long, side string, v double")


def ks(v, label):
    at = np.unique(v)
    return max(abs((v[label] <= t).mean() - (v[~label] <= t).mean()) for t in at)


@pytest.mark.parametrize("strip, parts", [(1, 7), (5, 3), (2048, 1)])
def test_gaps_of_all_replicates_equal_plain_ones(spark, monkeypatch, strip, parts):
    monkeypatch.setattr(drift, "STRIP", strip)
    rows, df = sided(spark)
    got = drift.ks_permutation(df.repartition(parts), "v", "key", 50, 3).first()
    v, own = np.array([r[2] for r in rows]), np.array([r[1] == "comparison" for r in rows])
    x = np.array([r["x"] for r in df.limit(len(rows)).select(replicates.number(3, F.col("key")).alias("x")).collect()], np.int64)
    a, b = replicates.coefficients(3, 50)
    hits = sum(ks(v, np.isin(np.arange(len(x)), np.argsort((x * a[r] + b[r]) % replicates.PRIME)[: own.sum()])) >= ks(v, own) - 1e-12 for r in range(50))
    assert (got["statistic"], got["hits"], got["exact"]) == (pytest.approx(ks(v, own), abs=1e-8), hits, False)
    assert got["p"] == pytest.approx((hits + 1) / 51, abs=1e-8)


def test_all_splits_of_few_rows(spark):
    rows = [(k, "comparison" if k < 4 else "reference", float(v)) for k, v in enumerate([3, 5, 8, 9, 1, 2, 4, 5, 5])]
    got = drift.ks_permutation(spark.createDataFrame(rows, "key long, side string, v double"), "v", "key", minimum=2).first()
    v = np.array([r[2] for r in rows])
    observed = ks(v, np.arange(9) < 4)
    hits = sum(ks(v, np.isin(np.arange(9), c)) >= observed - 1e-12 for c in itertools.combinations(range(9), 4))
    assert (got["exact"], got["replicates"], got["hits"]) == (True, 126, hits) and got["p"] == pytest.approx(hits / 126, abs=1e-8)


def test_too_few_values_have_no_p(spark):
    rows = [(k, "reference" if k else "comparison", float(k)) for k in range(8)]
    df = spark.createDataFrame(rows, "key long, side string, v double")
    for test in (drift.ks_permutation, drift.js_permutation):
        assert test(df, "v", "key").first()[4:] == (0, False, None, "INSUFFICIENT_EVIDENCE")
        assert test(df.filter("side = 'reference'"), "v", "key").first()["status"] == "UNDEFINED"
    many = spark.range(600).selectExpr("id AS key", "if(id % 2 = 0, 'reference', 'comparison') AS side", "cast(id AS string) AS c")
    assert drift.js_permutation(many, "c", "key").first()["status"] == "UNDEFINED"


def test_entries_say_why_a_feature_cannot_be_compared(spark):
    rows = [(k, k % 4, float(k) if k % 4 else None, f"c{k}" if k % 4 < 2 else "same") for k in range(1200)]
    df = spark.createDataFrame(rows, "key long, day int, v double, c string")
    plan = spark.createDataFrame([(1, 1, 2, 0, 1, "PLANNED"), (2, 2, 3, 3, 4, "PLANNED"), (3, 3, 4, 2, 3, "NO_REFERENCE")], "window int, lo int, hi int, ref_lo int, ref_hi int, status string")
    got = {(r["feature"], r["window"]): r for r in drift.shift_entries(df, F.col("day"), plan, ["v"], ["c"]).collect()}
    assert (got["v", 1]["status"], got["v", 1]["reason"], got["v", 1]["excluded"]) == ("UNDEFINED", "EMPTY_SIDE", 300)
    assert (got["c", 1]["status"], got["c", 1]["reason"], got["c", 1]["jensen_shannon"]) == ("UNDEFINED", "TOO_MANY_CATEGORIES", None)
    assert (got["c", 2]["status"], got["c", 2]["jensen_shannon"], got["c", 2]["total_variation"]) == ("DERIVED", 0.0, 0.0)
    assert got["v", 2]["ks"] == pytest.approx(1 / 300, abs=1e-8) and len(got) == 4


def predictions(spark, n=150, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(k, side, int(rng.random() < 0.6), 1, float(np.round(0.5 + rng.random() / 2, 2))) for k in range(n) for side in "ab"]
    return spark.createDataFrame(rows, "key long, side string, y_true int, y_pred int, confidence double")


def test_equal_sides_do_not_differ(spark):
    a = predictions(spark).filter("side = 'a'")
    both = a.unionByName(a.withColumn("side", F.lit("b")))
    for r in calibration.calibration_difference(both, [0.0, 0.7, 0.8, 1.0], "key", True, 30, 30).collect():
        assert (r["estimate"], r["lower"], r["upper"], r["p"]) == (0.0, 0.0, 0.0, 1.0)


def test_intervals_hold_the_estimate_and_shrink_with_rows(spark):
    few, many = predictions(spark, 60), predictions(spark, 2000)
    width = {}
    for name, df in (("few", few), ("many", many)):
        found = {r["measure"]: r for r in calibration.bootstrap_bundle(df.filter("side = 'a'"), [0.0, 0.7, 1.0], "key", 100).collect()}
        assert found["accuracy"]["lower"] <= found["accuracy"]["estimate"] <= found["accuracy"]["upper"]
        width[name] = found["accuracy"]["upper"] - found["accuracy"]["lower"]
    assert width["many"] < 0.4 * width["few"]


@pytest.mark.parametrize("v", [[1.0, 2.0, 4.0, 8.0, 9.0, 13.0, 15.0], [3.0, 4.0, 9.0, 12.0, 13.0, 20.0]])
def test_the_acceleration_of_a_median_is_that_of_its_jackknife(spark, v):
    got = resampling.bootstrap_median(spark.createDataFrame(list(enumerate(v)), "key long, v double"), "v", "key", 100).first()
    jack = [np.median(v[:k] + v[k + 1 :]) for k in range(len(v))]
    d = np.mean(jack) - np.array(jack)
    assert got["acceleration"] == pytest.approx((d**3).sum() / (6 * (d**2).sum() ** 1.5), abs=1e-8) and got["estimate"] == np.median(v)


def test_medians_without_an_interval(spark):
    df = spark.createDataFrame([(k, 5.0) for k in range(20)], "key long, v double")
    assert resampling.bootstrap_median(df, "v", "key", 50).first()["status"] == "UNDEFINED"
    assert resampling.bootstrap_median(df.limit(1), "v", "key", 50).first()["status"] == "INCONCLUSIVE"
