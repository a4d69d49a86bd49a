"""Comparisons at their borders, and against plain versions."""

import statistics

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import comparisons as K


def one(df):
    return df.collect()[0].asDict()


def sides(spark, a, b):
    rows = [(i, "a", v) for i, v in enumerate(a)] + [(i, "b", v) for i, v in enumerate(b)]
    return spark.createDataFrame(rows, "k long, g string, v double")


@pytest.mark.parametrize("estimator", ["mean", "median"])
def test_acceleration_equals_that_of_a_plain_jackknife(spark, estimator):
    a, b = [1.0, 2.0, 9.0, 4.5, 3.0, 12.0, 7.5], [5.0, 6.0, 20.0, 8.0, 11.0, 13.5]
    r = one(K.difference_interval(sides(spark, a, b), "g", "v", "k", "a", "b", estimator, replicates=60))
    f = getattr(statistics, estimator)
    jack = [f(b) - f(a[:i] + a[i + 1 :]) for i in range(len(a))] + [f(b[:i] + b[i + 1 :]) - f(a) for i in range(len(b))]
    bar = sum(jack) / len(jack)
    want = sum((bar - t) ** 3 for t in jack) / (6 * sum((bar - t) ** 2 for t in jack) ** 1.5)
    assert (r["n_a"], r["n_b"]) == (7, 6)
    assert r["estimate"] == pytest.approx(f(b) - f(a), abs=1e-8)
    assert r["acceleration"] == pytest.approx(want, abs=1e-8)
    assert r["percentile_lower"] <= r["estimate"] <= r["percentile_upper"] and r["status"] == "DERIVED"


@pytest.mark.parametrize("estimator", ["mean", "median"])
def test_few_values_constant_values_and_none(spark, estimator):
    ask = lambda a, b: one(K.difference_interval(sides(spark, a, b), "g", "v", "k", "a", "b", estimator, replicates=20))
    few = ask([1.0], [2.0, 3.0])
    assert few["status"] == "INCONCLUSIVE" and few["lower"] is None and few["estimate"] is None
    flat = ask([2.0] * 12, [5.0] * 12)
    assert (flat["status"], flat["lower"], flat["upper"]) == ("DERIVED", 3.0, 3.0)
    empty = ask([], [])
    assert (empty["n_a"], empty["n_b"], empty["status"]) == (0, 0, "INCONCLUSIVE")
    odd = ask([1.0, float("nan"), None, 4.0], [float("inf"), 2.0, 3.0])
    assert (odd["n_a"], odd["n_b"]) == (2, 2)


def test_unknown_estimator_and_correction_are_refused(spark):
    with pytest.raises(ValueError):
        K.difference_interval(sides(spark, [1.0], [2.0]), "g", "v", "k", "a", "b", "mode")
    with pytest.raises(ValueError):
        K.corrected(spark.createDataFrame([(0.1, "x")], "p double, k string"), [], "k", "holm", 0.05)


def test_pairs(spark):
    rows = [(i, float(i), float(i) + 1 + i % 2) for i in range(8)] + [(8, None, 3.0), (9, float("nan"), 3.0)]
    r = one(K.compare_pairs(spark.createDataFrame(rows, "k long, x double, y double"), "k"))
    assert r["n"] == 8 and r["mean_difference"] == 1.5 and r["status"] == "DERIVED"
    assert r["p"] == pytest.approx(2 / 256)  # all sign patterns
    assert 1.0 <= r["lower"] <= r["upper"] <= 2.0
    for rows in ([], [(1, 1.0, 2.0)]):
        r = one(K.compare_pairs(spark.createDataFrame(rows, "k long, x double, y double"), "k"))
        assert (r["n"], r["status"], r["p"], r["lower"]) == (len(rows), "INCONCLUSIVE", None, None)


def group_rows(spark, n_a, n_b):
    rows = [(i, "a" if i < n_a else "b", None if i >= n_a and i % 2 == 0 else "x", 1.0) for i in range(n_a + n_b)]
    return spark.createDataFrame(rows, "k long, g string, c string, v double")


def compared(df, **more):
    aspects = {"missingness": {"c": F.col("c").isNull(), "v": F.col("v").isNull()}, "validity": {"v": F.col("v") < 0}}
    return {(r["aspect"], r["feature"]): r for r in K.group_comparison(df, "g", "a", "b", "k", aspects, **more).collect()}


def test_rates_of_groups(spark):
    got = compared(group_rows(spark, 60, 60))
    gone = got["missingness", "c"]
    assert (gone["k_reference"], gone["k_comparison"], gone["difference"]) == (0, 30, 0.5)
    assert gone["p"] == pytest.approx(1 / 200) and gone["m"] == 2 and gone["rejected"]
    assert got["missingness", "v"]["p"] == 1.0 and not got["missingness", "v"]["rejected"]
    assert got["validity", "v"]["p"] is None and got["validity", "v"]["m"] == 0


def test_small_and_empty_groups_have_rates_but_no_p(spark):
    few = compared(group_rows(spark, 4, 6))["missingness", "c"]
    assert (few["status"], few["p"], few["k_comparison"]) == ("INSUFFICIENT_EVIDENCE", None, 3)
    none = compared(group_rows(spark, 0, 6))["missingness", "c"]
    assert (none["status"], none["n_reference"], none["rate_reference"], none["k_comparison"]) == ("INCONCLUSIVE", 0, None, 3)
    assert compared(group_rows(spark, 0, 0))["missingness", "c"]["status"] == "INCONCLUSIVE"


def test_all_splits_of_few_rows(spark):
    got = compared(group_rows(spark, 4, 4), minimum=2)["missingness", "c"]
    # 2 of 8 are missing, both in b: of the 70 splits, 15 put both into b and 15 both into a
    assert got["p"] == pytest.approx(30 / 70, abs=1e-9)


def test_corrections_of_a_family(spark):
    rows = [("g%d" % g, i, 1.0 if g == 0 or i % 2 else -1.0) for g in range(3) for i in range(40)] + [("lone", 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k long, d double")
    got = {m: {r["g"]: r for r in K.paired_family(df, "g", "k", F.col("d"), m, replicates=199).collect()} for m in K.CORRECTIONS}
    assert got["none"]["g0"]["p"] == pytest.approx(1 / 200) and got["none"]["g0"]["rejected"] is None
    assert got["bonferroni"]["g0"]["adjusted"] == pytest.approx(3 / 200)
    assert got["benjamini_hochberg"]["g0"]["rejected"] and not got["benjamini_hochberg"]["g1"]["rejected"]
    assert all(g["lone"]["p"] is None and g["lone"]["m"] == 3 for g in got.values())


PROTOCOLS = [("s1", "data", "d1"), ("s1", "model", "m1"), ("s2", "data", "d1"), ("s2", "model", "m2"), ("s3", "data", "d2"), ("s3", "model", "m1"), ("s3", "extra", None)]
RESULTS = [("s1", "base", "acc", 0.5), ("s1", "base", "f1", 0.25), ("s2", "base", "acc", 0.75), ("s2", "base", "auc", 0.9), ("s3", "base", "acc", 0.1)]


def test_submissions_are_compared_only_under_one_protocol(spark):
    p, r = spark.createDataFrame(PROTOCOLS, "submission string, field string, value string"), spark.createDataFrame(RESULTS, "submission string, section string, key string, value double")
    pairs = spark.createDataFrame([("s1", "s2"), ("s1", "s2"), ("s1", "s3"), ("x", "y")], "a string, b string")
    got = sorted(tuple(x) for x in K.compare_submissions(p, r, pairs).collect())
    assert got == [
        ("s1", "s2", "base", "acc", 0.5, 0.75, 0.25, "BOTH"), ("s1", "s2", "base", "auc", None, 0.9, None, "ONLY_B"), ("s1", "s2", "base", "f1", 0.25, None, None, "ONLY_A"),
        ("s1", "s3", "protocol", "data", None, None, None, "PROTOCOL_DIFFERS"), ("s1", "s3", "protocol", "extra", None, None, None, "PROTOCOL_DIFFERS"),
    ]


def test_additive_description_uses_shared_keys_only(spark):
    rows = [("CONTROL", 1, 1.0), ("A", 1, 2.0), ("A", 2, 99.0), ("B", 1, 4.0), ("AB", 1, 10.0)]
    r = one(K.additive_description(spark.createDataFrame(rows, "cell string, k long, v double"), "k", ["v"]))
    assert (r["n_a"], r["effect_a"], r["effect_b"], r["effect_ab"], r["additive_reference"], r["difference_from_additive"]) == (1, 1.0, 3.0, 9.0, 4.0, 5.0)
    r = one(K.additive_description(spark.createDataFrame(rows[:3], "cell string, k long, v double"), "k", ["v"]))
    assert r["effect_a"] == 1.0 and r["effect_b"] is None and r["additive_reference"] is None


def test_phases(spark):
    rows = [("r", "WARM_UP", "COMPLETED", 99.0), ("r", "MEASURED", "FAILED", 50.0), ("r", "MEASURED", "COMPLETED", 1.0), ("r", "MEASURED", "COMPLETED", 3.0), ("r", None, None, 1.0)]
    rows += [("q", "WARM_UP", "COMPLETED", 1.0), (None, "MEASURED", "COMPLETED", 2.0), (None, "MEASURED", "COMPLETED", -1.0), (None, "MEASURED", "COMPLETED", None)]
    df = spark.createDataFrame(rows, "run string, phase string, state string, s double")
    got = {r["run"]: r for r in K.phase_resources(df, ["run"], "phase", "state", "s", {"p50": 0.5}).collect()}
    r = got["r"]
    assert (r["n_trials"], r["n_warm_up"], r["n_failed"], r["n"], r["mean"], r["p50"], r["throughput"], r["status"]) == (5, 1, 2, 2, 2.0, 2.0, 0.5, "DERIVED")
    assert (got["q"]["n"], got["q"]["status"]) == (0, "UNAVAILABLE") and (got[None]["n"], got[None]["status"], got[None]["std"]) == (1, "INCONCLUSIVE", None)
