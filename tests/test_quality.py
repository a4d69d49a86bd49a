"""Containment and rules of data quality at their edges."""

import random
import time

import pytest

from gaugeworks.operators import data_quality, quality_rules


def test_containment_equals_looking_in_every_text(spark):
    r = random.Random(4)
    words = ["a", "ab", "abc", "b", "", "c"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for k in range(80)] + [(90, None), (91, ""), (91, "ab abc b c")]
    cuts = [(f"i{k}", d[i : i + r.randint(1, 30)]) for k in range(40) if (d := r.choice(docs)[1]) for i in [r.randrange(len(d))]]
    items = cuts + [("null", None), ("empty", ""), ("none", "zz zz zz zz"), ("one", "b"), ("two", "ab c")]
    got = {x["item_id"]: x["documents"] for x in data_quality.containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    want = {i: len({d for d, t in docs if t and n in t}) for i, n in items if n}
    assert got == {i: n for i, n in want.items() if n}


def test_containment_of_long_texts_takes_time_in_proportion(spark):
    text = " ".join(f"w{k}" for k in range(80_000))
    docs = spark.createDataFrame([(1, text), (2, text), (None, text)], "doc_id long, text string")
    items = spark.createDataFrame([("in", " ".join(f"w{k}" for k in range(500, 520))), ("out", " ".join(f"w{k}" for k in range(520, 500, -1)))], "item_id string, text string")
    began = time.monotonic()
    assert [tuple(r) for r in data_quality.containment(docs, items).collect()] == [("in", 2)]
    assert time.monotonic() - began < 60  # comparing every run with every other is 3 * 10^9 comparisons a text


def test_too_many_short_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(data_quality, "SHORT_ITEMS", 2)
    docs, items = spark.createDataFrame([(1, "x y")], "doc_id long, text string"), spark.createDataFrame([(str(k), "x") for k in range(3)], "item_id string, text string")
    with pytest.raises(ValueError):
        data_quality.containment(docs, items)


def levels(df):
    return {(r["rule"], r["subject"]): (r["level"], r["affected"]) for r in df.collect()}


def test_clean_data_have_no_violation_and_pass(spark):
    rows = [(k, str(k % 3), str(float(k)), "u" if k % 2 else "v") for k in range(60)]
    df = spark.createDataFrame(rows, "id int, flag string, x string, t string").filter("flag != '2'")
    kinds = {"flag": "BOOLEAN", "x": "NUMERIC"}
    out = quality_rules.missing_rules(df, kinds, 0.1, 0.5).unionByName(quality_rules.identifier_rules(df, "id", ["x"]))
    out = out.unionByName(quality_rules.categorical_rules(df, kinds, {"flag": ["true", "false"]}, 0.1, 5)).unionByName(quality_rules.distribution_rules(df, kinds, 3.0, 0.9, 2))
    out = out.unionByName(quality_rules.target_rules(df, "t", 0.1, 5, 0.1, ["u", "v"]))
    assert out.collect() == []
    assert {r["check"]: r["status"] for r in quality_rules.statuses(out, {"missingness": "RUN", "leakage": "NOT_APPLICABLE"}).collect()} == {"missingness": "PASS", "leakage": "NOT_APPLICABLE", "(all)": "NOT_APPLICABLE"}


def test_each_rule_is_found(spark):
    df = spark.createDataFrame([("a", "maybe", "1", None), ("a", "true", "1", "inf"), (None, None, "1", "3"), ("b", "false", "900", "x")], "id string, flag string, x string, t string")
    kinds = {"flag": "BOOLEAN", "x": "NUMERIC"}
    assert levels(quality_rules.identifier_rules(df, "id", ["flag"], unique=False)) == {("duplicate_ids", "id"): ("WARNING", 2), ("conflicting_rows_share_id", "id"): ("WARNING", 2), ("missing_ids", "id"): ("WARNING", 1)}
    assert levels(quality_rules.missing_rules(df, kinds, 0.2, 0.4)) == {("feature_missing_rate_exceeded", "flag"): ("FAIL", 1), ("row_missing_rate_exceeded", "rows"): ("FAIL", 1)}
    assert levels(quality_rules.categorical_rules(df, kinds, {"flag": ["true"]}, 0.6, 1)) == {("invalid_type", "flag"): ("FAIL", 1), ("invalid_category", "flag"): ("FAIL", 1), ("rare_categories", "flag"): ("WARNING", 2), ("cardinality_exceeded", "flag"): ("FAIL", 2)}
    got = levels(quality_rules.distribution_rules(df, {"x": "NUMERIC", "id": "NUMERIC"}, 1.0, 0.7, 3))
    assert got == {("skew_exceeds_configured", "x"): ("WARNING", 4), ("dominant_value", "x"): ("WARNING", 3), ("few_distinct_values", "x"): ("WARNING", 4), ("no_valid_values", "id"): ("INCONCLUSIVE", 0)}
    assert levels(quality_rules.target_rules(df, "t", 0.2, 1, 0.1)) == {
        ("missing_targets", "target"): ("WARNING", 1), ("missing_target_rate_exceeded", "target"): ("FAIL", 1), ("inconsistent_target_types", "target"): ("FAIL", 1), ("nonfinite_target", "target"): ("FAIL", 1),
        ("singleton_class", "class:3"): ("WARNING", 1), ("singleton_class", "class:x"): ("WARNING", 1),
    }
    assert levels(quality_rules.target_rules(df, "t", 1.0, 1, 0.1, regression=True)) == {("missing_targets", "target"): ("WARNING", 1), ("non_numeric_target", "target"): ("FAIL", 1), ("nonfinite_target", "target"): ("WARNING", 1)}
