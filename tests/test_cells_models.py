"""Cells of a design and scored models at their edges."""

import numpy as np
import pytest

from gaugeworks.operators import cells, models

SCHEMA = "cell string, trial int, id long, y int, v double, w double"


def design(spark, change=lambda r: [r]):
    rows = [(c, t, i, i % 2, float(i + 10 * k + t), None if i == 3 and c == "B" else 1.0) for k, c in enumerate(cells.CELLS) for t in (1, 2) for i in range(5)]
    return spark.createDataFrame([x for r in rows for x in change(r)], SCHEMA)


def states(samples):
    return {r["id"]: r["alignment"] for r in samples.collect()}


def test_samples_that_cannot_be_compared_say_why(spark):
    def change(r):
        c, t, i, y, v, w = r
        if i == 0 and c == "AB":
            return [(c, t, i, 1 - y, v, w)]
        if i == 1 and (c, t) == ("A", 1):
            return [r, r]
        return [] if i == 2 and (c, t) == ("B", 2) else [r]

    samples = cells.aligned(design(spark, change), "id", "y", ["v", "w"])
    assert states(samples) == {0: "DIFFERENT_TRUTH", 1: "DOUBLED", 2: "MISSING_RUNS", 3: "ALIGNED", 4: "ALIGNED"}
    assert {r["id"]: r["mask"] for r in samples.collect()} == dict.fromkeys(range(5), 15)
    got = {(r["id"], r["field"]): r for r in cells.sample_contrasts(samples, "id", "y", ["v", "w"]).collect()}
    assert (got[4, "v"]["contrast"], got[4, "v"]["status"], got[4, "v"]["y0"], got[4, "v"]["effect_a"]) == (0.0, "VALID", 5.5, 10.0)
    assert (got[3, "w"]["status"], got[3, "w"]["reason"], got[3, "w"]["contrast"]) == ("UNDEFINED", "B", None)
    assert (got[1, "v"]["status"], got[1, "v"]["reason"]) == ("REFUSED", "DOUBLED") and got[0, "v"]["y"] is None
    assert {r["alignment"]: r["status"] for r in cells.alignment(samples).collect()} == {"DIFFERENT_TRUTH": "REFUSED", "DOUBLED": "REFUSED", "MISSING_RUNS": "INCOMPLETE", "ALIGNED": "COMPUTED"}


def test_a_sample_of_null_truth_in_all_runs_is_aligned(spark):
    samples = cells.aligned(design(spark, lambda r: [(*r[:3], None, *r[4:])]), "id", "y", ["v"])
    assert set(states(samples).values()) == {"ALIGNED"}
    some = cells.aligned(design(spark, lambda r: [(*r[:3], None if r[0] == "A" else 1, *r[4:])]), "id", "y", ["v"])
    assert set(states(some).values()) == {"DIFFERENT_TRUTH"}


def test_states_of_modes(spark):
    runs = [(10 * k + j, c) for k, c in enumerate(("A", "B", "AB", "CONTROL")) for j in range(10)]
    shown = {"new": (0, 0, 3), "more": (2, 1, 5), "less": (5, 1, 2), "same": (4, 4, 4), "gone": (3, 0, 0), "control": (0, 0, 0)}
    signals = [(m, 10 * k + j, m != "new") for m, counts in shown.items() for k, n in enumerate(counts) for j in range(n) for _ in range(2)] + [("control", 30, True)]
    found = cells.modes_across_cells(spark.createDataFrame(signals, "mode string, run int, confirmed boolean"), spark.createDataFrame(runs, "run int, cell string"), 0.1)
    got = {r["mode"]: r["states"].replace("OBSERVED_UNDER_COMPOUND_TREATMENT", "OBS") for r in found.collect()}
    assert got == {"new": "INSUFFICIENT_EVIDENCE+OBS+NEWLY_OBSERVED", "more": "OBS+INCREASED_PREVALENCE", "less": "OBS+REDUCED_PREVALENCE", "same": "OBS+PERSISTING", "gone": "REDUCED_PREVALENCE"}


def test_slices_that_lack_a_cell(spark):
    rows = [("s", c, 1, float(k)) for k, c in enumerate(cells.CELLS)] + [("t", "A", 1, 1.0)]
    got = {r["slice"]: (r["trials"], r["dropped"], r["contrast"], r["status"]) for r in cells.slice_contrasts(spark.createDataFrame(rows, "slice string, cell string, trial int, v double"), "v").collect()}
    assert got == {"s": (1, 0, 0.0, "INSUFFICIENT_EVIDENCE"), "t": (0, 1, None, "UNDEFINED")}


def test_vectors_that_cannot_be_scored_have_no_prediction(spark):
    train = spark.createDataFrame([([1.0, 0.0], "a"), ([0.0, 1.0], "b"), ([0.0, 1.0], None)], "x array<double>, y string")
    model = models.model_of(models.parameters(train, "x", "y"))
    rows = [(1, [0.9, 0.2]), (2, [0.1, 0.8]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [0.5, 0.5])]
    got = {r["id"]: (r["y_pred"], r["margin"]) for r in models.score(spark.createDataFrame(rows, "id int, x array<double>"), "x", model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "a", 2: "b", 3: None, 4: None, 5: None, 6: None, 7: "a"}
    assert got[1][1] == pytest.approx(0.7) and got[7][1] == 0


def test_models_of_one_class_and_of_none(spark):
    rows = spark.createDataFrame([(1, [0.9, 0.2])], "id int, x array<double>")
    one = models.model_of(models.parameters(spark.createDataFrame([([1.0, 0.0], "a")], "x array<double>, y string"), "x", "y"))
    assert tuple(models.score(rows, "x", one).first()) == (1, "a", pytest.approx(0.4), None)
    none = models.model_of(models.parameters(spark.createDataFrame([], "x array<double>, y string"), "x", "y"))
    assert tuple(models.score(rows, "x", none).first()) == (1, None, None, None)
    with pytest.raises(ValueError):
        models.LinearModel.of(["a"], np.zeros((1, models.LARGEST + 1)), np.zeros(1))
