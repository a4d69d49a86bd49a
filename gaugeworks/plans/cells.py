"""Queries on the four cells of a design, on failures and interactions by slice and on scored models, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..functions import rng
from ..operators import cells as K
from ..operators import models as M
from ..operators import slices as L
from .evaluation import PB, q9
from .evidence import _CS, signals
from .shift import _wilson
from .slicing import _SL, REAL
from .stress import u

P = frames.pred_bin
FIELDS = ("error", "true_class_probability")
RUNS = [(c, t) for c in K.CELLS for t in (1, 2)]


def runs(s, d):
    """The length predictor under noise (A), damping (B), both and neither, in two trials each: (cell, trial, sample_id, y_true, error, true_class_probability, lang, score)."""
    each = []
    for c, t in RUNS:
        v = F.col("score")
        if "A" in c:
            v = v + 0.3 * (2 * rng.uniform(50 + t, F.col("sample_id")) - 1)
        if c in ("B", "AB"):
            v = v * F.lit(0.7 + 0.1 * t)
        each.append(F.struct(F.lit(c).alias("cell"), F.lit(t).alias("trial"), F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)).alias("v")))
    control = [e for e, (c, _) in zip(each, RUNS) if c == "CONTROL"]
    assert len(control) == 2
    rows = P(s, d).select("sample_id", "y_true", "lang", "score", F.inline(F.array(*each)))
    wrong = ((F.col("v") >= 0.5).cast("int") != F.col("y_true")).cast("double")
    probability = F.when(F.col("sample_id") % 7 != 0, F.when(F.col("y_true") == 1, F.col("v")).otherwise(1 - F.col("v")))
    return rows.select("cell", "trial", "sample_id", "y_true", "lang", "score", wrong.alias("error"), probability.alias("true_class_probability"))


def damaged(s, d):
    """Some samples are missing in a run, twice in one, or have another truth in one."""
    r = runs(s, d).filter(~((F.col("sample_id") % 29 == 0) & (F.col("cell") == "B") & (F.col("trial") == 2)))
    r = r.withColumn("y_true", F.when((F.col("sample_id") % 37 == 0) & (F.col("cell") == "AB"), 1 - F.col("y_true")).otherwise(F.col("y_true")))
    twice = F.when((F.col("sample_id") % 31 == 0) & (F.col("cell") == "A") & (F.col("trial") == 1), 2).otherwise(1)
    return r.withColumn("__n", F.explode(F.sequence(F.lit(1), twice))).drop("__n")


def samples(s, d):
    return K.aligned(damaged(s, d), "sample_id", "y_true", FIELDS)


def contrasts(s, d):
    return K.sample_contrasts(samples(s, d), "sample_id", "y_true", FIELDS)


def modes(s, d):
    """Failure signatures by nation as runs, whose treatment is the remainder of the nation's key; a signature of few signals isn't confirmed."""
    x = signals(s, d).select(F.col("signature").alias("mode"), "run")
    size = x.groupBy("mode").agg(F.count("*").alias("n"))
    cell = F.element_at(F.array(*map(F.lit, K.CELLS)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    nations = frames.table(s, d, "nation").select(F.col("n_nationkey").alias("run"), cell.alias("cell"))
    return K.modes_across_cells(x.join(size, "mode").withColumn("confirmed", F.col("n") >= 3), nations, 0.1)


def touched(s, d):
    """Samples of the predictor that each kind of failure touches."""
    p = P(s, d)
    kind = F.array_compact(F.array(F.when((F.col("y_pred") == 1) & (F.col("y_true") == 0), "FALSE_POSITIVE"), F.when((F.col("y_pred") == 0) & (F.col("y_true") == 1), "FALSE_NEGATIVE"), F.when((F.col("y_pred") != F.col("y_true")) & (F.col("confidence") >= 0.8), "SURE_ERROR")))
    return p.select(F.explode(kind).alias("mode"), "sample_id")


def by_slice(s, d):
    rows = runs(s, d)
    return K.slice_contrasts(L.in_slices(rows, REAL).select("slice", "cell", "trial", "true_class_probability"), "true_class_probability")


def vectors(s, d):
    return frames.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def fitted(s, d):
    """Means of a third of the vectors."""
    return M.parameters(vectors(s, d).filter("vec_id % 3 = 0"), "embedding", "label")


FAMILIES = [("PARAMETER_SCALE", 0.5, 0), ("PARAMETER_NOISE", 1.5, 61), ("PARAMETER_DROP", 0.6, 62)]
QUERIES = {
    "four_cell_alignment": lambda s, d: K.alignment(samples(s, d)),
    "four_cell_samples": contrasts,
    "four_cell_summary": lambda s, d: K.contrast_summary(contrasts(s, d), "y_true"),
    "modes_across_cells": modes,
    "failures_by_slice": lambda s, d: K.failures_by_slice(touched(s, d), L.in_slices(P(s, d), REAL).select("slice", "sample_id"), "sample_id"),
    "interaction_by_slice": by_slice,
    "model_scores": lambda s, d: M.score(vectors(s, d).select("vec_id", "embedding"), "embedding", M.model_of(fitted(s, d))).select("vec_id", "y_pred", (F.floor(F.col("score") * 1e6 + 0.5) / F.lit(1e6)).alias("score"), (F.floor(F.col("margin") * 1e6 + 0.5) / F.lit(1e6)).alias("margin")),
    "model_stress": lambda s, d: M.stress(vectors(s, d), "vec_id", "embedding", "label", fitted(s, d), FAMILIES),
}


def _run(c: str, t: int) -> str:
    v = "score"
    if "A" in c:
        v = f"({v} + 0.3 * (2 * {u(50 + t)} - 1))"
    if c in ("B", "AB"):
        v = f"{v} * {0.7 + 0.1 * t!r}::DOUBLE"
    return f"SELECT '{c}' AS cell, {t} AS trial, sample_id, y_true, lang, score, greatest(least({v}, 1.0), 0.0) AS v FROM p"


_RUNS = f"""{PB}, rw AS ({' UNION ALL '.join(_run(c, t) for c, t in RUNS)}),
rn AS (SELECT cell, trial, sample_id, y_true, lang, score, CASE WHEN CAST(v >= 0.5 AS INTEGER) <> y_true THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS error, CASE WHEN sample_id % 7 <> 0 THEN CASE WHEN y_true = 1 THEN v ELSE 1 - v END END AS true_class_probability FROM rw)"""
_DAMAGED = f"""{_RUNS}, d1 AS (SELECT * REPLACE (CASE WHEN sample_id % 37 = 0 AND cell = 'AB' THEN 1 - y_true ELSE y_true END AS y_true) FROM rn WHERE NOT (sample_id % 29 = 0 AND cell = 'B' AND trial = 2)),
dm AS (SELECT * FROM d1 UNION ALL SELECT * FROM d1 WHERE sample_id % 31 = 0 AND cell = 'A' AND trial = 1)"""
_MEANS = ", ".join(f"avg({f}) FILTER (cell = '{c}') AS {f}_{c}" for f in FIELDS for c in K.CELLS)
_SAMPLES = f"""{_DAMAGED}, sm AS (SELECT sample_id, CASE WHEN sample_id % 37 = 0 THEN NULL ELSE min(y_true) END AS y_true, CASE WHEN sample_id % 31 = 0 THEN 'DOUBLED' WHEN min(y_true) <> max(y_true) THEN 'DIFFERENT_TRUTH' WHEN count(DISTINCT cell || trial) < 8 THEN 'MISSING_RUNS' ELSE 'ALIGNED' END AS alignment, {_MEANS} FROM dm GROUP BY sample_id)"""


def _field(f: str) -> str:
    ok = f"alignment = 'ALIGNED' AND {f}_CONTROL IS NOT NULL"
    show = lambda x: f"CASE WHEN {ok} THEN {q9(x)} END"
    y0, a, b, ab = (f"{f}_{c}" for c in K.CELLS)
    return f"""SELECT sample_id, y_true, '{f}' AS field, {show(y0)} AS y0, {show(a)} AS ya, {show(b)} AS yb, {show(ab)} AS yab, {show(f'{a} - {y0}')} AS effect_a, {show(f'{b} - {y0}')} AS effect_b, {show(f'{ab} - {y0}')} AS combined,
{show(f'{ab} - {a} - {b} + {y0}')} AS contrast, CASE WHEN alignment <> 'ALIGNED' THEN 'REFUSED' WHEN {y0} IS NULL THEN 'UNDEFINED' ELSE 'VALID' END AS status, CASE WHEN alignment <> 'ALIGNED' THEN alignment WHEN {y0} IS NULL THEN 'CONTROL,A,B,AB' END AS reason FROM sm"""


_CONTRASTS = f"{_SAMPLES}, ct AS ({' UNION ALL '.join(_field(f) for f in FIELDS)})"
_INS = "ins AS (" + " UNION ALL ".join(f"SELECT '{k}' AS slice, * FROM {{0}} WHERE {c}" for k, c in {"(all)": "TRUE", **_SL}.items()) + ")"
_VEC = "uv AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS i FROM embeddings), pm AS (SELECT CAST(label AS VARCHAR) AS class, i, avg(v) AS w FROM uv WHERE vec_id % 3 = 0 GROUP BY 1, 2)"


def _scores(name: str, weights: str) -> str:
    """CTEs name(vec_id, y_pred, score, margin) by dot products with weights(class, i, w)."""
    return f"""{name}_b AS (SELECT class, -sum(w * w) / 2 AS b FROM {weights} GROUP BY class), {name}_z AS (SELECT vec_id, class, sum(v * w) + any_value(b) AS z FROM uv JOIN {weights} USING (i) JOIN {name}_b USING (class) GROUP BY vec_id, class),
{name} AS (SELECT vec_id, arg_max(class, z) AS y_pred, max(z) AS score, max(z) - (list_sort(list(z), 'DESC'))[2] AS margin FROM {name}_z GROUP BY vec_id)"""


def _families() -> str:
    changed = {"PARAMETER_SCALE": "w * 0.5::DOUBLE", "PARAMETER_NOISE": f"w + 1.5 * rms * (2 * {u(61, 'class', chr(32) + '||' + repr(':') + '|| i')} - 1)", "PARAMETER_DROP": f"CASE WHEN {u(62, 'class', chr(32) + '||' + repr(':') + '|| i')} < 0.6 THEN 0.0 ELSE w END"}
    ctes, rows = [], []
    for k, (family, amount, seed) in enumerate(FAMILIES):
        ctes += [f"w{k} AS (SELECT class, i, {changed[family]} AS w FROM pm JOIN rm USING (class))", _scores(f"f{k}", f"w{k}")]
        rows.append(f"SELECT '{family}' AS family, {amount}::DOUBLE AS amount, CAST({seed} AS INTEGER) AS seed, count(*) AS n, {q9('avg(CASE WHEN x.y_pred = CAST(label AS VARCHAR) THEN 1.0 ELSE 0.0 END)')} AS accuracy, {q9('avg(CASE WHEN b0.y_pred = CAST(label AS VARCHAR) THEN 1.0 ELSE 0.0 END)')} AS baseline, "
                    f"{q9('(count(*) FILTER (x.y_pred = CAST(label AS VARCHAR)) - count(*) FILTER (b0.y_pred = CAST(label AS VARCHAR))) / count(*)')} AS delta, count(*) FILTER (x.y_pred <> b0.y_pred) AS changed, count(*) FILTER (b0.y_pred = CAST(label AS VARCHAR) AND x.y_pred <> CAST(label AS VARCHAR)) AS newly_wrong FROM f{k} x JOIN b0 USING (vec_id) JOIN embeddings USING (vec_id)")
    return f"WITH {_VEC}, rm AS (SELECT class, sqrt(avg(w * w)) AS rms FROM pm GROUP BY class), {_scores('b0', 'pm')}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


SQL = {
    "four_cell_alignment": f"WITH {_SAMPLES} SELECT alignment, count(*) AS samples, CASE WHEN alignment IN ('DOUBLED', 'DIFFERENT_TRUTH') THEN 'REFUSED' WHEN alignment = 'ALIGNED' THEN 'COMPUTED' ELSE 'INCOMPLETE' END AS status FROM sm GROUP BY alignment",
    "four_cell_samples": f"WITH {_CONTRASTS} SELECT * FROM ct",
    "four_cell_summary": f"""WITH {_CONTRASTS} SELECT field, CAST(y_true AS VARCHAR) AS class, count(*) AS n, {q9('avg(contrast)')} AS mean_contrast, count(*) FILTER (contrast > 0) AS positive, count(*) FILTER (contrast < 0) AS negative, count(*) FILTER (contrast = 0) AS zero
FROM ct WHERE status = 'VALID' GROUP BY GROUPING SETS ((field, CAST(y_true AS VARCHAR)), (field))""",
    "modes_across_cells": f"""WITH {_CS}, x AS (SELECT signature AS mode, run, CASE run % 4 WHEN 0 THEN 'CONTROL' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'AB' END AS cell, count(*) OVER (PARTITION BY signature) >= 3 AS confirmed FROM ss),
n AS (SELECT count(*) FILTER (n_nationkey % 4 = 1) AS na, count(*) FILTER (n_nationkey % 4 = 2) AS nb, count(*) FILTER (n_nationkey % 4 = 3) AS nab FROM nation),
g AS (SELECT mode, bool_or(confirmed) AS confirmed, count(DISTINCT run) FILTER (cell = 'A') / any_value(na) AS pa, count(DISTINCT run) FILTER (cell = 'B') / any_value(nb) AS pb, count(DISTINCT run) FILTER (cell = 'AB') / any_value(nab) AS pab FROM x, n WHERE cell <> 'CONTROL' GROUP BY mode)
SELECT mode, confirmed, {q9('pa')} AS prevalence_a, {q9('pb')} AS prevalence_b, {q9('pab')} AS prevalence_ab, array_to_string(list_filter([CASE WHEN NOT confirmed THEN 'INSUFFICIENT_EVIDENCE' END, CASE WHEN pab > 0 THEN 'OBSERVED_UNDER_COMPOUND_TREATMENT' END,
CASE WHEN pab = 0 THEN 'REDUCED_PREVALENCE' WHEN greatest(pa, pb) = 0 THEN 'NEWLY_OBSERVED' WHEN round(pab - greatest(pa, pb), 12) >= 0.1 THEN 'INCREASED_PREVALENCE' WHEN round(greatest(pa, pb) - pab, 12) >= 0.1 THEN 'REDUCED_PREVALENCE' ELSE 'PERSISTING' END], lambda s: s IS NOT NULL), '+') AS states, '' AS low_cells FROM g""",
    "failures_by_slice": f"""WITH {PB}, {_INS.format('p')}, t AS (SELECT sample_id, unnest(list_filter([CASE WHEN y_pred = 1 AND y_true = 0 THEN 'FALSE_POSITIVE' END, CASE WHEN y_pred = 0 AND y_true = 1 THEN 'FALSE_NEGATIVE' END, CASE WHEN y_pred <> y_true AND confidence >= 0.8 THEN 'SURE_ERROR' END], lambda m: m IS NOT NULL)) AS mode FROM p),
z AS (SELECT slice, count(*) AS samples FROM ins GROUP BY slice), h AS (SELECT mode, slice, count(*) AS k FROM t JOIN ins USING (sample_id) GROUP BY 1, 2), m AS (SELECT mode, k AS all_k FROM h WHERE slice = '(all)'),
r AS (SELECT mode, z.slice, coalesce(k, 0) AS k, samples, all_k - coalesce(k, 0) AS ok, (SELECT samples FROM z WHERE slice = '(all)') - samples AS os FROM m CROSS JOIN z LEFT JOIN h USING (mode, slice) WHERE z.slice <> '(all)')
SELECT mode, slice, k AS affected, samples, {q9('k / samples')} AS share, {q9(_wilson('k', 'samples', False))} AS lower, {q9(_wilson('k', 'samples', True))} AS upper, ok AS outside_affected, os AS outside_samples, {q9('ok / os')} AS outside_share, {q9(_wilson('ok', 'os', False))} AS outside_lower, {q9(_wilson('ok', 'os', True))} AS outside_upper, k > 0 AS present FROM r""",
    "interaction_by_slice": f"""WITH {_RUNS}, {_INS.format('rn')}, t AS (SELECT slice, trial, {', '.join(f"avg(true_class_probability) FILTER (cell = '{c}') AS c{k}" for k, c in enumerate(K.CELLS))} FROM ins GROUP BY slice, trial)
SELECT slice, count(*) AS trials, CAST(0 AS BIGINT) AS dropped, {q9('avg(c0)')} AS control, {q9('avg(c1)')} AS a, {q9('avg(c2)')} AS b, {q9('avg(c3)')} AS ab, {q9('avg(c3) - avg(c1) - avg(c2) + avg(c0)')} AS contrast, 'COMPUTED' AS status FROM t GROUP BY slice""",
    "model_scores": f"WITH {_VEC}, {_scores('s', 'pm')} SELECT vec_id, y_pred, floor(score * 1e6 + 0.5) / 1e6 AS score, floor(margin * 1e6 + 0.5) / 1e6 AS margin FROM s",
    "model_stress": _families(),
}
