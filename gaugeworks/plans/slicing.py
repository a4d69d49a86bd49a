"""Calibration and slice queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..operators import calibration as C
from ..operators import slices as L
from .evaluation import PB, PM, q9
from .shift import _wilson

EDGES = [k / 10 for k in range(11)]
SLICES = {
    "english": {"op": "eq", "field": "lang", "value": "en"},
    "german_or_french": {"op": "in", "field": "lang", "values": ["de", "fr"]},
    "long": {"op": "range", "field": "score", "low": 0.8, "high": 0.95},
    "not_english_long": {"op": "and", "args": [{"op": "not", "arg": {"op": "eq", "field": "lang", "value": "en"}}, {"op": "range", "field": "score", "low": 0.8, "high": 2}]},
    "wrong_kind": {"op": "eq", "field": "lang", "value": 3},
    "absent_field": {"op": "is_true", "field": "verified"},
}
REAL = {k: v for k, v in SLICES.items() if k in ("english", "german_or_french", "long", "not_english_long")}
P = frames.pred_bin


def damaged(s, d):
    """Score vectors with each defect planted by id."""
    i, p = F.col("sample_id") % 50, F.col("scores")
    x = F.when(i == 1, F.lit(None)).when(i == 2, F.slice(p, 1, 4)).when(i == 3, F.transform(p, lambda v: v * 2)).when(i == 4, F.transform(p, lambda v: v / 2)).when(i == 5, F.transform(p, lambda v: v * float("nan"))).otherwise(p)
    m = frames.pred_multi(s, d)
    return m.withColumn("scores", x).withColumn("y_true", F.when(i == 6, "other").otherwise(F.col("y_true")))


def isotonic(s, d):
    """The map fitted on even samples, at the others' confidences."""
    p = P(s, d)
    blocks = C.fit_isotonic(p.filter("sample_id % 2 = 0"))
    return C.apply_isotonic(p.filter("sample_id % 2 != 0").select("sample_id", "confidence"), blocks).select("sample_id", q("calibrated").alias("calibrated"))


def platt(s, d):
    a, b = C.fit_platt(P(s, d))
    return P(s, d).select("sample_id", q(C.apply_platt(F.col("confidence"), a, b)).alias("calibrated"))


def q(c):
    from ..status import q9 as f

    return f(c)


QUERIES = {
    "row_validity": lambda s, d: C.validity_counts(damaged(s, d), frames.PRIORITIES),
    "reliability_curve": lambda s, d: C.reliability(P(s, d), EDGES),
    "reliability_curve_quantile": lambda s, d: C.reliability(P(s, d), C.quantile_edges(P(s, d), "confidence", 5)),
    "calibration_bundle": lambda s, d: C.bundle(P(s, d), EDGES),
    "calibration_bundle_by_lang": lambda s, d: C.bundle(P(s, d), EDGES, ["lang"]),
    "vector_brier_nll": lambda s, d: C.vector_scores(frames.pred_multi(s, d), frames.PRIORITIES),
    "classwise_calibration": lambda s, d: C.classwise(frames.pred_multi(s, d), frames.PRIORITIES),
    "score_entropy": lambda s, d: C.entropy(frames.pred_multi(s, d)),
    "hash_split": lambda s, d: C.hash_split(P(s, d), "sample_id", 0.3, 5).select("sample_id", "part"),
    "platt_scaling": platt,
    "isotonic_regression": isotonic,
    "slice_membership": lambda s, d: L.membership(P(s, d), SLICES),
    "slice_accuracy": lambda s, d: L.in_slices(P(s, d), REAL).groupBy("slice").agg(F.count("*").alias("n"), q(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).alias("accuracy")),
    "slice_against_rest": lambda s, d: L.compare_to_rest(P(s, d), REAL),
    "slice_overlap": lambda s, d: L.overlap(P(s, d), REAL, "sample_id"),
    "unseen_literals": lambda s, d: L.unseen(P(s, d), "lang", ["en", "xx", "fr", "zz"]),
}

_BINS = "greatest(0, " + " + ".join(f"CASE WHEN confidence >= {e} THEN 1 ELSE 0 END" for e in EDGES[1:-1]) + ")"
_RIGHT = "CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END"


def _curve(edges: str, bins: str) -> str:
    return f"""{edges}, a AS (SELECT {bins} AS bin, count(*) AS n, avg(confidence) AS c, sum({_RIGHT}) AS k FROM p GROUP BY 1)
SELECT e.bin, {q9('lower')} AS lower, {q9('upper')} AS upper, coalesce(n, 0) AS n, {q9('c')} AS confidence, {q9('k / n')} AS accuracy, {q9('k / n - c')} AS gap,
CASE WHEN n > 0 THEN {q9(_wilson('k', 'n', False))} END AS acc_lower, CASE WHEN n > 0 THEN {q9(_wilson('k', 'n', True))} END AS acc_upper,
CASE WHEN n IS NULL THEN 'EMPTY' WHEN n = 1 THEN 'SINGLE' WHEN n < 10 THEN 'SPARSE' ELSE 'OK' END AS evidence FROM e LEFT JOIN a ON a.bin = e.bin"""


_EDGE = "e AS (SELECT CAST(i AS INTEGER) AS bin, i / 10.0::DOUBLE AS lower, (i + 1) / 10.0::DOUBLE AS upper FROM range(10) t(i))"
_QEDGE = """x AS (SELECT DISTINCT v FROM (SELECT unnest(quantile_disc(confidence, [0.2, 0.4, 0.6, 0.8])) AS v FROM p) WHERE v > 0 AND v < 1),
y AS (SELECT v FROM x UNION ALL SELECT 0.0 UNION ALL SELECT 1.0), e AS (SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS bin, v AS lower, lead(v) OVER (ORDER BY v) AS upper FROM y QUALIFY lead(v) OVER (ORDER BY v) IS NOT NULL)"""


def _bundle(by: str = "") -> str:
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {PB}, r AS (SELECT *, {_BINS} AS bin, greatest(least(CASE WHEN y_true = y_pred THEN confidence ELSE 1 - confidence END, 1 - 1e-15), 1e-15) AS pp FROM p),
b AS (SELECT {b}bin, count(*) AS n, sum({_RIGHT}) AS k, sum(confidence) AS s, sum(power(confidence - {_RIGHT}, 2)) AS b, sum(-ln(pp)) AS l FROM r GROUP BY {b}bin)
SELECT {b}CAST(sum(n) AS BIGINT) AS n, {q9('sum(k) / sum(n)')} AS accuracy, {q9('sum(s) / sum(n)')} AS confidence, {q9('(sum(s) - sum(k)) / sum(n)')} AS overconfidence, {q9('sum(abs(k - s)) / sum(n)')} AS ece,
{q9('max(abs(k - s) / n)')} AS mce, {q9('sum(b) / sum(n)')} AS brier, {q9('sum(l) / sum(n)')} AS log_loss FROM b {g}"""


_LIST = "[" + ", ".join(f"'{c}'" for c in frames.PRIORITIES) + "]"
_SL = {
    "english": "lang = 'en'",
    "german_or_french": "lang IN ('de', 'fr')",
    "long": "(score >= 0.8 AND score < 0.95)",
    "not_english_long": "(NOT lang = 'en' AND score >= 0.8 AND score < 2)",
}
SQL = {
    "row_validity": f"""WITH {PM} SELECT CASE sample_id % 50 WHEN 1 THEN 'MISSING_SCORES' WHEN 2 THEN 'WRONG_WIDTH' WHEN 5 THEN 'NON_FINITE' WHEN 4 THEN 'NOT_NORMALIZED' WHEN 6 THEN 'INVALID_TARGET'
WHEN 3 THEN CASE WHEN list_max(scores) > 0.5 THEN 'OUT_OF_RANGE' ELSE 'NOT_NORMALIZED' END ELSE 'OK' END AS reason, count(*) AS n FROM p GROUP BY 1""",
    "reliability_curve": f"WITH {PB}, {_curve(_EDGE, _BINS)}",
    "reliability_curve_quantile": f"WITH {PB}, {_curve(_QEDGE, '(SELECT CAST(count(*) AS INTEGER) FROM x WHERE x.v <= confidence)')}",
    "calibration_bundle": _bundle(),
    "calibration_bundle_by_lang": _bundle("lang"),
    "vector_brier_nll": f"""WITH {PM}, x AS (SELECT sample_id, y_true, scores, list_position({_LIST}, y_true) AS k FROM p), u AS (SELECT sample_id, k, scores[k] AS own, unnest(scores) AS p, unnest([1, 2, 3, 4, 5]) AS i FROM x),
r AS (SELECT sample_id, any_value(own) AS own, sum(power(p - CASE WHEN i = k THEN 1 ELSE 0 END, 2)) AS b FROM u GROUP BY sample_id) SELECT count(*) AS n, {q9('avg(b)')} AS brier, {q9('avg(-ln(greatest(own, 1e-15)))')} AS nll FROM r""",
    "classwise_calibration": f"""WITH {PM}, u AS (SELECT y_true, unnest(scores) AS p, unnest({_LIST}) AS label FROM p), b AS (SELECT label, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(CASE WHEN label = y_true THEN 1.0 ELSE 0.0 END) AS k, sum(p) AS s FROM u GROUP BY 1, 2),
a AS (SELECT label, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS positives, sum(abs(k - s)) AS e FROM b GROUP BY label)
SELECT label, n, positives, CASE WHEN positives >= 10 THEN {q9('e / n')} END AS ece, CASE WHEN positives >= 10 THEN 'COMPUTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM a""",
    "score_entropy": f"""WITH {PM}, u AS (SELECT sample_id, unnest(scores) AS p FROM p), r AS (SELECT sample_id, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h, max(p) AS m1, (list_sort(list(p), 'DESC'))[2] AS m2 FROM u GROUP BY sample_id)
SELECT sample_id, {q9('h')} AS entropy, {q9('h / ln(5)')} AS normalized, {q9('m1 - m2')} AS margin FROM r""",
    "hash_split": f"WITH {PB}, r AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('5:' || sample_id), sample_id) AS r, count(*) OVER () AS n FROM p) SELECT sample_id, CASE WHEN r <= floor(0.3 * n + 0.5) THEN 'calibrate' ELSE 'test' END AS part FROM r",
    "isotonic_regression": f"""WITH {PB}, g AS (SELECT confidence AS x, sum({_RIGHT}) AS k, count(*) AS n FROM p WHERE sample_id % 2 = 0 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(k) OVER w AS ck, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
m AS (SELECT j.i AS j, e.i AS e, (e.ck - j.ck + j.k) / (e.cn - j.cn + j.n) AS a FROM o j JOIN o e ON e.i >= j.i), l AS (SELECT j, e, min(a) OVER (PARTITION BY j ORDER BY e DESC ROWS UNBOUNDED PRECEDING) AS low FROM m),
f AS (SELECT e AS i, max(low) AS y FROM l GROUP BY e), kn AS (SELECT o.x, f.y FROM o JOIN f USING (i)), t AS (SELECT sample_id, confidence AS c FROM p WHERE sample_id % 2 <> 0),
z AS (SELECT sample_id, c, max(x) FILTER (x <= c) AS x0, max(y) FILTER (x <= c) AS y0, min(x) FILTER (x > c) AS x1, min(y) FILTER (x > c) AS y1 FROM t, kn GROUP BY 1, 2)
SELECT sample_id, {q9('CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (c - x0) / (x1 - x0) END')} AS calibrated FROM z""",
    "slice_membership": "WITH " + PB + ", n AS (SELECT count(*) AS n FROM p) "
    + " UNION ALL ".join(f"SELECT '{k}' AS slice, count(*) FILTER ({c}) AS members, count(*) FILTER (({c}) IS NULL) AS unknown, count(*) AS n, {q9(f'count(*) FILTER ({c}) / count(*)')} AS prevalence, 'COMPUTED' AS status FROM p" for k, c in _SL.items())
    + " UNION ALL SELECT 'wrong_kind', 0, n, n, 0.0, 'EMPTY' FROM n UNION ALL SELECT 'absent_field', 0, n, n, 0.0, 'MISSING_FIELD' FROM n",
    "slice_accuracy": "WITH " + PB + " " + " UNION ALL ".join(f"SELECT '{k}' AS slice, count(*) AS n, {q9(f'avg({_RIGHT})')} AS accuracy FROM p WHERE {c}" for k, c in {"(all)": "TRUE", **_SL}.items()),
    "slice_against_rest": "WITH " + PB + ", a AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS slice, count(*) FILTER ({c}) AS n, count(*) FILTER (NOT ({c})) AS n_rest, avg({_RIGHT}) FILTER ({c}) AS a, avg({_RIGHT}) FILTER (NOT ({c})) AS r FROM p" for k, c in _SL.items())
    + f") SELECT slice, n, n_rest, {q9('a')} AS accuracy, {q9('r')} AS rest_accuracy, {q9('a - r')} AS difference, {q9('(a - r) / r')} AS relative FROM a",
    "slice_overlap": "WITH " + PB + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (({_SL[a]}) AND ({_SL[b]})) AS both, count(*) FILTER (({_SL[a]}) OR ({_SL[b]})) AS either, {q9(f'count(*) FILTER (({_SL[a]}) AND ({_SL[b]})) / count(*) FILTER (({_SL[a]}) OR ({_SL[b]}))')} AS jaccard FROM p"
        for a in _SL for b in _SL if a < b
    ),
    "unseen_literals": "SELECT unnest(['xx', 'zz']) AS value",
}
