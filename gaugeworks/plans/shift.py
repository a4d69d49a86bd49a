"""Drift queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..operators import drift as D
from .evaluation import PB, q9
from .inference import DE

E = frames.drift_events


def sided(s, d):
    return frames.pred_bin(s, d).withColumn("side", F.when(F.col("sample_id") % 2 == 0, "reference").otherwise("comparison"))


def days(s, d):
    return frames.table(s, d, "events").select("value", (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).alias("day"))


def keys(s, d):
    k = F.when(F.col("doc_id") % 17 == 0, F.lit("n/a")).when(F.col("doc_id") % 13 == 0, F.lit("NaN")).when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("n_chars").cast("string"))
    return frames.table(s, d, "documents").select(k.alias("key"))


def rolling(kind):
    def run(s, d):
        plan = D.windows(s, 0, 30, 7, 7, kind)
        return D.numeric_shift(D.in_windows(days(s, d), F.col("day"), plan, "value"), "value", ["window"])

    return run


QUERIES = {
    "ks_wasserstein": lambda s, d: D.numeric_shift(E(s, d), "value"),
    "ks_wasserstein_by_type": lambda s, d: D.numeric_shift(E(s, d), "value", ["event_type"]),
    "ecdf_by_side": lambda s, d: D.ecdf(E(s, d), "value"),
    "jensen_shannon_total_variation": lambda s, d: D.categorical_shift(E(s, d), "event_type"),
    "boolean_shift": lambda s, d: D.categorical_shift(E(s, d), "flag"),
    "category_proportions": lambda s, d: D.category_table(E(s, d), "event_type"),
    "label_shift_by_side": lambda s, d: D.category_table(sided(s, d), "y_true"),
    "rolling_plan": lambda s, d: D.windows(s, 0, 30, 7, 7),
    "rolling_shift_fixed": rolling("FIXED"),
    "rolling_shift_previous": rolling("PREVIOUS"),
    "rolling_shift_expanding": rolling("EXPANDING"),
    "ordering_key_validation": lambda s, d: D.ordering_keys(keys(s, d), "key"),
    "performance_shift": lambda s, d: D.performance_shift(sided(s, d)),
    "performance_shift_by_lang": lambda s, d: D.performance_shift(sided(s, d), ["lang"]),
}


def numeric(frame: str, by: str = "") -> str:
    """SQL of numeric_shift over a CTE `e`(side, value, by)."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN sd USING ({by})" if by else ", sd"
    return f"""WITH {frame}, c AS (SELECT {b}value AS v, count(*) FILTER (side = 'reference') AS x, count(*) FILTER (side = 'comparison') AS y FROM e GROUP BY {b}value),
f AS (SELECT {b}v, lead(v) OVER ({part}ORDER BY v) AS nv, sum(x) OVER ({part}ORDER BY v) / sum(x) OVER ({part}) AS fx, sum(y) OVER ({part}ORDER BY v) / sum(y) OVER ({part}) AS fy, sum(x) OVER ({part}) AS nx, sum(y) OVER ({part}) AS ny FROM c),
a AS (SELECT {b}CAST(any_value(nx) AS BIGINT) AS nx, CAST(any_value(ny) AS BIGINT) AS ny, max(abs(fx - fy)) AS ks, sum(abs(fx - fy) * (nv - v)) AS w FROM f {group}),
sd AS (SELECT {b}stddev_samp(value) FILTER (side = 'reference') AS sd FROM e {group})
SELECT {b}nx AS n_reference, ny AS n_comparison, {q9('ks')} AS ks, {q9('w')} AS wasserstein, CASE WHEN sd > 0 THEN {q9('w / sd')} END AS scaled_wasserstein,
CASE WHEN nx = 0 OR ny = 0 THEN 'UNDEFINED' WHEN least(nx, ny) < 10 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'DERIVED' END AS status FROM a {join}"""


def categorical(frame: str, column: str) -> str:
    return f"""WITH {frame}, c AS (SELECT CAST({column} AS VARCHAR) AS category, count(*) FILTER (side = 'reference') AS x, count(*) FILTER (side = 'comparison') AS y FROM e GROUP BY 1),
p AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q, sum(x) OVER () AS nx, sum(y) OVER () AS ny FROM c)
SELECT CAST(any_value(nx) AS BIGINT) AS n_reference, CAST(any_value(ny) AS BIGINT) AS n_comparison, count(*) AS categories, {q9('sum(abs(p - q)) / 2')} AS total_variation,
{q9('sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2')} AS jensen_shannon, 'DERIVED' AS status FROM p"""


def _wilson(k: str, n: str, upper: bool) -> str:
    z = 1.959963984540054
    mid = f"(({k} / {n} + {z * z} / (2 * {n})) / (1 + {z * z} / {n}))"
    half = f"({z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z * z} / (4.0 * {n} * {n})) / (1 + {z * z} / {n}))"
    return f"CASE WHEN {k} = {n} THEN 1.0 ELSE least(1.0, {mid} + {half}) END" if upper else f"CASE WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, {mid} - {half}) END"


def table(frame: str, column: str) -> str:
    return f"""WITH {frame}, c AS (SELECT CAST({column} AS VARCHAR) AS category, count(*) FILTER (side = 'reference') AS x, count(*) FILTER (side = 'comparison') AS y FROM e GROUP BY 1),
t AS (SELECT *, sum(x) OVER ()::DOUBLE AS nx, sum(y) OVER ()::DOUBLE AS ny FROM c)
SELECT category, x, y, {q9('x / nx')} AS p, {q9('y / ny')} AS q, {q9('y / ny - x / nx')} AS difference, {q9(_wilson('x', 'nx', False))} AS p_lower, {q9(_wilson('x', 'nx', True))} AS p_upper,
{q9(_wilson('y', 'ny', False))} AS q_lower, {q9(_wilson('y', 'ny', True))} AS q_upper, CASE WHEN y = 0 THEN 'reference' WHEN x = 0 THEN 'comparison' END AS only_in FROM t"""


SIDED = f"{PB}, e AS (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'reference' ELSE 'comparison' END AS side FROM p)"


def _plan(kind: str) -> str:
    lo, hi = {"FIXED": ("0", "7"), "PREVIOUS": ("lo - 7", "lo"), "EXPANDING": ("0", "lo")}[kind]
    return f"""pl AS (SELECT CAST(w AS INTEGER) AS "window", lo, hi, CAST({lo} AS INTEGER) AS ref_lo, CAST({hi} AS INTEGER) AS ref_hi,
CASE WHEN hi > 30 THEN 'PARTIAL_WINDOW' WHEN w = 0 THEN 'NO_REFERENCE' ELSE 'PLANNED' END AS status FROM (SELECT w, CAST(w * 7 AS INTEGER) AS lo, CAST(w * 7 + 7 AS INTEGER) AS hi FROM range(5) t(w)))"""


def _rolled(kind: str) -> str:
    frame = f"""{_plan(kind)}, dv AS (SELECT value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
e AS (SELECT "window", 'comparison' AS side, value FROM dv JOIN pl ON day >= lo AND day < hi AND status = 'PLANNED'
UNION ALL SELECT "window", 'reference', value FROM dv JOIN pl ON day >= ref_lo AND day < ref_hi AND status = 'PLANNED')"""
    return numeric(frame, '"window"')


SQL = {
    "ks_wasserstein": numeric(DE),
    "ks_wasserstein_by_type": numeric(DE, "event_type"),
    "ecdf_by_side": f"""WITH {DE}, c AS (SELECT value AS v, count(*) FILTER (side = 'reference') AS x, count(*) FILTER (side = 'comparison') AS y FROM e GROUP BY value)
SELECT {q9('v')} AS v, {q9('sum(x) OVER (ORDER BY v) / sum(x) OVER ()')} AS reference, {q9('sum(y) OVER (ORDER BY v) / sum(y) OVER ()')} AS comparison FROM c""",
    "jensen_shannon_total_variation": categorical(DE, "event_type"),
    "boolean_shift": categorical(DE, "flag"),
    "category_proportions": table(DE, "event_type"),
    "label_shift_by_side": table(SIDED, "y_true"),
    "rolling_plan": f"WITH {_plan('PREVIOUS')} SELECT * FROM pl",
    "rolling_shift_fixed": _rolled("FIXED"),
    "rolling_shift_previous": _rolled("PREVIOUS"),
    "rolling_shift_expanding": _rolled("EXPANDING"),
    "ordering_key_validation": """SELECT CASE WHEN doc_id % 17 = 0 THEN 'INVALID' WHEN doc_id % 13 = 0 THEN 'NON_FINITE' WHEN doc_id % 11 = 0 THEN 'MISSING' ELSE 'VALID' END AS bucket, count(*) AS n FROM documents GROUP BY 1""",
    "performance_shift": f"WITH {SIDED}, a AS (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FILTER (side = 'reference') AS r, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FILTER (side = 'comparison') AS c FROM e) SELECT {q9('r')} AS reference, {q9('c')} AS comparison, {q9('c - r')} AS difference, c < r AS worse FROM a",
    "performance_shift_by_lang": f"WITH {SIDED}, a AS (SELECT lang, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FILTER (side = 'reference') AS r, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FILTER (side = 'comparison') AS c FROM e GROUP BY lang) SELECT lang, {q9('r')} AS reference, {q9('c')} AS comparison, {q9('c - r')} AS difference, c < r AS worse FROM a",
}
