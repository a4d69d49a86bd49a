"""Queries on permutation tests and bootstraps that draw row by row, on shift of many features, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..operators import calibration as C
from ..operators import drift as D
from ..operators import replicates as R
from ..operators import resampling as B
from .draws import U as _U
from .draws import reps, weighted, x
from .evaluation import PB, PM, PR, q9
from .inference import DE
from .resampled import _QUANT, _at, national, phi
from .slicing import _BINS, EDGES

E = frames.drift_events
NUMERIC, CATEGORICAL = ("value", "user_id", "hour", "gap"), ("event_type", "flag", "weekday")


def regions(s, d):
    """Nations of two regions, with a mean balance and whether it is high: few enough for all splits."""
    side = F.when(F.col("g") == "0", "reference").when(F.col("g") == "1", "comparison")
    return national(s, d).select("n_nationkey", side.alias("side"), "v", (F.col("v") > 4500).alias("high")).filter("side is not null")


def featured(s, d):
    """Events with features of both kinds; some gaps and one kind of event are missing."""
    ts = F.col("ts")
    return E(s, d).select(
        "event_id", "side", "value", "user_id", F.hour(ts).alias("hour"), F.when(F.col("event_id") % 9 != 0, F.col("value") - F.col("user_id")).alias("gap"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), "flag", F.weekday(ts).alias("weekday"), F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).alias("day"),
    )


def two_models(s, d):
    """The length predictor and one that is bolder, on the same samples; each misses some."""
    p = frames.pred_bin(s, d).select("sample_id", "y_true", "score", "source")
    a = p.filter("sample_id % 19 != 0").withColumn("side", F.lit("a"))
    b = p.filter("sample_id % 23 != 0").withColumn("side", F.lit("b")).withColumn("score", F.col("score") / (F.col("score") + (1 - F.col("score")) * 0.4))
    both = a.unionByName(b)
    return both.select("sample_id", "side", "y_true", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("y_pred"), F.greatest(F.col("score"), 1 - F.col("score")).alias("confidence"))


def two_halves(s, d):
    """Samples of one predictor by the parity of their id."""
    return frames.pred_bin(s, d).withColumn("side", F.when(F.col("sample_id") % 2 == 0, "a").otherwise("b"))


QUERIES = {
    "ks_permutation": lambda s, d: D.ks_permutation(E(s, d), "value", "event_id"),
    "ks_permutation_exact": lambda s, d: D.ks_permutation(regions(s, d), "v", "n_nationkey", minimum=2),
    "js_permutation": lambda s, d: D.js_permutation(E(s, d), "event_type", "event_id"),
    "js_permutation_exact": lambda s, d: D.js_permutation(regions(s, d), "high", "n_nationkey", minimum=2),
    "shift_entries": lambda s, d: D.shift_entries(featured(s, d), F.col("day"), D.windows(s, 0, 30, 7, 7), NUMERIC, CATEGORICAL),
    "shift_family": lambda s, d: D.shift_family(featured(s, d), "event_id", NUMERIC[:2], CATEGORICAL[:2], replicates=99),
    "calibration_bootstrap": lambda s, d: C.bootstrap_bundle(frames.pred_bin(s, d), EDGES, "sample_id"),
    "calibration_bootstrap_by_lang": lambda s, d: C.bootstrap_bundle(frames.pred_bin(s, d), EDGES, "sample_id", by=["lang"]),
    "calibration_bootstrap_quantile": lambda s, d: C.bootstrap_bundle_quantile(frames.pred_bin(s, d), 5, "sample_id"),
    "calibration_difference_paired": lambda s, d: C.calibration_difference(two_models(s, d), EDGES, "sample_id", True),
    "calibration_difference_unpaired": lambda s, d: C.calibration_difference(two_halves(s, d), EDGES, "sample_id", False),
    "bootstrap_median": lambda s, d: B.bootstrap_median(frames.table(s, d, "events"), "value", "event_id"),
    "bootstrap_classification": lambda s, d: B.bootstrap_classification(frames.pred_multi(s, d), "sample_id"),
    "bootstrap_regression": lambda s, d: B.bootstrap_regression(frames.pred_reg(s, d), "sample_id", replicates=100),
}


def _split(rows: str, seed: int, n: int) -> str:
    """CTE lab(own, x, ..., replicate, l) of rows(own, x, ...)."""
    return f"""{reps('rr', seed, n)}, nb AS (SELECT count(*) FILTER (own) AS n_b, count(*) FILTER (NOT own) AS n_a FROM {rows}),
lab AS (SELECT * EXCLUDE (u, n_a, n_b), rank() OVER (PARTITION BY replicate ORDER BY u) <= n_b AS l FROM (SELECT {rows}.*, replicate, {_U} AS u FROM {rows}, rr), nb UNION ALL SELECT {rows}.*, 0, own FROM {rows})"""


def _masks(rows: str) -> str:
    """The same for all splits of few rows."""
    return f"""nb AS (SELECT count(*) FILTER (own) AS n_b, count(*) FILTER (NOT own) AS n_a FROM {rows}), po AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS i FROM {rows}),
ms AS (SELECT mk, CAST(row_number() OVER (ORDER BY mk) AS INTEGER) AS replicate FROM range({1 << 14}) t(mk), nb WHERE mk < (1 << CAST(n_a + n_b AS INTEGER)) AND bit_count(mk) = n_b),
lab AS (SELECT po.* EXCLUDE (i), replicate, (mk >> CAST(i AS INTEGER)) % 2 = 1 AS l FROM po, ms UNION ALL SELECT * EXCLUDE (i), 0, own FROM po)"""


_KS = """sz AS (SELECT replicate, count(*) FILTER (l) AS m_b, count(*) FILTER (NOT l) AS m_a FROM lab GROUP BY 1),
st AS (SELECT replicate, v, sum(count(*) FILTER (l)) OVER w AS cb, sum(count(*) FILTER (NOT l)) OVER w AS ca FROM lab GROUP BY replicate, v WINDOW w AS (PARTITION BY replicate ORDER BY v)),
stat AS (SELECT replicate, max(abs(cb / m_b - ca / m_a)) AS s FROM st JOIN sz USING (replicate) GROUP BY 1)"""
_JS = """sz AS (SELECT replicate, count(*) FILTER (l) AS m_b, count(*) FILTER (NOT l) AS m_a FROM lab GROUP BY 1),
ct AS (SELECT replicate, v, count(*) FILTER (NOT l) / any_value(m_a) AS p, count(*) FILTER (l) / any_value(m_b) AS q FROM lab JOIN sz USING (replicate) GROUP BY replicate, v),
stat AS (SELECT replicate, least(1.0, greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS s FROM ct GROUP BY 1)"""


def _verdict(exact: bool) -> str:
    p = "hits / count" if exact else "(hits + 1) / (count + 1.0)"
    return f"""o AS (SELECT s AS observed FROM stat WHERE replicate = 0), h AS (SELECT observed, count(*) FILTER (s >= observed - 1e-12) AS hits, count(*) AS count FROM stat, o WHERE replicate > 0 GROUP BY observed)
SELECT n_a AS n_reference, n_b AS n_comparison, {q9('observed')} AS statistic, hits, CAST(count AS INTEGER) AS replicates, {str(exact).lower()} AS exact, {q9(p)} AS p, 'DERIVED' AS status FROM h, nb"""


def _rows(value: str, key: str = "event_id", seed: int = 23) -> str:
    return f"{DE}, src AS (SELECT side = 'comparison' AS own, {value} AS v, {x(seed, key)} AS x FROM e WHERE {value} IS NOT NULL)"


def _nations(value: str) -> str:
    return f"""nt AS (SELECT n_nationkey, n_regionkey, floor(avg(c_acctbal) * 1e6 + 0.5) / 1e6 AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 1) GROUP BY 1, 2),
src AS (SELECT n_regionkey = 1 AS own, {value} AS v, {x(23, 'n_nationkey')} AS x FROM nt)"""


_FEATURED = """f AS (SELECT event_id, ts < TIMESTAMP '2024-01-16' AS before, value, CAST(user_id AS DOUBLE) AS user_id, CAST(hour(ts) AS DOUBLE) AS hour, CASE WHEN event_id % 9 <> 0 THEN value - user_id END AS gap,
CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, CAST(value > 100 AS VARCHAR) AS flag, CAST((dayofweek(ts) + 6) % 7 AS VARCHAR) AS weekday, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events)"""


def _entries() -> str:
    parts = [f"SELECT '{c}' AS feature, 'NUMERIC' AS kind, day, CAST({c} AS DOUBLE) AS v, NULL AS c FROM f" for c in NUMERIC]
    parts += [f"SELECT '{c}', 'CATEGORICAL', day, NULL, {c} FROM f" for c in CATEGORICAL]
    return f"""WITH {_FEATURED}, u AS ({' UNION ALL '.join(parts)}), pl AS (SELECT CAST(k AS INTEGER) AS "window", 7 * k AS lo FROM range(1, 4) t(k)),
s AS (SELECT feature, kind, "window", v, c, day >= lo AS now FROM u, pl WHERE day >= lo - 7 AND day < lo + 7), good AS (SELECT * FROM s WHERE v IS NOT NULL OR c IS NOT NULL),
n AS (SELECT feature, kind, "window", count(*) FILTER (NOT now AND (v IS NOT NULL OR c IS NOT NULL)) AS nx, count(*) FILTER (now AND (v IS NOT NULL OR c IS NOT NULL)) AS ny, count(*) FILTER (v IS NULL AND c IS NULL) AS excluded FROM s GROUP BY 1, 2, 3),
g AS (SELECT feature, kind, "window", v, c, count(*) FILTER (NOT now) AS a, count(*) FILTER (now) AS b FROM good GROUP BY ALL),
st AS (SELECT g.*, nx, ny, abs(sum(a) OVER w / nx - sum(b) OVER w / ny) AS gap, lead(v) OVER w - v AS step, a / nx AS p, b / ny AS q FROM g JOIN n USING (feature, kind, "window") WINDOW w AS (PARTITION BY feature, kind, "window" ORDER BY v, c)),
m AS (SELECT feature, kind, "window", max(gap) AS ks, sum(gap * step) AS w, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js, sum(abs(p - q)) / 2 AS tv FROM st GROUP BY 1, 2, 3)
SELECT feature, kind, "window", nx AS n_reference, ny AS n_comparison, CAST(excluded AS BIGINT) AS excluded, CASE WHEN kind = 'NUMERIC' THEN {q9('ks')} END AS ks, CASE WHEN kind = 'NUMERIC' THEN {q9('coalesce(w, 0.0)')} END AS wasserstein,
CASE WHEN kind <> 'NUMERIC' THEN {q9('least(1.0, greatest(0.0, js))')} END AS jensen_shannon, CASE WHEN kind <> 'NUMERIC' THEN {q9('tv')} END AS total_variation,
CASE WHEN least(nx, ny) < 10 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'DERIVED' END AS status, CASE WHEN least(nx, ny) < 10 THEN 'FEW_VALUES' END AS reason FROM n JOIN m USING (feature, kind, "window")"""


def _family() -> str:
    ctes, rows = [_FEATURED], []
    for k, c in enumerate((*NUMERIC[:2], *CATEGORICAL[:2])):
        kind, stat = ("NUMERIC", _KS) if c in NUMERIC else ("CATEGORICAL", _JS)
        sql = f"src AS (SELECT NOT before AS own, {c} AS v, {x(23, 'event_id')} AS x FROM f WHERE {c} IS NOT NULL), {_split('src', 23, 99)}, {stat}, o AS (SELECT s AS observed FROM stat WHERE replicate = 0), h AS (SELECT observed, count(*) FILTER (s >= observed - 1e-12) AS hits FROM stat, o WHERE replicate > 0 GROUP BY observed)"
        rows.append(f"SELECT '{c}' AS feature, '{kind}' AS kind, {q9('observed')} AS statistic, {q9('(hits + 1) / 100.0')} AS p, 'DERIVED' AS status FROM (WITH {sql} SELECT * FROM h)")
    return f"""WITH {', '.join(ctes)}, u AS ({' UNION ALL '.join(rows)}), r AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p, feature) AS k FROM u),
a AS (SELECT *, {q9('least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING))')} AS adjusted FROM r) SELECT feature, kind, statistic, p, m, adjusted, adjusted <= 0.05 AS rejected, status FROM a"""


_TERMS = """CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS k, confidence AS s, power(confidence - CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END, 2) AS b2,
-ln(greatest(least(CASE WHEN y_true = y_pred THEN confidence ELSE 1 - confidence END, 1 - 1e-15), 1e-15)) AS l"""
_SUMS = "sum(w) AS n, sum(w * k) AS k, sum(w * s) AS s, sum(w * b2) AS b2, sum(w * l) AS l"
NAMES = C.MEASURES
_FORMULA = {"accuracy": "sum(k) / sum(n)", "confidence": "sum(s) / sum(n)", "overconfidence": "(sum(s) - sum(k)) / sum(n)", "ece": "sum(abs(k - s)) / sum(n)", "mce": "max(abs(k - s) / n)", "brier": "sum(b2) / sum(n)", "log_loss": "sum(l) / sum(n)"}


def _measures(bins: str, name: str, by: str = "") -> str:
    """CTE name(by, replicate, measure, v) of bins(by, replicate, bin, n, k, s, b2, l)."""
    return f"{name}_m AS (SELECT {by}replicate, {', '.join(f'{f} AS {k}' for k, f in _FORMULA.items())} FROM {bins} WHERE n > 0.5 GROUP BY {by}replicate), {name} AS (SELECT {by}replicate, measure, v FROM {name}_m UNPIVOT INCLUDE NULLS (v FOR measure IN ({', '.join(NAMES)})))"


def _ends(source: str, by: str = "", extra: str = "measure") -> str:
    return f"""SELECT {by}measure AS {extra}, {q9('max(v) FILTER (replicate = 0)')} AS estimate, {q9('quantile_cont(v, 0.025) FILTER (replicate > 0)')} AS lower, {q9('quantile_cont(v, 0.975) FILTER (replicate > 0)')} AS upper,
count(v) FILTER (replicate > 0) AS replicates, 'DERIVED' AS status FROM {source} GROUP BY {by}measure"""


def _bootstrap(by: str = "") -> str:
    return f"""WITH {PB}, src AS (SELECT {by}{_BINS} AS bin, {_TERMS}, {x(31, 'sample_id')} AS x FROM p), {weighted('src', 'wt', 31, 200)},
bs AS (SELECT {by}replicate, bin, {_SUMS} FROM wt GROUP BY {by}replicate, bin), {_measures('bs', 'ms', by)} {_ends('ms', by)}"""


def _two(paired: bool) -> str:
    if paired:
        rows = f"""sd AS (SELECT sample_id, 'a' AS side, y_true, score FROM p WHERE sample_id % 19 <> 0 UNION ALL SELECT sample_id, 'b', y_true, score / (score + (1 - score) * 0.4) FROM p WHERE sample_id % 23 <> 0),
pp AS (SELECT sample_id, side, y_true, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred, greatest(score, 1 - score) AS confidence FROM sd WHERE sample_id % 19 <> 0 AND sample_id % 23 <> 0)"""
        keys, other = ("sample_id",), ("sample_id",)
    else:
        rows = "pp AS (SELECT * EXCLUDE (score), CASE WHEN sample_id % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM p)"
        keys, other = ("side", "sample_id"), ("side", "sample_id")
    diff = lambda src, out: f"{out} AS (SELECT replicate, measure, max(v) FILTER (side = 'b') - max(v) FILTER (side = 'a') AS v FROM {src} GROUP BY replicate, measure)"
    if paired:
        moved = f"""pr AS (SELECT * FROM rows0, {'rp'}), ag AS (SELECT replicate, CASE WHEN {_U} < {R.PRIME // 2} THEN CASE side WHEN 'a' THEN 'b' ELSE 'a' END ELSE side END AS side, bin, k, s, b2, l, 1 AS w FROM pr UNION ALL SELECT 0, side, bin, k, s, b2, l, 1 FROM rows0)"""
    else:
        moved = f"""nb AS (SELECT count(*) FILTER (side = 'b') AS n_b FROM rows0), ag AS (SELECT replicate, CASE WHEN rank() OVER (PARTITION BY replicate ORDER BY {_U}) <= n_b THEN 'b' ELSE 'a' END AS side, bin, k, s, b2, l, 1 AS w FROM rows0, rp, nb UNION ALL SELECT 0, side, bin, k, s, b2, l, 1 FROM rows0)"""
    return f"""WITH {PB}, {rows}, src AS (SELECT side, {_BINS} AS bin, {_TERMS}, {x(37, *keys)} AS x FROM pp), {weighted('src', 'wt', 37, 200)},
bs AS (SELECT replicate, side, bin, {_SUMS} FROM wt GROUP BY replicate, side, bin), {_measures('bs', 'ms', 'side, ')}, {diff('ms', 'df')}, iv AS ({_ends('df')}),
rows0 AS (SELECT side, {_BINS} AS bin, {_TERMS}, {x(38, *other)} AS x FROM pp), {reps('rp', 38, 199)}, {moved},
bp AS (SELECT replicate, side, bin, {_SUMS} FROM ag GROUP BY replicate, side, bin), {_measures('bp', 'mp', 'side, ')}, {diff('mp', 'dp')},
pt AS (SELECT measure, abs(v) AS point FROM dp WHERE replicate = 0), hp AS (SELECT measure, count(*) FILTER (replicate > 0 AND abs(v) >= point - 1e-12) AS hits FROM dp JOIN pt USING (measure) GROUP BY measure)
SELECT iv.*, CAST(199 AS INTEGER) AS permutations, {q9('(hits + 1) / 200.0')} AS p FROM iv JOIN hp USING (measure)"""


_MEDIAN = f"""WITH src AS (SELECT value AS v, {x(41, 'event_id')} AS x FROM events WHERE value IS NOT NULL), {weighted('src', 'wt', 41, 200)},
cu AS (SELECT replicate, v, sum(w) OVER (PARTITION BY replicate ORDER BY v, x ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY replicate) AS n FROM wt),
md AS (SELECT replicate, any_value(n) AS n, (min(v) FILTER (c >= floor((n + 1) / 2)) + min(v) FILTER (c >= floor(n / 2) + 1)) / 2 AS median, min(v) FILTER (c >= floor(n / 2)) AS un, min(v) FILTER (c >= floor(n / 2) + 1) AS hi, min(v) FILTER (c >= floor(n / 2) + 2) AS ov FROM cu GROUP BY replicate),
dr AS (SELECT list_sort(list(median)) AS draws FROM md WHERE replicate > 0),
jk AS (SELECT CAST(n AS BIGINT) AS n, median AS m, CASE WHEN n % 2 = 0 THEN [(hi + un) / 2, hi, un, 0.0] ELSE [((n - 1) / 2 * ((hi + ov) / 2 + (un + hi) / 2) + (un + ov) / 2) / n, (hi + ov) / 2, (un + ov) / 2, (un + hi) / 2] END AS j, n % 2 = 0 AS even FROM md WHERE replicate = 0),
s23 AS (SELECT n, m, CASE WHEN even THEN n / 2 * (power(j[1] - j[2], 2) + power(j[1] - j[3], 2)) ELSE (n - 1) / 2 * (power(j[1] - j[2], 2) + power(j[1] - j[4], 2)) + power(j[1] - j[3], 2) END AS s2,
CASE WHEN even THEN n / 2 * (power(j[1] - j[2], 3) + power(j[1] - j[3], 3)) ELSE (n - 1) / 2 * (power(j[1] - j[2], 3) + power(j[1] - j[4], 3)) + power(j[1] - j[3], 3) END AS s3 FROM jk),
k0 AS (SELECT n, m, draws, CASE WHEN s2 > 1e-18 * m * m THEN s3 / (6 * power(s2, 1.5)) END AS a, list_sum(list_transform(draws, lambda d: CASE WHEN d < m - 1e-12 THEN 1.0 WHEN d <= m + 1e-12 THEN 0.5 ELSE 0.0 END)) / len(draws) AS p0 FROM s23, dr),
k1 AS (SELECT *, {_QUANT} AS x FROM k0), k2 AS (SELECT *, ({phi('x')} - p0) * sqrt(2 * pi()) * exp(x * x / 2) AS u FROM k1), k3 AS (SELECT *, x - u / (1 + x * u / 2) AS z0 FROM k2),
k4 AS (SELECT *, z0 + (z0 - 1.959963984540054) / (1 - a * (z0 - 1.959963984540054)) AS zl, z0 + (z0 + 1.959963984540054) / (1 - a * (z0 + 1.959963984540054)) AS zh FROM k3), k5 AS (SELECT *, {phi('zl')} AS lo, {phi('zh')} AS hi FROM k4)
SELECT n, {q9('m')} AS estimate, CASE WHEN a IS NOT NULL THEN {q9(_at('lo'))} END AS lower, CASE WHEN a IS NOT NULL THEN {q9(_at('hi'))} END AS upper, {q9(_at('0.025'))} AS percentile_lower, {q9(_at('0.975'))} AS percentile_upper,
{q9('z0')} AS z0, {q9('a')} AS acceleration, CASE WHEN a IS NOT NULL THEN 'DERIVED' ELSE 'UNDEFINED' END AS status FROM k5"""

_CLASSES = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")
SQL = {
    "ks_permutation": f"WITH {_rows('value')}, {_split('src', 23, 199)}, {_KS}, {_verdict(False)}",
    "ks_permutation_exact": f"WITH {_nations('v')}, {_masks('src')}, {_KS}, {_verdict(True)}",
    "js_permutation": f"WITH {_rows('event_type')}, {_split('src', 23, 199)}, {_JS}, {_verdict(False)}",
    "js_permutation_exact": f"WITH {_nations('v > 4500')}, {_masks('src')}, {_JS}, {_verdict(True)}",
    "shift_entries": _entries(),
    "shift_family": _family(),
    "calibration_bootstrap": _bootstrap(),
    "calibration_bootstrap_by_lang": _bootstrap("lang, "),
    "calibration_bootstrap_quantile": f"""WITH {PB}, src AS (SELECT {_TERMS}, {x(31, 'sample_id')} AS x FROM p), {weighted('src', 'wt', 31, 200)},
cu AS (SELECT replicate, s, sum(w) OVER (PARTITION BY replicate ORDER BY s, x ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY replicate) AS n FROM wt),
ed AS (SELECT replicate, list_filter([{', '.join(f'min(s) FILTER (c >= ceil(n * {k} / 5))' for k in range(1, 5))}], lambda z: z > 0 AND z < 1) AS edges FROM cu GROUP BY replicate),
bs AS (SELECT replicate, len(list_filter(edges, lambda z: z <= s)) AS bin, {_SUMS} FROM wt JOIN ed USING (replicate) GROUP BY replicate, bin), {_measures('bs', 'ms')} {_ends('ms')}""",
    "calibration_difference_paired": _two(True),
    "calibration_difference_unpaired": _two(False),
    "bootstrap_median": _MEDIAN,
    "bootstrap_classification": f"""WITH {PM}, src AS (SELECT y_true AS t, y_pred AS p, {x(43, 'sample_id')} AS x FROM p), {weighted('src', 'wt', 43, 200)}, ce AS (SELECT replicate, t, p, sum(w) AS n FROM wt GROUP BY 1, 2, 3),
lb AS (SELECT replicate, label, sum(tr) AS tr, sum(sa) AS sa, sum(hit) AS hit FROM (SELECT replicate, t AS label, n AS tr, 0 AS sa, CASE WHEN t = p THEN n ELSE 0 END AS hit FROM ce UNION ALL SELECT replicate, p, 0, n, 0 FROM ce) GROUP BY 1, 2),
mt AS (SELECT replicate, sum(hit) / sum(tr) AS accuracy, avg(hit / nullif(tr, 0)) AS balanced_accuracy, avg(coalesce(hit / nullif(sa, 0), 0)) AS macro_precision, avg(coalesce(hit / nullif(tr, 0), 0)) AS macro_recall, avg(coalesce(2 * hit / nullif(tr + sa, 0), 0)) AS macro_f1 FROM lb GROUP BY replicate),
ms AS (SELECT replicate, measure, v FROM mt UNPIVOT INCLUDE NULLS (v FOR measure IN ({', '.join(_CLASSES)}))) {_ends('ms', extra='metric')}""",
    "bootstrap_regression": f"""WITH {PR}, src AS (SELECT y_true AS t, y_pred - y_true AS e, {x(47, 'sample_id')} AS x FROM p), {weighted('src', 'wt', 47, 100)},
sm AS (SELECT replicate, sum(w) AS n, sum(w * abs(e)) AS a, sum(w * e * e) AS s, sum(w * t) AS t, sum(w * t * t) AS tt FROM wt GROUP BY replicate),
mt AS (SELECT replicate, a / n AS mae, s / n AS mse, sqrt(s / n) AS rmse, 1 - s / (tt - t * t / n) AS r2 FROM sm), ms AS (SELECT replicate, measure, v FROM mt UNPIVOT (v FOR measure IN (mae, mse, rmse, r2))) {_ends('ms', extra='metric')}""",
}
