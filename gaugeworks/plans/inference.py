"""Inference queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..operators import stats as S
from .draws import weighted, x
from .evaluation import PB, q9

E = frames.drift_events
CELLS = """t AS (SELECT CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CONTROL' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'A'
  WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'B' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'AB' END AS cell,
  strftime(l_shipdate, '%Y-%m') AS trial_key, avg(l_discount) AS discount, avg(l_extendedprice) AS price, count(*) AS n FROM lineitem GROUP BY 1, 2),
trials AS (SELECT * FROM t WHERE cell IS NOT NULL)"""
DE = """e AS (SELECT event_id, user_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'comparison' END AS side, value, event_type, value > 100 AS flag FROM events)"""


def draw(seed: int, replicate: str, index: str, n: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {replicate} || ':' || {index}), 1, 15) AS BIGINT) % {n}"


def cell(s, d, name):
    return frames.trials(s, d).filter(F.col("cell") == name)


def pairs(s, d):
    # rounded, so that sums in another order still give the same pairs
    t = frames.trials(s, d).withColumn("discount", F.floor(F.col("discount") * 1e9 + 0.5) / F.lit(1e9))
    return S.pair_up(t.filter("cell = 'CONTROL'"), t.filter("cell = 'A'"), "trial_key", "discount")


def p_values(s, d):
    """A p-value stand-in for each event type and day: its share of small values; some types have none."""
    e = frames.table(s, d, "events")
    a = e.groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.avg((F.col("value") < 20).cast("double")).alias("p"))
    return a.select("event_type", "day", F.when(F.col("day") % 7 != 0, F.floor(F.col("p") * 1e9 + 0.5) / F.lit(1e9)).alias("p"))


QUERIES = {
    "summary_by_event_type": lambda s, d: S.summary(E(s, d), "value", ["event_type"]),
    "moments_by_event_type": lambda s, d: S.moments(E(s, d), "value", ["event_type"]),
    "pearson_correlation": lambda s, d: S.pearson(frames.table(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]),
    "unpaired_effect": lambda s, d: S.unpaired_effect(E(s, d), "side", "value", "reference", "comparison"),
    "paired_effect": lambda s, d: S.paired_effect(pairs(s, d)),
    "unmatched_trial_keys": lambda s, d: S.unmatched_keys(cell(s, d, "CONTROL").filter("trial_key >= '1993'"), cell(s, d, "B").filter("trial_key < '1998'"), "trial_key"),
    "bootstrap_interval": lambda s, d: S.bootstrap_interval(frames.pred_bin(s, d).withColumn("right", (F.col("y_true") == F.col("y_pred")).cast("double")), "right", "sample_id"),
    "sign_flip_test": lambda s, d: S.sign_flip_test(pairs(s, d)),
    "wilson_by_lang": lambda s, d: S.proportion(frames.pred_bin(s, d), F.col("y_true") == F.col("y_pred"), ["lang"]),
    "bonferroni": lambda s, d: S.bonferroni(p_values(s, d), ["event_type"]),
    "benjamini_hochberg": lambda s, d: S.benjamini_hochberg(p_values(s, d), ["event_type"], "day"),
    "iqr_outliers": lambda s, d: S.outliers(E(s, d), "value", ["event_type"]),
    "mad_outliers": lambda s, d: S.mad_outliers(frames.table(s, d, "events"), "value"),
    "quantiles_type7": lambda s, d: S.quantiles(E(s, d), "value", [0.05, 0.3, 0.5, 0.95], ["event_type"]),
    "lag1_autocorrelation": lambda s, d: S.lag1(frames.trials(s, d), "cell", "trial_key", "discount"),
}

_PAIRS = f"""{CELLS}, r AS (SELECT cell, trial_key, floor(discount * 1e9 + 0.5) / 1e9 AS discount FROM trials),
pr AS (SELECT a.trial_key, a.discount AS x, b.discount AS y FROM r a JOIN r b USING (trial_key) WHERE a.cell = 'CONTROL' AND b.cell = 'A')"""
_P = """pv AS (SELECT event_type, CAST(day(ts) AS INTEGER) AS day, CASE WHEN day(ts) % 7 <> 0 THEN floor(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END) * 1e9 + 0.5) / 1e9 END AS p FROM events GROUP BY event_type, day(ts))"""

SQL = {
    "summary_by_event_type": f"""SELECT event_type, count(value) AS n, {q9('avg(value)')} AS mean, {q9('quantile_cont(value, 0.5)')} AS median, {q9('var_samp(value)')} AS variance, {q9('stddev_samp(value)')} AS std,
{q9('stddev_samp(value) / sqrt(count(value))')} AS se, {q9('min(value)')} AS min, {q9('max(value)')} AS max, 'OBSERVED' AS status FROM events GROUP BY event_type""",
    "moments_by_event_type": f"""WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events),
a AS (SELECT event_type, count(*) AS n, avg(power(value - m, 2)) AS v, avg(power(value - m, 3)) AS t, avg(power(value - m, 4)) AS f FROM m GROUP BY event_type)
SELECT event_type, n, {q9('t / power(v, 1.5)')} AS skewness, {q9('f / (v * v) - 3')} AS excess_kurtosis FROM a""",
    "pearson_correlation": f"SELECT l_returnflag, count(*) AS n, {q9('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem GROUP BY l_returnflag",
    "unpaired_effect": f"""WITH {DE}, g AS (SELECT count(value) FILTER (side = 'reference') AS n_a, count(value) FILTER (side = 'comparison') AS n_b, avg(value) FILTER (side = 'reference') AS m_a, avg(value) FILTER (side = 'comparison') AS m_b,
var_samp(value) FILTER (side = 'reference') AS v_a, var_samp(value) FILTER (side = 'comparison') AS v_b FROM e),
c AS (SELECT *, m_b - m_a AS diff, (m_b - m_a) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) AS dd FROM g)
SELECT n_a, n_b, {q9('diff')} AS difference, {q9('diff / abs(m_a)')} AS relative, {q9('dd')} AS cohen_d, {q9('dd * (1 - 3.0 / (4 * (n_a + n_b - 2) - 1))')} AS hedges_g FROM c""",
    "paired_effect": f"WITH {_PAIRS} SELECT count(*) AS n, {q9('avg(y - x)')} AS mean_difference, {q9('stddev_samp(y - x)')} AS std_difference, {q9('avg(y - x) / stddev_samp(y - x)')} AS dz FROM pr",
    "unmatched_trial_keys": f"""WITH {CELLS}, a AS (SELECT DISTINCT trial_key FROM trials WHERE cell = 'CONTROL' AND trial_key >= '1993'), b AS (SELECT DISTINCT trial_key FROM trials WHERE cell = 'B' AND trial_key < '1998')
SELECT trial_key, 'a' AS only_in FROM a WHERE trial_key NOT IN (SELECT trial_key FROM b) UNION ALL SELECT trial_key, 'b' FROM b WHERE trial_key NOT IN (SELECT trial_key FROM a)""",
    "bootstrap_interval": f"""WITH {PB}, src AS (SELECT CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END AS v, {x(7, 'sample_id')} AS x FROM p), {weighted('src', 'wt', 7, 200)},
m AS (SELECT replicate, sum(w * v) / sum(w) AS mean FROM wt WHERE replicate > 0 GROUP BY replicate HAVING sum(w) > 0)
SELECT count(*) AS replicates, {q9('quantile_cont(mean, 0.025)')} AS lower, {q9('quantile_cont(mean, 0.975)')} AS upper FROM m""",
    "sign_flip_test": f"""WITH {_PAIRS}, o AS (SELECT y - x AS dd, row_number() OVER (ORDER BY x, y) - 1 AS i FROM pr), ob AS (SELECT count(*) AS n, avg(dd) AS observed FROM o),
m AS (SELECT rep, avg(dd * (1 - 2 * ({draw(11, 'rep', 'i', '2')}))) AS m FROM o, range(999) t(rep) GROUP BY rep), h AS (SELECT count(*) FILTER (abs(m) >= abs(observed) - 1e-12) AS hits FROM m, ob)
SELECT n, {q9('observed')} AS observed, hits, CAST(999 AS INTEGER) AS replicates, {q9('(hits + 1) / 1000.0')} AS p FROM ob, h""",
    "wilson_by_lang": f"""WITH {PB}, a AS (SELECT lang, count(*) AS n, count(*) FILTER (y_true = y_pred) AS k FROM p GROUP BY lang), b AS (SELECT *, k / n AS pp, 1.959963984540054 AS z FROM a),
w AS (SELECT *, (pp + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(pp * (1 - pp) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS half FROM b)
SELECT lang, n, k, {q9('pp')} AS p, {q9('CASE WHEN k = 0 THEN 0.0 ELSE greatest(0.0, mid - half) END')} AS lower, {q9('CASE WHEN k = n THEN 1.0 ELSE least(1.0, mid + half) END')} AS upper, n < 10 AS warning FROM w""",
    "bonferroni": f"WITH {_P}, m AS (SELECT *, count(p) OVER (PARTITION BY event_type) AS m FROM pv) SELECT event_type, day, p, m, {q9('least(1.0, p * m)')} AS adjusted FROM m WHERE p IS NOT NULL UNION ALL SELECT event_type, day, p, m, NULL FROM m WHERE p IS NULL",
    "benjamini_hochberg": f"""WITH {_P}, r AS (SELECT *, count(p) OVER (PARTITION BY event_type) AS m, row_number() OVER (PARTITION BY event_type, p IS NULL ORDER BY p, day) AS k FROM pv)
SELECT event_type, day, p, m, CASE WHEN p IS NOT NULL THEN {q9('least(1.0, min(p * m / k) OVER (PARTITION BY event_type, p IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING))')} END AS adjusted FROM r""",
    "iqr_outliers": f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, count(value) AS n, {q9('q1')} AS q1, {q9('q3')} AS q3, count(*) FILTER (value < q1 - 1.5 * (q3 - q1)) AS below, count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS above FROM events JOIN q USING (event_type) GROUP BY event_type, q1, q3""",
    "mad_outliers": f"""WITH m AS (SELECT quantile_cont(value, 0.5) AS median FROM events), r AS (SELECT value, median, abs(value - median) AS dev FROM events, m), k AS (SELECT quantile_cont(dev, 0.5) AS mad FROM r)
SELECT count(value) AS n, {q9('any_value(median)')} AS median, {q9('any_value(mad)')} AS mad, count(*) FILTER (mad > 0 AND 0.6745 * dev > 3.5 * mad) AS outliers FROM r, k""",
    "quantiles_type7": f"SELECT event_type, q, {q9('v')} AS value FROM (SELECT event_type, unnest([0.05, 0.3, 0.5, 0.95])::DOUBLE AS q, unnest(quantile_cont(value, [0.05, 0.3, 0.5, 0.95])) AS v FROM events GROUP BY event_type)",
    "lag1_autocorrelation": f"""WITH {CELLS}, m AS (SELECT cell, discount AS v, avg(discount) OVER (PARTITION BY cell) AS m, lag(discount) OVER (PARTITION BY cell ORDER BY trial_key) AS prior FROM trials),
a AS (SELECT cell, count(*) AS n, sum((v - m) * (prior - m)) AS c, sum((v - m) * (v - m)) AS s FROM m GROUP BY cell) SELECT cell, n, {q9('c / s')} AS r1 FROM a""",
}
