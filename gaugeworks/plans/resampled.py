"""Queries on intervals and tests by resampling, and their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import frames
from ..operators import failures as X
from ..operators import resampling as B
from ..operators import slices as L
from ..operators import stats as S
from .draws import U, reps, x
from .evaluation import PB, q9
from .inference import _PAIRS, CELLS, draw, pairs
from .slicing import _SL, REAL


def rounded(s, d):
    return frames.trials(s, d).withColumn("discount", F.floor(F.col("discount") * 1e9 + 0.5) / F.lit(1e9))


def yearly(s, d):
    """Pairs by ship year: few enough for all sign patterns."""
    lines = frames.table(s, d, "lineitem").groupBy(F.year("l_shipdate").alias("trial_key"), "l_returnflag").agg((F.floor(F.avg("l_discount") * 1e9 + 0.5) / F.lit(1e9)).alias("v"))
    return S.pair_up(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'"), "trial_key", "v")


def national(s, d):
    """A mean balance for each nation of two regions: few enough for all splits."""
    c = frames.table(s, d, "customer").join(frames.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_nationkey", F.col("n_regionkey").cast("string").alias("g")).agg((F.floor(F.avg("c_acctbal") * 1e6 + 0.5) / F.lit(1e6)).alias("v"))


def sequences(s, d):
    """A user's three days as a unit: which of a click (A) and an error (B) it holds, and which came first; (trial_key, cell, v), a trial being three days of all users."""
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    period = F.floor(F.dayofmonth("ts") / 3)
    unit = frames.table(s, d, "events").groupBy("user_id", period.alias("trial_key")).agg(at("click").alias("a"), at("error").alias("b"), F.avg("value").alias("v"))
    cell = F.when(F.col("a").isNull() & F.col("b").isNull(), "CONTROL").when(F.col("b").isNull(), "A").when(F.col("a").isNull(), "B").when(F.col("a") <= F.col("b"), "AB").otherwise("BA")
    return unit.groupBy("trial_key", cell.alias("cell")).agg((F.floor(F.avg("v") * 1e6 + 0.5) / F.lit(1e6)).alias("v"))


def ordered(s, d, name="order"):
    """Each trial's order effect, or its contrast with A first (ab) or B first (ba)."""
    wide = sequences(s, d).groupBy("trial_key").agg(*[F.max(F.when(F.col("cell") == c, F.col("v"))).alias(c) for c in ("CONTROL", "A", "B", "AB", "BA")])
    value = F.col("AB") - F.col("BA") if name == "order" else F.col(name.upper()) - F.col("A") - F.col("B") + F.col("CONTROL")
    return wide.select("trial_key", (F.floor(value * 1e6 + 0.5) / F.lit(1e6)).alias("contrast")).filter("contrast is not null")


def contrasts(s, d):
    return X.trial_contrasts(frames.trials(s, d), "discount")


def slice_tests(s, d):
    """Each slice against the rest, with the family's correction."""
    p, out = frames.pred_bin(s, d).withColumn("right", (F.col("y_true") == F.col("y_pred")).cast("double")), None
    for name, c in REAL.items():
        inside = F.when(L.compile_predicate(c, dict(p.dtypes)), "slice").otherwise("rest")
        row = S.permutation_test(p.withColumn("g", inside), "g", "right", "rest", "slice", 99, 5).select(F.lit(name).alias("slice"), "n_a", "n_b", "observed", "p")
        out = row if out is None else out.unionByName(row)
    return S.bonferroni(out, []).withColumn("rejected", F.col("adjusted") <= 0.05)


T = rounded
QUERIES = {
    "bootstrap_bca": lambda s, d: B.bca_interval(pairs(s, d).select((F.floor((F.col("y") - F.col("x")) * 1e9 + 0.5) / F.lit(1e9)).alias("v")), "v"),
    "bootstrap_unpaired": lambda s, d: B.unpaired_means(T(s, d), "cell", "discount", "CONTROL", "A", 200, 7).agg(
        F.count("*").alias("replicates"), (F.floor(F.percentile("mean", F.lit(0.025)) * 1e9 + 0.5) / F.lit(1e9)).alias("lower"), (F.floor(F.percentile("mean", F.lit(0.975)) * 1e9 + 0.5) / F.lit(1e9)).alias("upper")
    ),
    "permutation_unpaired": lambda s, d: S.permutation_test(T(s, d), "cell", "discount", "CONTROL", "A", 199, 13),
    "permutation_exact": lambda s, d: S.permutation_test(national(s, d), "g", "v", "0", "1"),
    "sign_flip_exact": lambda s, d: S.sign_flip_test(yearly(s, d)),
    "compare_groups": lambda s, d: B.compare_groups(T(s, d), "cell", "discount", "CONTROL", "A"),
    "slice_inference": slice_tests,
    "trial_bootstrap": lambda s, d: B.trial_bootstrap(contrasts(s, d)),
    "order_effect": lambda s, d: B.trial_bootstrap(ordered(s, d), seed=19),
    "interaction_class": lambda s, d: B.interaction_class(*[B.trial_bootstrap(ordered(s, d, k), seed=seed) for k, seed in (("ab", 17), ("order", 19), ("ba", 23))]),
}

_ROUND = f"{CELLS}, r AS (SELECT cell, trial_key, floor(discount * 1e9 + 0.5) / 1e9 AS v FROM trials)"


def _means(source: str, seed: int, replicates: int, name: str) -> str:
    """CTEs: `name`(rep, mean) of resampled rows of `source`(v)."""
    return f"""{name}_o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM {source}), {name}_d AS (SELECT rep, {draw(seed, 'rep', 'i', 'n')} AS i FROM {name}_o, range({replicates}) t(rep)),
{name} AS (SELECT rep, avg(v) AS mean FROM {name}_d JOIN {name}_o USING (i) GROUP BY rep)"""


def _splits(source: str, a: str, b: str, replicates: int, seed: int) -> str:
    """CTE perm(n_a, n_b, observed, hits) of `source`(g, v)."""
    return f"""po AS (SELECT g, v, i, {x(seed, 'i')} AS x FROM (SELECT g, v, row_number() OVER (ORDER BY v, g) - 1 AS i FROM {source} WHERE g IN ('{a}', '{b}'))), {reps('pq', seed, replicates)},
pn AS (SELECT count(*) FILTER (g = '{a}') AS n_a, count(*) FILTER (g = '{b}') AS n_b, avg(v) FILTER (g = '{b}') - avg(v) FILTER (g = '{a}') AS observed, sum(v) AS total FROM po),
pk AS (SELECT replicate AS rep, v, rank() OVER (PARTITION BY replicate ORDER BY {U}) AS k FROM pq, po ),
ps AS (SELECT rep, sum(CASE WHEN k <= n_b THEN v ELSE 0 END) AS sb FROM pk, pn GROUP BY rep),
perm AS (SELECT n_a, n_b, observed, count(*) FILTER (abs(sb / n_b - (total - sb) / n_a) >= abs(observed) - 1e-12 * greatest(1.0, abs(observed))) AS hits FROM pn, ps GROUP BY ALL)"""


def phi(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0.5 ELSE 0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * sign({x}) * list_sum(list_transform(range(0, 100), lambda k: exp((2 * k + 1) * ln(abs({x})) - (ln(2) * (k + 1) + lgamma(k + 1.5) - 0.5 * ln(pi()))))) END)"


def _poly(c, x: str) -> str:
    out = f"({c[0]!r})"
    for v in c[1:]:
        out = f"({out} * {x} + ({v!r}))"
    return out


def _at(level: str) -> str:
    return f"(draws[CAST(floor({level} * 199) AS INTEGER) + 1] + ({level} * 199 - floor({level} * 199)) * (draws[CAST(least(floor({level} * 199) + 1, 199) AS INTEGER) + 1] - draws[CAST(floor({level} * 199) AS INTEGER) + 1]))"


_QUANT = f"CASE WHEN p0 < 0.02425 THEN {_poly(B._C, 'sqrt(-2 * ln(p0))')} / {_poly(B._D, 'sqrt(-2 * ln(p0))')} WHEN p0 > 1 - 0.02425 THEN -{_poly(B._C, 'sqrt(-2 * ln(1 - p0))')} / {_poly(B._D, 'sqrt(-2 * ln(1 - p0))')} ELSE (p0 - 0.5) * {_poly(B._A, '((p0 - 0.5) * (p0 - 0.5))')} / {_poly(B._B, '((p0 - 0.5) * (p0 - 0.5))')} END"
_WIDE = "wd AS (SELECT trial_key, max(discount) FILTER (cell = 'CONTROL') AS y0, max(discount) FILTER (cell = 'A') AS ya, max(discount) FILTER (cell = 'B') AS yb, max(discount) FILTER (cell = 'AB') AS yab FROM trials GROUP BY 1)"
_CON = f"{CELLS}, {_WIDE}, con AS (SELECT {q9('yab - ya - yb + y0')} AS v FROM wd WHERE yab - ya - yb + y0 IS NOT NULL)"
_SEQ = """un AS (SELECT user_id, day(ts) // 3 AS trial_key, min(ts) FILTER (event_type = 'click') AS a, min(ts) FILTER (event_type = 'error') AS b, avg(value) AS v FROM events GROUP BY 1, 2),
ce AS (SELECT trial_key, CASE WHEN a IS NULL AND b IS NULL THEN 'CONTROL' WHEN b IS NULL THEN 'A' WHEN a IS NULL THEN 'B' WHEN a <= b THEN 'AB' ELSE 'BA' END AS cell, floor(avg(v) * 1e6 + 0.5) / 1e6 AS v FROM un GROUP BY 1, 2),
sw AS (SELECT trial_key, max(v) FILTER (cell = 'CONTROL') AS y0, max(v) FILTER (cell = 'A') AS ya, max(v) FILTER (cell = 'B') AS yb, max(v) FILTER (cell = 'AB') AS yab, max(v) FILTER (cell = 'BA') AS yba FROM ce GROUP BY 1)"""


def _seq(name: str, value: str) -> str:
    return f"{name} AS (SELECT floor(({value}) * 1e6 + 0.5) / 1e6 AS v FROM sw WHERE {value} IS NOT NULL)"


_ORD = f"{_SEQ}, {_seq('ord', 'yab - yba')}"


def _trial(source: str, seed: int, name: str) -> str:
    return f"""{_means(source, seed, 200, f'{name}_m')}, {name}_e AS (SELECT count(*) AS n, avg(v) AS estimate FROM {source}),
{name}_g AS (SELECT n, estimate, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, avg(CASE WHEN (mean > 0) = (estimate > 0) THEN 1.0 ELSE 0.0 END) AS same, least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) AS tail, count(mean) AS b
FROM {name}_e, {name}_m GROUP BY n, estimate),
{name} AS (SELECT n, {q9('estimate')} AS estimate, {q9('lo')} AS lower, {q9('hi')} AS upper, {q9('same')} AS sign_fraction, {q9('least(1.0, 2.0 * (tail + 1) / (b + 1))')} AS bootstrap_p, 'COMPUTED' AS status FROM {name}_g)"""


def _slice_sql() -> str:
    ctes, rows = [], []
    for k, (name, c) in enumerate(_SL.items()):
        sql = _splits(f"s{k}", "rest", "slice", 99, 5)
        for t in ("po", "pq", "pn", "pk", "ps", "perm"):
            sql = sql.replace(f"{t} AS (", f"{t}{k} AS (").replace(f"FROM {t}", f"FROM {t}{k}").replace(f", {t} ", f", {t}{k} ")
        sql = sql.replace(f"FROM pk{k}, pn GROUP", f"FROM pk{k}, pn{k} GROUP")
        ctes += [f"s{k} AS (SELECT CASE WHEN {c} THEN 'slice' ELSE 'rest' END AS g, CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM p)", sql]
        rows.append(f"SELECT '{name}' AS slice, n_a, n_b, {q9('observed')} AS observed, {q9('(hits + 1) / 100.0')} AS p FROM perm{k}")
    return f"WITH {PB}, {', '.join(ctes)}, u AS ({' UNION ALL '.join(rows)}) SELECT *, count(p) OVER () AS m, {q9('least(1.0, p * count(p) OVER ())')} AS adjusted, {q9('least(1.0, p * count(p) OVER ())')} <= 0.05 AS rejected FROM u"


_GROUP = f"{_ROUND}, src AS (SELECT cell AS g, v FROM r)"
_SIDES = f"sa AS (SELECT v FROM src WHERE g = 'CONTROL'), sb AS (SELECT v FROM src WHERE g = 'A'), {_means('sa', 7, 200, 'ma')}, {_means('sb', 8, 200, 'mb')}, dm AS (SELECT mb.mean - ma.mean AS mean FROM ma JOIN mb USING (rep))"
SQL = {
    "bootstrap_bca": f"""WITH {_PAIRS}, src AS (SELECT floor((y - x) * 1e9 + 0.5) / 1e9 AS v FROM pr), {_means('src', 7, 200, 'mm')}, sz AS (SELECT count(*) AS n, avg(v) AS m FROM src),
cu AS (SELECT sum(power(v - m, 3)) AS s3, sum(power(v - m, 2)) AS s2 FROM src, sz), dr AS (SELECT list_sort(list(mean)) AS draws FROM mm),
k0 AS (SELECT n, m, draws, s3 / (6 * power(s2, 1.5)) AS a, list_sum(list_transform(draws, lambda d: CASE WHEN d < m - 1e-12 THEN 1.0 WHEN d <= m + 1e-12 THEN 0.5 ELSE 0.0 END)) / len(draws) AS p0 FROM sz, cu, dr),
k1 AS (SELECT *, {_QUANT} AS x FROM k0), k2 AS (SELECT *, ({phi('x')} - p0) * sqrt(2 * pi()) * exp(x * x / 2) AS u FROM k1), k3 AS (SELECT *, x - u / (1 + x * u / 2) AS z0 FROM k2),
k4 AS (SELECT *, z0 + (z0 - 1.959963984540054) / (1 - a * (z0 - 1.959963984540054)) AS zl, z0 + (z0 + 1.959963984540054) / (1 - a * (z0 + 1.959963984540054)) AS zh FROM k3), k5 AS (SELECT *, {phi('zl')} AS lo, {phi('zh')} AS hi FROM k4)
SELECT n, {q9('m')} AS estimate, {q9(_at('lo'))} AS lower, {q9(_at('hi'))} AS upper, {q9(_at('0.025'))} AS percentile_lower, {q9(_at('0.975'))} AS percentile_upper, {q9('z0')} AS z0, {q9('a')} AS acceleration, 'DERIVED' AS status FROM k5""",
    "bootstrap_unpaired": f"WITH {_GROUP}, {_SIDES} SELECT count(*) AS replicates, {q9('quantile_cont(mean, 0.025)')} AS lower, {q9('quantile_cont(mean, 0.975)')} AS upper FROM dm",
    "permutation_unpaired": f"WITH {_GROUP}, {_splits('src', 'CONTROL', 'A', 199, 13)} SELECT n_a, n_b, {q9('observed')} AS observed, hits, CAST(199 AS INTEGER) AS replicates, {q9('(hits + 1) / 200.0')} AS p FROM perm",
    "permutation_exact": f"""WITH src AS (SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS g, floor(avg(c_acctbal) * 1e6 + 0.5) / 1e6 AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
po AS (SELECT g, v, row_number() OVER (ORDER BY v, g) - 1 AS i FROM src WHERE g IN ('0', '1')), pn AS (SELECT count(*) FILTER (g = '0') AS n_a, count(*) FILTER (g = '1') AS n_b, avg(v) FILTER (g = '1') - avg(v) FILTER (g = '0') AS observed, sum(v) AS total FROM po),
ms AS (SELECT mk, n_a, n_b, observed, total FROM range({1 << 14}) t(mk), pn WHERE mk < (1 << CAST(n_a + n_b AS INTEGER)) AND bit_count(mk) = n_b),
sm AS (SELECT mk, n_a, n_b, observed, total, sum(CASE WHEN (mk >> CAST(i AS INTEGER)) % 2 = 1 THEN v ELSE 0 END) AS sb FROM ms, po GROUP BY ALL)
SELECT n_a, n_b, {q9('observed')} AS observed, count(*) FILTER (abs(sb / n_b - (total - sb) / n_a) >= abs(observed) - 1e-12 * greatest(1.0, abs(observed))) AS hits, CAST(count(*) AS INTEGER) AS replicates,
{q9('count(*) FILTER (abs(sb / n_b - (total - sb) / n_a) >= abs(observed) - 1e-12 * greatest(1.0, abs(observed))) / count(*)')} AS p FROM sm GROUP BY n_a, n_b, observed""",
    "sign_flip_exact": f"""WITH t AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS k, l_returnflag AS f, floor(avg(l_discount) * 1e9 + 0.5) / 1e9 AS v FROM lineitem GROUP BY 1, 2), pr AS (SELECT a.v AS x, b.v AS y FROM t a JOIN t b USING (k) WHERE a.f = 'A' AND b.f = 'R'),
o AS (SELECT y - x AS dd, row_number() OVER (ORDER BY x, y) - 1 AS i, count(*) OVER () AS n FROM pr), ob AS (SELECT count(*) AS n, avg(dd) AS observed, sum(abs(dd)) AS size FROM o),
m AS (SELECT mk, avg(dd * (1 - 2 * ((mk >> CAST(i AS INTEGER)) % 2))) AS m FROM o, range({1 << 15}) t(mk) WHERE mk < (1 << CAST(n AS INTEGER)) GROUP BY mk)
SELECT n, {q9('observed')} AS observed, count(*) FILTER (abs(m) >= abs(observed) - 1e-12 * greatest(1.0, size)) AS hits, CAST(count(*) AS INTEGER) AS replicates, {q9('count(*) FILTER (abs(m) >= abs(observed) - 1e-12 * greatest(1.0, size)) / count(*)')} AS p FROM m, ob GROUP BY n, observed""",
    "compare_groups": f"""WITH {_GROUP}, {_SIDES}, {_splits('src', 'CONTROL', 'A', 199, 7)}, iv AS (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM dm),
g AS (SELECT count(v) FILTER (g = 'CONTROL') AS n_a, count(v) FILTER (g = 'A') AS n_b, avg(v) FILTER (g = 'CONTROL') AS m_a, avg(v) FILTER (g = 'A') AS m_b, var_samp(v) FILTER (g = 'CONTROL') AS v_a, var_samp(v) FILTER (g = 'A') AS v_b FROM src),
c AS (SELECT *, m_b - m_a AS diff, (m_b - m_a) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) AS dd FROM g)
SELECT c.n_a, c.n_b, {q9('m_a')} AS mean_a, {q9('m_b')} AS mean_b, {q9('diff')} AS difference, {q9('diff / abs(m_a)')} AS relative, {q9('dd')} AS cohen_d, {q9('dd * (1 - 3.0 / (4 * (c.n_a + c.n_b - 2) - 1))')} AS hedges_g,
{q9('(hits + 1) / 200.0')} AS p, {q9('lo')} AS lower, {q9('hi')} AS upper, 'DERIVED' AS status FROM c, perm, iv""",
    "slice_inference": _slice_sql(),
    "trial_bootstrap": f"WITH {_CON}, {_trial('con', 17, 'tb')} SELECT * FROM tb",
    "order_effect": f"WITH {_ORD}, {_trial('ord', 19, 'ob')} SELECT * FROM ob",
    "interaction_class": f"""WITH {_ORD}, {_seq('sab', 'yab - ya - yb + y0')}, {_seq('sba', 'yba - ya - yb + y0')}, {_trial('sab', 17, 'tb')}, {_trial('ord', 19, 'ob')}, {_trial('sba', 23, 'bb')},
z AS (SELECT tb.*, tb.lower > 0 OR tb.upper < 0 AS ex, bb.lower > 0 OR bb.upper < 0 AS exb, tb.estimate <> 0 AS big, (ob.lower > 0 OR ob.upper < 0) AND ob.estimate <> 0 AS ox FROM tb, ob, bb)
SELECT CASE WHEN ox AND (ex OR exb) THEN 'ORDER_DEPENDENT_INTERACTION' WHEN ox THEN 'POSSIBLE_INTERACTION' WHEN ex AND big AND sign_fraction >= 0.9 THEN 'OBSERVED_INTERACTION' WHEN ex THEN 'POSSIBLE_INTERACTION' ELSE 'NO_EVIDENCE' END AS class,
ex AS excludes_zero, exb AS ba_excludes_zero, big AS magnitude_met, ox AS order_excludes_zero FROM z""",
}
