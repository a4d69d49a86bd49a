"""Queries that compare groups, pairs, submissions under one protocol and phases of runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..operators import comparisons as K
from ..operators import replicates as R
from .draws import U, reps, weighted, x
from .evaluation import PB, q9
from .inference import _PAIRS, CELLS, DE, draw, pairs
from .replicated import _split
from .resampled import _QUANT, _at, phi

E = frames.drift_events


def bold():
    """A score further from a half."""
    return F.col("score") / (F.col("score") + (1 - F.col("score")) * 0.4)


def two_rights(s, d):
    """What a bolder reading of the length score gains on each sample: (sample_id, lang, gain)."""
    right = lambda score: (F.when(score >= 0.5, 1).otherwise(0) == F.col("y_true")).cast("int")
    return frames.pred_bin(s, d).select("sample_id", "lang", (right(bold()) - right(F.col("score"))).alias("gain"))


def submissions(s, d):
    """Three models on each language's documents; one saw only every other sample: (submission, model, lang, source, sample_id, right, brier)."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), v.alias("v")) for m, v in (("length", F.col("score")), ("bold", bold()), ("partial", F.col("score")))])
    rows = frames.pred_bin(s, d).select("sample_id", "y_true", "lang", "source", F.inline(each)).filter("model <> 'partial' or sample_id % 2 = 0")
    right = (F.when(F.col("v") >= 0.5, 1).otherwise(0) == F.col("y_true")).cast("double")
    brier = F.when(F.col("model") != "bold", F.pow(F.col("v") - F.col("y_true"), F.lit(2)))
    return rows.select(F.concat_ws("/", "lang", "model").alias("submission"), "model", "lang", "source", "sample_id", right.alias("right"), brier.alias("brier"))


def protocol_frames(s, d):
    rows = submissions(s, d)
    f = lambda k, v: F.struct(F.lit(k).alias("field"), v.cast("string").alias("value"))
    a = rows.groupBy("submission", "lang", "model").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"), F.avg("right").alias("accuracy"), F.avg("brier").alias("brier"))
    protocols = a.select("submission", F.inline(F.array(f("dataset", F.col("lang")), f("model", F.col("model")), f("samples", F.concat_ws(":", "n", "ids")))))
    m = lambda c: F.struct(F.lit("baseline").alias("section"), F.lit(c).alias("key"), F.col(c).alias("value"))
    base = a.select("submission", F.inline(F.array(m("accuracy"), m("brier")))).filter("value is not null")
    slices = rows.groupBy("submission", "source").agg(F.avg("right").alias("value")).select("submission", F.lit("slice").alias("section"), F.coalesce("source", F.lit("")).alias("key"), "value")
    one, two = a.select("lang", F.col("submission").alias("a")), a.select("lang", F.col("submission").alias("b"))
    return protocols, base.unionByName(slices), one.join(two, "lang").filter("a < b").select("a", "b")


def aspects():
    return {
        "missingness": {"gap": F.col("event_id") % 9 == 0, "event_type": F.col("event_id") % 11 == 0, "value": F.col("value").isNull()},
        "validity": {"value": (F.col("value") < 5) | (F.col("value") > 200), "user_id": F.col("user_id") < 0, "late": (F.col("event_type") == "error") & (F.col("value") > 50)},
    }


def timed(s, d):
    """Events as trials: the first hours of a day warm up, errors fail."""
    e = frames.table(s, d, "events")
    phase, state = F.when(F.hour("ts") < 6, "WARM_UP").otherwise("MEASURED"), F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED")
    return e.select(F.weekday("ts").alias("run"), phase.alias("phase"), state.alias("state"), "value")


QUERIES = {
    "difference_of_means": lambda s, d: K.difference_interval(E(s, d), "side", "value", "event_id", "reference", "comparison"),
    "difference_of_medians": lambda s, d: K.difference_interval(E(s, d), "side", "value", "event_id", "reference", "comparison", "median"),
    "compare_pairs": lambda s, d: K.compare_pairs(pairs(s, d), "trial_key"),
    "group_comparison": lambda s, d: K.group_comparison(E(s, d), "side", "reference", "comparison", "event_id", aspects()),
    "paired_family": lambda s, d: K.paired_family(two_rights(s, d), "lang", "sample_id", F.col("gain")),
    "compare_submissions": lambda s, d: K.compare_submissions(*protocol_frames(s, d)),
    "additive_description": lambda s, d: K.additive_description(frames.trials(s, d), "trial_key", ["discount", "price"]),
    "phase_resources": lambda s, d: K.phase_resources(timed(s, d), ["run"], "phase", "state", "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}),
}

_EVENTS = f"{DE}, src AS (SELECT side, value AS v, {x(53, 'side', 'event_id')} AS x FROM e WHERE value IS NOT NULL), {weighted('src', 'wt', 53, 200)}"
_MEANS = """es AS (SELECT side, replicate, sum(w) AS n, sum(w * v) / sum(w) AS e FROM wt GROUP BY 1, 2),
jk AS (SELECT CASE WHEN src.side = 'comparison' THEN v - e ELSE e - v END / (n - 1) AS d FROM src JOIN es ON src.side = es.side AND replicate = 0)"""
# the values' ranks among those left are counted anew as each row is left out
_MEDIANS = """cu AS (SELECT side, replicate, v, sum(w) OVER (PARTITION BY side, replicate ORDER BY v, x ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY side, replicate) AS n FROM wt),
es AS (SELECT side, replicate, any_value(n) AS n, (min(v) FILTER (upto >= floor((n + 1) / 2)) + min(v) FILTER (upto >= floor(n / 2) + 1)) / 2 AS e FROM cu GROUP BY 1, 2),
sl AS (SELECT side, list(v ORDER BY v) AS s, count(*) AS n FROM src GROUP BY 1), ix AS (SELECT side, s, unnest(range(1, n + 1)) AS i, n // 2 AS lo, (n - 1) // 2 + 1 AS hi FROM sl),
th AS (SELECT CASE WHEN side = 'comparison' THEN 1 ELSE -1 END * ((s[lo + CAST(i <= lo AS INTEGER)] + s[hi + CAST(i <= hi AS INTEGER)]) / 2 - (SELECT e FROM es WHERE es.side = ix.side AND replicate = 0)) AS t FROM ix),
jk AS (SELECT (SELECT avg(t) FROM th) - t AS d FROM th)"""


def _bca(middle: str) -> str:
    """Both intervals of the difference between the sides, from es(side, replicate, n, e) and jk(d)."""
    return f"""WITH {_EVENTS}, {middle}, wi AS (SELECT replicate, max(e) FILTER (side = 'comparison') - max(e) FILTER (side = 'reference') AS t FROM es GROUP BY 1),
sz AS (SELECT max(n) FILTER (side = 'reference') AS n_a, max(n) FILTER (side = 'comparison') AS n_b FROM es WHERE replicate = 0), dr AS (SELECT list_sort(list(t)) AS draws FROM wi WHERE replicate > 0),
k0 AS (SELECT n_a, n_b, t AS m, draws, (SELECT sum(power(d, 3)) / (6 * power(sum(power(d, 2)), 1.5)) FROM jk) AS a, list_sum(list_transform(draws, lambda d: CASE WHEN d < t - 1e-12 THEN 1.0 WHEN d <= t + 1e-12 THEN 0.5 ELSE 0.0 END)) / len(draws) AS p0 FROM sz, wi, dr WHERE replicate = 0),
k1 AS (SELECT *, {_QUANT} AS x FROM k0), k2 AS (SELECT *, ({phi('x')} - p0) * sqrt(2 * pi()) * exp(x * x / 2) AS u FROM k1), k3 AS (SELECT *, x - u / (1 + x * u / 2) AS z0 FROM k2),
k4 AS (SELECT *, z0 + (z0 - 1.959963984540054) / (1 - a * (z0 - 1.959963984540054)) AS zl, z0 + (z0 + 1.959963984540054) / (1 - a * (z0 + 1.959963984540054)) AS zh FROM k3), k5 AS (SELECT *, {phi('zl')} AS lo, {phi('zh')} AS hi FROM k4)
SELECT CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, {q9('m')} AS estimate, {q9(_at('lo'))} AS lower, {q9(_at('hi'))} AS upper, {q9(_at('0.025'))} AS percentile_lower, {q9(_at('0.975'))} AS percentile_upper, {q9('z0')} AS z0, {q9('a')} AS acceleration, 'DERIVED' AS status FROM k5"""


_FLAGS = {
    ("missingness", "gap"): "event_id % 9 = 0", ("missingness", "event_type"): "event_id % 11 = 0", ("missingness", "value"): "value IS NULL",
    ("validity", "value"): "value < 5 OR value > 200", ("validity", "user_id"): "user_id < 0", ("validity", "late"): "event_type = 'error' AND value > 50",
}
_BH = "least(1.0, min(p * m / k) OVER ({}ORDER BY k DESC ROWS UNBOUNDED PRECEDING))"


def _wilson(k: str, n: str) -> tuple[str, str]:
    z = 1.959963984540054
    mid, half, scale = f"({k} / {n} + {z * z} / (2 * {n}))", f"{z} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {z * z} / (4.0 * {n} * {n}))", f"(1 + {z * z} / {n})"
    return f"CASE WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, ({mid} - {half}) / {scale}) END", f"CASE WHEN {k} = {n} THEN 1.0 ELSE least(1.0, ({mid} + {half}) / {scale}) END"


def _groups() -> str:
    flags = ", ".join(f"CAST(coalesce({c}, false) AS INTEGER) AS f{i}" for i, c in enumerate(_FLAGS.values()))
    sums = ", ".join(f"sum(f{i}) FILTER (l) AS y{i}, sum(f{i}) AS k{i}" for i in range(len(_FLAGS)))
    long = " UNION ALL ".join(f"SELECT '{a}' AS aspect, '{f}' AS feature, replicate, y{i} AS y, k{i} AS k, mb, ma FROM su" for i, (a, f) in enumerate(_FLAGS))
    (rl, ru), (cl, cu) = _wilson("kr", "nr"), _wilson("kc", "nc")
    return f"""WITH {DE}, src AS (SELECT side = 'comparison' AS own, {flags}, {x(61, 'event_id')} AS x FROM e), {_split('src', 61, 199)},
su AS (SELECT replicate, count(*) FILTER (l) AS mb, count(*) FILTER (NOT l) AS ma, {sums} FROM lab GROUP BY 1), lo AS ({long}), g AS (SELECT *, coalesce(y, 0) / mb - (k - coalesce(y, 0)) / ma AS gap FROM lo),
o AS (SELECT aspect, feature, k, coalesce(y, 0) AS kc, k - coalesce(y, 0) AS kr, ma AS nr, mb AS nc, gap AS observed FROM g WHERE replicate = 0),
h AS (SELECT o.*, (SELECT count(*) FROM g WHERE g.aspect = o.aspect AND g.feature = o.feature AND replicate > 0 AND abs(gap) >= abs(observed) - 1e-12) AS hits FROM o),
pv AS (SELECT *, CASE WHEN k > 0 OR aspect = 'missingness' THEN {q9('(hits + 1) / 200.0')} END AS p FROM h),
r AS (SELECT *, count(p) OVER (PARTITION BY aspect) AS m, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY aspect, p IS NULL ORDER BY p, feature) END AS k2 FROM pv),
a AS (SELECT *, CASE WHEN p IS NOT NULL THEN {q9('least(1.0, min(p * m / k2) OVER (PARTITION BY aspect, p IS NULL ORDER BY k2 DESC ROWS UNBOUNDED PRECEDING))')} END AS adjusted FROM r)
SELECT aspect, feature, nr AS n_reference, nc AS n_comparison, CAST(kr AS BIGINT) AS k_reference, CAST(kc AS BIGINT) AS k_comparison, {q9('kr / nr')} AS rate_reference, {q9('kc / nc')} AS rate_comparison, {q9(rl)} AS lower_reference, {q9(ru)} AS upper_reference,
{q9(cl)} AS lower_comparison, {q9(cu)} AS upper_comparison, {q9('observed')} AS difference, p, 'DERIVED' AS status, m, adjusted, adjusted <= 0.05 AS rejected FROM a"""


_SUBMITTED = f"""{PB}, v AS (SELECT sample_id, y_true, lang, source, model, CASE WHEN model = 'bold' THEN score / (score + (1 - score) * 0.4) ELSE score END AS v FROM p, (VALUES ('length'), ('bold'), ('partial')) t(model) WHERE model <> 'partial' OR sample_id % 2 = 0),
w AS (SELECT lang || '/' || model AS submission, lang, model, source, sample_id, CASE WHEN (CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) = y_true THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, CASE WHEN model <> 'bold' THEN power(v - y_true, 2) END AS brier FROM v),
a AS (SELECT submission, lang, model, count(*) || ':' || sum(sample_id) AS samples, avg(hit) AS accuracy, avg(brier) AS brier FROM w GROUP BY 1, 2, 3),
res AS (SELECT submission, 'baseline' AS section, 'accuracy' AS key, accuracy AS value FROM a UNION ALL SELECT submission, 'baseline', 'brier', brier FROM a WHERE brier IS NOT NULL UNION ALL SELECT submission, 'slice', coalesce(source, ''), avg(hit) FROM w GROUP BY submission, source),
prs AS (SELECT x.submission AS a, y.submission AS b, x.samples = y.samples AS same FROM a x JOIN a y USING (lang) WHERE x.submission < y.submission)"""

SQL = {
    "difference_of_means": _bca(_MEANS),
    "difference_of_medians": _bca(_MEDIANS),
    "compare_pairs": f"""WITH {_PAIRS}, src AS (SELECT trial_key, x AS u, y AS v, {x(59, 'trial_key')} AS x FROM pr), {weighted('src', 'wt', 59, 200)},
mm AS (SELECT replicate, sum(w * (v - u)) / sum(w) AS mean FROM wt WHERE replicate > 0 GROUP BY 1 HAVING sum(w) > 0), o AS (SELECT v - u AS dd, row_number() OVER (ORDER BY u, v) - 1 AS i FROM src), ob AS (SELECT avg(dd) AS observed FROM o),
fl AS (SELECT rep, avg(dd * (1 - 2 * ({draw(11, 'rep', 'i', '2')}))) AS m FROM o, range(999) t(rep) GROUP BY rep), h AS (SELECT count(*) FILTER (abs(m) >= abs(observed) - 1e-12) AS hits FROM fl, ob)
SELECT (SELECT count(*) FROM src) AS n, (SELECT {q9('avg(u)')} FROM src) AS mean_x, (SELECT {q9('avg(v)')} FROM src) AS mean_y, (SELECT {q9('avg(v - u)')} FROM src) AS mean_difference, (SELECT {q9('stddev_samp(v - u)')} FROM src) AS std_difference,
(SELECT {q9('avg(v - u) / stddev_samp(v - u)')} FROM src) AS dz, {q9('(hits + 1) / 1000.0')} AS p, (SELECT {q9('quantile_cont(mean, 0.025)')} FROM mm) AS lower, (SELECT {q9('quantile_cont(mean, 0.975)')} FROM mm) AS upper, 'DERIVED' AS status FROM h""",
    "group_comparison": _groups(),
    "paired_family": f"""WITH {PB}, d AS (SELECT sample_id, lang, CAST((CASE WHEN score / (score + (1 - score) * 0.4) >= 0.5 THEN 1 ELSE 0 END) = y_true AS INTEGER) - CAST(y_pred = y_true AS INTEGER) AS d, {x(67, 'sample_id')} AS x FROM p WHERE y_true IS NOT NULL), {reps('rp', 67, 999)},
s AS (SELECT lang, replicate, sum(CASE WHEN {U} < {R.PRIME // 2} THEN -d ELSE d END) AS s FROM d, rp GROUP BY 1, 2), o AS (SELECT lang, count(*) AS n, sum(d) AS t FROM d GROUP BY 1),
pv AS (SELECT lang, n, {q9('any_value(t) / n')} AS mean_difference, count(*) FILTER (abs(s) >= abs(t)) AS hits, CASE WHEN n >= 2 THEN {q9('(count(*) FILTER (abs(s) >= abs(t)) + 1) / 1000.0')} END AS p FROM o JOIN s USING (lang) GROUP BY lang, n),
r AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p, lang) AS k FROM pv), a AS (SELECT *, {q9(_BH.format(''))} AS adjusted FROM r) SELECT lang, n, mean_difference, hits, p, m, adjusted, adjusted <= 0.05 AS rejected FROM a""",
    "compare_submissions": f"""WITH {_SUBMITTED}, xa AS (SELECT a, b, section, key, value FROM prs JOIN res ON a = submission WHERE same), xb AS (SELECT a, b, section, key, value FROM prs JOIN res ON b = submission WHERE same)
SELECT a, b, section, key, {q9('xa.value')} AS value_a, {q9('xb.value')} AS value_b, {q9('xb.value - xa.value')} AS difference, CASE WHEN xa.value IS NULL THEN 'ONLY_B' WHEN xb.value IS NULL THEN 'ONLY_A' ELSE 'BOTH' END AS status FROM xa FULL JOIN xb USING (a, b, section, key)
UNION ALL SELECT a, b, 'protocol', 'samples', NULL, NULL, NULL, 'PROTOCOL_DIFFERS' FROM prs WHERE NOT same""",
    "additive_description": f"""WITH {CELLS}, l AS (SELECT 'discount' AS metric, cell, trial_key, discount AS v FROM trials UNION ALL SELECT 'price', cell, trial_key, price FROM trials),
ch AS (SELECT metric, cell, l.v - c.v AS e FROM l JOIN (SELECT metric, trial_key, v FROM l WHERE cell = 'CONTROL') c USING (metric, trial_key)),
ef AS (SELECT metric, count(e) FILTER (cell = 'A') AS n_a, count(e) FILTER (cell = 'B') AS n_b, count(e) FILTER (cell = 'AB') AS n_ab, avg(e) FILTER (cell = 'A') AS ea, avg(e) FILTER (cell = 'B') AS eb, avg(e) FILTER (cell = 'AB') AS eab FROM ch GROUP BY 1)
SELECT metric, n_a, n_b, n_ab, {q9('ea')} AS effect_a, {q9('eb')} AS effect_b, {q9('eab')} AS effect_ab, {q9('ea + eb')} AS additive_reference, {q9('eab - (ea + eb)')} AS difference_from_additive FROM ef""",
    "phase_resources": f"""WITH r AS (SELECT CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS run, hour(ts) < 6 AS warm, event_type = 'error' AS bad, value FROM events), g AS (SELECT *, CASE WHEN NOT warm AND NOT bad AND value >= 0 THEN value END AS v FROM r)
SELECT run, count(*) AS n_trials, count(*) FILTER (warm) AS n_warm_up, count(*) FILTER (NOT warm AND bad) AS n_failed, count(v) AS n, {q9('avg(v)')} AS mean, {q9('stddev_samp(v)')} AS std, {q9('stddev_samp(v) / avg(v)')} AS cv, {q9('quantile_cont(v, 0.1)')} AS p10, {q9('quantile_cont(v, 0.5)')} AS p50,
{q9('quantile_cont(v, 0.9)')} AS p90, {q9('count(v) / sum(v)')} AS throughput, CASE count(v) WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'INCONCLUSIVE' ELSE 'DERIVED' END AS status FROM g GROUP BY run""",
}
