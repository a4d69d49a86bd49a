"""Fault and stress queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..functions import identity as I
from ..operators import faults as A
from ..status import q9 as Q9
from .evaluation import PB, q9

P = frames.pred_bin
FAULTS = {"uniform": A.uniform_noise(0.3), "dropout": A.dropout(0.2), "scale": A.scaling(0.6), "offset": A.offset(-0.2), "outlier": A.outlier(0.1, 0.5), "salt": A.salt_and_pepper(0.2, 0.0, 1.0), "bright": A.brightness(0.1), "both": A.compound(A.scaling(0.6), A.offset(-0.1)), "reversed": A.compound(A.offset(-0.1), A.scaling(0.6))}
SEEDS = (1, 2, 3)


def rule(x):
    return F.when(x >= 0.5, 1).otherwise(0)


def trials(s, d):
    return A.sweep(P(s, d), "sample_id", "score", rule, FAULTS, SEEDS)


def vectors(s, d):
    return frames.table(s, d, "embeddings").select("vec_id", "embedding")


def faulty(s, d, fault, seed):
    x = A.dropout(0.2)(F.col("score"), F.col("sample_id"), seed)
    return P(s, d).withColumn("score", x).withColumn("y_pred", rule(F.col("score")))


def nine(values):
    return F.transform(values, lambda x: F.floor(x.cast("double") * 1e6 + 0.5) / F.lit(1e6))


LABELS = list(frames.PRIORITIES)
QUERIES = {
    "fault_sweep": trials,
    "fault_assessment": lambda s, d: A.assessment(trials(s, d)),
    "fault_gaussian_noise": lambda s, d: P(s, d).select("sample_id", Q9(F.floor(A.gaussian_noise(0.1)(F.col("score"), F.col("sample_id"), 4) * 1e6 + 0.5) / F.lit(1e6)).alias("score")),
    "fault_missing_values": lambda s, d: P(s, d).select("sample_id", Q9(A.missing(0.25)(F.col("score"), F.col("sample_id"), 9)).alias("score")),
    "label_flip": lambda s, d: frames.pred_multi(s, d).select("sample_id", A.label_flip(F.col("y_true"), F.col("sample_id"), LABELS, 0.1, 3).alias("y")),
    "label_randomize": lambda s, d: frames.pred_multi(s, d).select("sample_id", A.label_randomize(F.col("y_true"), F.col("sample_id"), LABELS, 0.1, 3).alias("y")),
    "feature_mask": lambda s, d: vectors(s, d).select("vec_id", nine(A.feature_mask(F.col("embedding").cast("array<double>"), 0.25, 64, 2)).alias("v")),
    "feature_roll": lambda s, d: vectors(s, d).select("vec_id", nine(A.cyclic_roll(F.col("embedding"), 3)).alias("v")),
    "image_contrast": lambda s, d: vectors(s, d).select("vec_id", nine(A.image_contrast(F.col("embedding").cast("array<double>"), 1.5)).alias("v")),
    "image_box_blur": lambda s, d: vectors(s, d).select("vec_id", nine(A.box_blur(F.col("embedding").cast("array<double>"), 8)).alias("v")),
    "image_occlusion": lambda s, d: vectors(s, d).select("vec_id", nine(A.occlusion(F.col("embedding"), F.col("vec_id"), 8, 3, 6)).alias("v")),
    "random_subset": lambda s, d: A.random_subset(P(s, d), "sample_id", 0.15, 8).select("sample_id"),
    "degradation": lambda s, d: A.degradation(trials(s, d).groupBy("fault").agg(F.avg("baseline").alias("baseline"), F.avg("accuracy").alias("treated")), "fault", "fault"),
    "output_stability": lambda s, d: A.stability(P(s, d), faulty(s, d, "dropout", 1), "sample_id"),
    "newly_wrong": lambda s, d: P(s, d).filter("y_true = y_pred").select("sample_id").join(faulty(s, d, "dropout", 1).filter("y_true != y_pred").select("sample_id"), "sample_id", "left_semi"),
    "severity_band": lambda s, d: P(s, d).groupBy(I.severity_band(F.col("score"), [0.25, 0.5, 0.75, 0.9]).alias("band")).agg(F.count("*").alias("n")),
    "entity_ids": lambda s, d: frames.table(s, d, "nation").select("n_nationkey", I.entity_id("nat", "Nation", F.col("n_name"), F.col("n_regionkey")).alias("id")),
    "dataset_fingerprint": lambda s, d: I.fingerprint(frames.table(s, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
}


def framed(*fields: str) -> str:
    return " || ".join(f"coalesce(length(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR) || ';', '-;')" for f in fields)


def u(seed: int, key: str = "sample_id", more: str = "") -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || {key}{more}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _faulty(name: str, s: int) -> str:
    both = {"uniform": f"score + 0.3 * (2 * {u(s)} - 1)", "dropout": f"CASE WHEN {u(s)} < 0.2 THEN 0.0 ELSE score END", "scale": "score * 0.6::DOUBLE", "offset": "score + -0.2::DOUBLE",
        "outlier": f"CASE WHEN {u(s)} < 0.1 THEN score + CASE WHEN {u(s, more=chr(32) + '||' + repr(':sign'))} < 0.5 THEN -0.5 ELSE 0.5 END ELSE score END",
        "salt": f"CASE WHEN {u(s)} < 0.1 THEN 0.0 WHEN {u(s)} < 0.2 THEN 1.0 ELSE score END", "bright": "least(greatest(score + 0.1::DOUBLE, 0.0), 1.0)",
        "both": "score * 0.6::DOUBLE + -0.1::DOUBLE", "reversed": "(score + -0.1::DOUBLE) * 0.6::DOUBLE"}
    return both[name]


_TR = PB + ", tr AS (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS fault, CAST({s} AS INTEGER) AS seed, count(*) AS n, avg(CASE WHEN ({_faulty(f, s)} >= 0.5) = (y_true = 1) THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS b,
count(*) FILTER (y_pred = y_true AND ({_faulty(f, s)} >= 0.5) <> (y_true = 1)) AS newly_wrong FROM p"""
    for f in FAULTS for s in SEEDS
) + f"), tq AS (SELECT fault, seed, n, {q9('a')} AS accuracy, {q9('b')} AS baseline, {q9('a - b')} AS delta, newly_wrong FROM tr)"
_DROP = f"CASE WHEN {u(1)} < 0.2 THEN 0.0 ELSE score END"
_LAB = "[" + ", ".join(f"'{c}'" for c in LABELS) + "]"
_O = "sample_id FROM (SELECT o_orderkey AS sample_id, o_orderpriority AS y FROM orders)"


def six(x: str) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) / 1e6"


def _masked() -> list[int]:
    import hashlib

    return sorted(range(64), key=lambda i: hashlib.md5(f"2:{i}".encode()).hexdigest())[:16]


_U = "u AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)"
SQL = {
    "fault_sweep": f"WITH {_TR} SELECT * FROM tq",
    "fault_assessment": f"""WITH {_TR}, m AS (SELECT fault, count(*) AS trials, avg(delta) AS m, min(delta) AS w FROM tq GROUP BY fault)
SELECT fault, trials, {q9('m')} AS mean_delta, {q9('w')} AS worst, CASE WHEN trials < 2 THEN 'INCONCLUSIVE' WHEN abs(m) < 0.02 THEN 'NO_MEASURED' WHEN abs(m) < 0.05 THEN 'MEASURED' WHEN abs(m) < 0.10 THEN 'MODERATE' WHEN abs(m) < 0.20 THEN 'SUBSTANTIAL' ELSE 'SEVERE' END AS effect FROM m""",
    "fault_gaussian_noise": f"WITH {PB} SELECT sample_id, {q9(six(f'score + 0.1 * (sqrt(-2 * ln(greatest({u(4, more=chr(32) + chr(124) * 2 + repr(chr(58) + chr(97)))}, 1e-12))) * cos(2 * pi() * {u(4, more=chr(32) + chr(124) * 2 + repr(chr(58) + chr(98)))}))'))} AS score FROM p",
    "fault_missing_values": f"WITH {PB} SELECT sample_id, CASE WHEN {u(9)} >= 0.25 THEN {q9('score')} END AS score FROM p",
    "label_flip": f"SELECT sample_id, CASE WHEN {u(3)} < 0.1 THEN list_filter({_LAB}, lambda v: v <> y)[CAST(floor({u(3, more=' || ' + repr(':pick'))} * 4) AS INTEGER) + 1] ELSE y END AS y FROM (SELECT o_orderkey AS sample_id, o_orderpriority AS y FROM orders)",
    "label_randomize": f"SELECT sample_id, CASE WHEN {u(3)} < 0.1 THEN {_LAB}[CAST(floor({u(3, more=' || ' + repr(':pick'))} * 5) AS INTEGER) + 1] ELSE y END AS y FROM (SELECT o_orderkey AS sample_id, o_orderpriority AS y FROM orders)",
    "feature_mask": f"WITH {_U} SELECT vec_id, list(CASE WHEN i IN ({', '.join(map(str, _masked()))}) THEN 0.0 ELSE {six('x')} END ORDER BY i) AS v FROM u GROUP BY vec_id",
    "feature_roll": f"WITH {_U} SELECT vec_id, list({six('x')} ORDER BY (i + 3) % 64) AS v FROM u GROUP BY vec_id",
    "image_contrast": f"WITH {_U}, m AS (SELECT vec_id, i, x::DOUBLE AS x, avg(x::DOUBLE) OVER (PARTITION BY vec_id) AS m FROM u) SELECT vec_id, list({six('least(greatest((x - m) * 1.5 + m, 0.0), 1.0)')} ORDER BY i) AS v FROM m GROUP BY vec_id",
    "image_box_blur": f"""WITH {_U}, g AS (SELECT vec_id, i, x::DOUBLE AS x FROM u), o AS (SELECT unnest([-1, 0, 1]) AS dr), c AS (SELECT dr AS dc FROM o), t AS (SELECT i, greatest(0, least(7, i // 8 + dr)) * 8 + greatest(0, least(7, i % 8 + dc)) AS j FROM (SELECT unnest(range(64)) AS i), o, c),
b AS (SELECT g.vec_id, t.i, sum(g.x) / 9 AS x FROM t JOIN g ON g.i = t.j GROUP BY 1, 2) SELECT vec_id, list({six('x')} ORDER BY i) AS v FROM b GROUP BY vec_id""",
    "image_occlusion": f"""WITH {_U}, k AS (SELECT vec_id, floor({u(6, 'vec_id', ' || ' + repr(':r'))} * 6) AS r, floor({u(6, 'vec_id', ' || ' + repr(':c'))} * 6) AS c FROM embeddings)
SELECT vec_id, list(CASE WHEN i // 8 >= r AND i // 8 < r + 3 AND i % 8 >= c AND i % 8 < c + 3 THEN 0.0 ELSE {six('x')} END ORDER BY i) AS v FROM u JOIN k USING (vec_id) GROUP BY vec_id""",
    "random_subset": f"WITH {PB}, r AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('8:' || sample_id), sample_id) AS r, count(*) OVER () AS n FROM p) SELECT sample_id FROM r WHERE r <= floor(0.15 * n + 0.5)",
    "degradation": f"""WITH {_TR}, g AS (SELECT fault, avg(baseline) AS b, avg(accuracy) AS t FROM tq GROUP BY fault)
SELECT fault, {q9('b')} AS baseline, {q9('t')} AS treated, {q9('t - b')} AS delta, {q9('(t - b) / abs(b)')} AS relative, {q9('-(t - b)')} AS deterioration, CASE WHEN t < b THEN 'DETERIORATED' WHEN t > b THEN 'IMPROVED' ELSE 'UNCHANGED' END AS change FROM g""",
    "output_stability": f"""WITH {PB}, x AS (SELECT score, y_pred, {_DROP} AS s2 FROM p), y AS (SELECT *, CASE WHEN s2 >= 0.5 THEN 1 ELSE 0 END AS p2 FROM x)
SELECT count(*) AS n, {q9('count(*) FILTER (y_pred = p2) / count(*)')} AS agreement, {q9('max(abs(score - s2))')} AS max_difference, count(*) = count(*) FILTER (y_pred = p2) AND max(abs(score - s2)) = 0 AS deterministic FROM y""",
    "newly_wrong": f"WITH {PB} SELECT sample_id FROM p WHERE y_true = y_pred AND (CASE WHEN {_DROP} >= 0.5 THEN 1 ELSE 0 END) <> y_true",
    "severity_band": f"WITH {PB} SELECT CASE WHEN score >= 0.9 THEN 4 WHEN score >= 0.75 THEN 3 WHEN score >= 0.5 THEN 2 WHEN score >= 0.25 THEN 1 ELSE 0 END AS band, count(*) AS n FROM p GROUP BY 1",
    "entity_ids": f"SELECT n_nationkey, 'nat_' || substr(sha256({framed("'Nation'", 'n_name', 'n_regionkey')}), 1, 32) AS id FROM nation",
    "dataset_fingerprint": f"WITH h AS (SELECT md5({framed('c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment')}) AS h FROM customer), s AS (SELECT count(*) AS rows, "
    + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {k}, 8) AS BIGINT)) AS VARCHAR) AS s{k}" for k in (1, 9, 17, 25))
    + " FROM h) SELECT rows, md5(s1 || '|' || s9 || '|' || s17 || '|' || s25) AS fingerprint FROM s",
}
