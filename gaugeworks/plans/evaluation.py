"""Evaluation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..operators import metrics as M

PB = """pb AS (SELECT l.doc_id AS sample_id, l.quality AS y_true, CAST(d.n_chars AS DOUBLE) / (d.n_chars + 500) AS score, d.lang, d.source
  FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred, greatest(score, 1 - score) AS confidence FROM pb)"""
_W = ", ".join(
    f"CAST(CAST('0x' || substr(md5('{k}:' || o_orderkey), 1, 4) AS INTEGER) AS BIGINT) + CASE WHEN o_orderpriority = '{c}' THEN 30000 ELSE 0 END AS w{k}"
    for k, c in enumerate(frames.PRIORITIES)
)
_MAX = "greatest(w0, w1, w2, w3, w4)"
PM = f"""w AS (SELECT o_orderkey AS sample_id, o_custkey AS cust, o_orderpriority AS y_true, {_W} FROM orders),
p AS (SELECT sample_id, cust, y_true, CASE {" ".join(f"WHEN w{k} = {_MAX} THEN '{c}'" for k, c in enumerate(frames.PRIORITIES))} END AS y_pred,
  [{", ".join(f"CAST(w{k} AS DOUBLE) / (w0 + w1 + w2 + w3 + w4)" for k in range(5))}] AS scores FROM w)"""
PR = """p AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sample_id, l_extendedprice AS y_true,
  l_quantity * p_retailprice AS y_pred FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def q9(x: str) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 1e9 + 0.5) / 1e9"


def q4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


B = frames.pred_bin


def pos():
    return F.col("y_true") == 1


QUERIES = {
    "accuracy": lambda s, d: M.accuracy(B(s, d)),
    "accuracy_by_lang": lambda s, d: M.accuracy(B(s, d), ["lang"]),
    "confusion_matrix": lambda s, d: M.confusion(frames.pred_multi(s, d)),
    "per_class_metrics": lambda s, d: M.per_class(frames.pred_multi(s, d)),
    "macro_metrics": lambda s, d: M.macro(frames.pred_multi(s, d)),
    "roc_auc": lambda s, d: M.roc_auc(B(s, d), "score", pos()),
    "average_precision": lambda s, d: M.average_precision(B(s, d), "score", pos()),
    "precision_recall_curve": lambda s, d: M.precision_recall_curve(B(s, d), "score", pos()),
    "log_loss": lambda s, d: M.log_loss(B(s, d), F.when(pos(), F.col("score")).otherwise(1 - F.col("score"))),
    "regression_metrics": lambda s, d: M.regression(frames.pred_reg(s, d)),
    "classification_errors": lambda s, d: M.classification_errors(B(s, d)),
    "regression_errors": lambda s, d: M.regression_errors(frames.pred_reg(s, d)),
    "top_residuals": lambda s, d: M.top_residuals(frames.pred_reg(s, d)),
    "class_balance": lambda s, d: M.class_balance(frames.pred_multi(s, d)),
    "confidence_histogram": lambda s, d: M.confidence_histogram(B(s, d)),
    "calibration_errors": lambda s, d: M.calibration_errors(B(s, d)),
    "latency_summary": lambda s, d: M.latency(frames.table(s, d, "events"), "value"),
    "slice_metrics": lambda s, d: M.metric_status(B(s, d), "lang"),
}

_CNT = "c AS (SELECT score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true <> 1) AS neg FROM p GROUP BY score)"
_PC = """k AS (SELECT label, CAST(sum(t) AS BIGINT) AS support, CAST(sum(pr) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS tp FROM (
  SELECT y_true AS label, 1 AS t, 0 AS pr, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS h FROM p UNION ALL SELECT y_pred, 0, 1, 0 FROM p) GROUP BY label),
pc AS (SELECT label, support, predicted, tp, """ + f"""{q9('tp / nullif(predicted, 0)')} AS precision, {q9('tp / nullif(support, 0)')} AS recall,
  {q9('2 * tp / nullif(support + predicted, 0)')} AS f1 FROM k)"""

SQL = {
    "accuracy": f"WITH {PB} SELECT count(*) AS n, count(*) FILTER (y_true = y_pred) AS correct, {q9('count(*) FILTER (y_true = y_pred) / count(*)')} AS accuracy FROM p",
    "accuracy_by_lang": f"WITH {PB} SELECT lang, count(*) AS n, count(*) FILTER (y_true = y_pred) AS correct, {q9('count(*) FILTER (y_true = y_pred) / count(*)')} AS accuracy FROM p GROUP BY lang",
    "confusion_matrix": f"WITH {PM}, c AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY ALL) SELECT y_true, y_pred, n, {q9('n / sum(n) OVER (PARTITION BY y_true)')} AS row_share, {q9('n / sum(n) OVER (PARTITION BY y_pred)')} AS column_share FROM c",
    "per_class_metrics": f"WITH {PM}, {_PC} SELECT * FROM pc",
    "macro_metrics": f"""WITH {PM}, {_PC}, a AS (SELECT count(*) AS n, avg(coalesce(precision, 0)) AS p1, avg(coalesce(recall, 0)) AS r1, avg(coalesce(f1, 0)) AS f, avg(recall) FILTER (support > 0) AS b FROM pc)
SELECT 'precision_macro' AS measure, {q9('p1')} AS value, n, 'COMPUTED' AS status FROM a UNION ALL SELECT 'recall_macro', {q9('r1')}, n, 'COMPUTED' FROM a
UNION ALL SELECT 'f1_macro', {q9('f')}, n, 'COMPUTED' FROM a UNION ALL SELECT 'balanced_accuracy', {q9('b')}, n, 'COMPUTED' FROM a""",
    "roc_auc": f"""WITH {PB}, {_CNT}, r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, {q9('sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0)')} AS auc FROM r""",
    "average_precision": f"""WITH {PB}, {_CNT}, r AS (SELECT pos, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS seen FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, {q9('sum(pos * tp / seen) / nullif(sum(pos), 0)')} AS ap FROM r""",
    "precision_recall_curve": f"""WITH {PB}, {_CNT}, r AS (SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER () AS total FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT {q9('score')} AS score, tp, fp, {q9('tp / (tp + fp)')} AS precision, {q9('tp / total')} AS recall FROM r""",
    "log_loss": f"WITH {PB} SELECT count(*) AS n, {q9('avg(-ln(greatest(least(CASE WHEN y_true = 1 THEN score ELSE 1 - score END, 1.0), 1e-15)))')} AS log_loss, 'COMPUTED' AS status FROM p",
    "regression_metrics": f"""WITH {PR}, a AS (SELECT count(*) AS n, avg(abs(y_pred - y_true)) AS mae, avg((y_pred - y_true) * (y_pred - y_true)) AS mse, quantile_cont(abs(y_pred - y_true), 0.5) AS medae, var_pop(y_true) AS v FROM p)
SELECT m AS measure, {q4('x')} AS value, n, 'COMPUTED' AS status FROM (SELECT n, unnest(['mae', 'mse', 'rmse', 'r2', 'median_absolute_error']) AS m, unnest([mae, mse, sqrt(mse), 1 - mse / v, medae]) AS x FROM a)""",
    "classification_errors": f"""WITH {PB} SELECT kind, count(*) AS n FROM (
SELECT 'FALSE_POSITIVE' AS kind FROM p WHERE y_true = 0 AND y_pred = 1 UNION ALL SELECT 'FALSE_NEGATIVE' FROM p WHERE y_true = 1 AND y_pred = 0
UNION ALL SELECT 'HIGH_CONFIDENCE_INCORRECT' FROM p WHERE y_true <> y_pred AND confidence >= 0.9 UNION ALL SELECT 'LOW_CONFIDENCE_CORRECT' FROM p WHERE y_true = y_pred AND confidence < 0.6) GROUP BY kind""",
    "regression_errors": f"WITH {PR} SELECT count(*) AS n, {q4('avg(y_pred - y_true)')} AS mean_signed, {q4('avg(abs(y_pred - y_true))')} AS mean_absolute, {q4('max(abs(y_pred - y_true))')} AS max_absolute, {q4('stddev_pop(y_pred - y_true)')} AS residual_std, {q4('stddev_pop(y_true)')} AS target_std FROM p",
    "top_residuals": f"WITH {PR} SELECT sample_id, {q4('y_pred - y_true')} AS residual FROM p ORDER BY abs(y_pred - y_true) DESC, sample_id LIMIT 10",
    "class_balance": f"""WITH {PM}, c AS (SELECT y_true AS label, count(*) AS n FROM p GROUP BY y_true)
SELECT label, n, {q9('n / sum(n) OVER ()')} AS share, row_number() OVER (ORDER BY n DESC, label) = 1 AS is_majority, row_number() OVER (ORDER BY n, label) = 1 AS is_minority FROM c""",
    "confidence_histogram": f"""WITH {PB} SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (y_true = y_pred) AS correct,
{q9('avg(confidence) FILTER (y_true = y_pred)')} AS mean_confidence_correct, {q9('avg(confidence) FILTER (y_true <> y_pred)')} AS mean_confidence_incorrect FROM p GROUP BY 1""",
    "calibration_errors": f"""WITH {PB}, b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, abs(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) - avg(confidence)) AS gap,
sum(power(confidence - CASE WHEN y_true = y_pred THEN 1 ELSE 0 END, 2)) AS sq FROM p GROUP BY 1), a AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * gap) / sum(n) AS ece, max(gap) AS mce, sum(sq) / sum(n) AS brier FROM b)
SELECT 'ece' AS measure, {q9('ece')} AS value, n, 'COMPUTED' AS status FROM a UNION ALL SELECT 'mce', {q9('mce')}, n, 'COMPUTED' FROM a UNION ALL SELECT 'brier', {q9('brier')}, n, 'COMPUTED' FROM a""",
    "latency_summary": """WITH a AS (SELECT count(value) AS n, sum(value) AS total, quantile_cont(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS mx FROM events)
SELECT n, floor(total * 1e6 + 0.5) / 1e6 AS total, floor(total / n * 1e6 + 0.5) / 1e6 AS mean, floor(median * 1e6 + 0.5) / 1e6 AS median, floor(p95 * 1e6 + 0.5) / 1e6 AS p95, floor(mx * 1e6 + 0.5) / 1e6 AS max, floor(n / total * 1e6 + 0.5) / 1e6 AS throughput FROM a""",
    "slice_metrics": f"""WITH {PB}, a AS (SELECT coalesce(lang, '(all)') AS slice, count(*) AS n, count(*) FILTER (y_true = y_pred) AS r, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM p GROUP BY GROUPING SETS ((lang), ())),
m AS (SELECT slice, 'accuracy' AS measure, {q9('r / nullif(n, 0)')} AS value, n FROM a UNION ALL SELECT slice, 'recall_1', {q9('tp / nullif(pos, 0)')}, pos FROM a)
SELECT *, CASE WHEN value IS NULL THEN 'UNDEFINED' WHEN n < 5 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'COMPUTED' END AS status FROM m""",
}
