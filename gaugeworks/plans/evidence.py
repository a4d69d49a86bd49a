"""Failure, interaction, graph and record queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..operators import failures as X
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import records as R
from ..status import q9 as Q9
from .evaluation import PB, PM, q9
from .inference import CELLS

T = frames.table


def by_nation(s, d):
    """Predictions of order priority by the customer's nation as run."""
    c = T(s, d, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("run"))
    return frames.pred_multi(s, d).join(c, "cust")


def signals(s, d):
    x = X.confusion_signals(by_nation(s, d), "run", 0.1)
    band = F.when(F.col("magnitude") >= 0.2, 2).when(F.col("magnitude") >= 0.12, 1).otherwise(0)
    key = F.concat_ws("|", F.lpad(F.col("run").cast("string"), 2, "0"), "class_label", "predicted_label")
    return x.withColumn("band", band).withColumn("signal", key).withColumn("signature", X.signature(F.col("kind"), F.col("class_label"), F.col("predicted_label"), band))


def pairs(s, d, threshold=0.8):
    return X.similar_pairs(signals(s, d), "signal", ["class_label", "predicted_label"], [X.Feature("kind", 1.0), X.Feature("band", 2.0), X.Feature("magnitude", 3.0, "number")], threshold)


def node(s, name):
    return s.createDataFrame([(name,)], "node string")


def home_region(s, d, customer):
    c = T(s, d, "customer").filter(F.col("c_custkey") == customer).join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return "region:" + str(c.select("n_regionkey").first()[0])


E = frames.edges
QUERIES = {
    "confusion_signals": lambda s, d: X.confusion_signals(by_nation(s, d), "run", 0.1),
    "recall_signals": lambda s, d: X.recall_signals(by_nation(s, d), "run"),
    "signal_signatures": lambda s, d: signals(s, d).groupBy("signature").agg(F.count("*").alias("n"), F.min("run").alias("first_run")),
    "similar_signals": lambda s, d: pairs(s, d),
    "signal_clusters": lambda s, d: X.clusters(signals(s, d), pairs(s, d, 0.95), "signal"),
    "cluster_stability": lambda s, d: X.cluster_stability(signals(s, d), pairs(s, d, 0.93), "signal", 0.95, 0.02),
    "cluster_measures": lambda s, d: X.cluster_measures(signals(s, d), ["signature"], "run", "magnitude", "samples", 25),
    "mode_cooccurrence": lambda s, d: X.cooccurrence(signals(s, d), "signature", "run"),
    "strongest_signal": lambda s, d: X.strongest(signals(s, d), "run", "magnitude", "signal"),
    "interaction_contrast": lambda s, d: X.contrast(frames.trials(s, d), "discount"),
    "trial_contrasts": lambda s, d: X.trial_contrasts(frames.trials(s, d), "discount"),
    "graph_neighbours": lambda s, d: G.neighbours(E(s, d), "nation:3", "OUT", ["has_customer"]),
    "graph_ancestors": lambda s, d: G.reach(E(s, d), node(s, "order:5"), "IN"),
    "graph_descendants": lambda s, d: G.reach(E(s, d), node(s, "region:1"), "OUT", 3),
    "graph_shortest_path": lambda s, d: G.shortest_path(E(s, d).filter("relation != 'placed'"), "customer:5", home_region(s, d, 5)),
    "graph_degrees": lambda s, d: G.degrees(E(s, d)),
    "graph_components": lambda s, d: G.components(E(s, d)).groupBy("component").agg(F.count("*").alias("nodes")),
    "graph_difference": lambda s, d: G.difference(E(s, d).filter("dst != 'nation:4'"), E(s, d).filter("dst not like 'supplier:1%'")),
    "graph_unresolved": lambda s, d: G.unresolved(E(s, d), T(s, d, "customer").filter("c_custkey % 10 != 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))),
    "blocked_units": lambda s, d: G.blocked(E(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), node(s, "nation:7")),
    "metric_outer_join": lambda s, d: R.outer_deltas(M.accuracy(frames.pred_bin(s, d).filter("sample_id % 2 = 0"), ["source"]).filter("source != 'src3'"), M.accuracy(frames.pred_bin(s, d).filter("sample_id % 2 = 1"), ["source"]), "source", "accuracy"),
    "latest_order": lambda s, d: R.latest(T(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey"),
    "attempt_numbers": lambda s, d: R.attempts(T(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]),
    "pagination": lambda s, d: R.page(T(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 40, 25),
    "bounded_examples": lambda s, d: R.examples(frames.pred_bin(s, d).filter("y_true != y_pred"), "lang", "sample_id", 3),
    "coverage": lambda s, d: R.coverage(T(s, d, "nation").select(F.col("n_nationkey").alias("unit")), T(s, d, "supplier").groupBy(F.col("s_nationkey").alias("unit")).agg(F.when(F.min("s_acctbal") < -500, "FAILED").otherwise("COMPLETED").alias("status")), ["unit"]),
    "factorial_plan": lambda s, d: R.factorial(T(s, d, "region").select("r_name"), s.createDataFrame([("A",), ("B",), ("AB",)], "cell string"), s.createDataFrame([(1,), (2,)], "seed int")),
    "jaccard": lambda s, d: R.jaccard(T(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), T(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k")), "k"),
    "document_comparison": lambda s, d: R.compare_documents(T(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), T(s, d, "part").filter("p_partkey % 11 != 0").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") * F.when(F.col("p_partkey") % 5 == 0, 1.01).when(F.col("p_partkey") % 7 == 0, 1.0000001).otherwise(1.0)).alias("v")), "k", "v"),
    "as_of_join": lambda s, d: R.as_of(T(s, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), T(s, d, "events").filter("event_type != 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", Q9("as_of").alias("as_of")),
    "ordinary_counters": lambda s, d: T(s, d, "orders").groupingSets([("o_orderstatus",), ("o_orderpriority",), ()], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")),
    "pointer_projection": lambda s, d: T(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
}
QUERIES["set_difference"] = lambda s, d: R.set_difference(T(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), T(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k")), "k")

_BN = f"{PM}, bn AS (SELECT p.*, c_nationkey AS run FROM p JOIN customer ON c_custkey = cust)"
_CS = f"""{_BN}, cc AS (SELECT run, y_true, y_pred, count(*) AS samples FROM bn GROUP BY ALL), cm AS (SELECT *, samples / sum(samples) OVER (PARTITION BY run, y_true) AS m FROM cc),
cs AS (SELECT run, 'CONFUSION_PAIR' AS kind, y_true AS class_label, y_pred AS predicted_label, {q9('m')} AS magnitude, samples FROM cm WHERE y_true <> y_pred AND m >= 0.1),
sg AS (SELECT *, CASE WHEN magnitude >= 0.2 THEN 2 WHEN magnitude >= 0.12 THEN 1 ELSE 0 END AS band, lpad(CAST(run AS VARCHAR), 2, '0') || '|' || class_label || '|' || predicted_label AS signal FROM cs),
ss AS (SELECT *, kind || '|class=' || class_label || '|pred=' || predicted_label || '|sev=' || band AS signature FROM sg)"""
_PAIR = f"""{_CS}, rp AS (SELECT *, min(signal) OVER (PARTITION BY class_label, predicted_label, kind, band, magnitude) AS rep FROM ss),
pp AS (SELECT l.signal AS a, r.signal AS b, {q9('(1 + CASE WHEN l.band = r.band THEN 2 ELSE 0 END + 3 * (1 - abs(l.magnitude - r.magnitude) / greatest(l.magnitude, r.magnitude))) / 6')} AS similarity FROM rp l JOIN rp r ON l.class_label = r.class_label AND l.predicted_label = r.predicted_label AND l.signal < r.signal WHERE l.rep = l.signal AND r.rep = r.signal
UNION ALL SELECT rep, signal, 1.0::DOUBLE FROM rp WHERE rep <> signal)"""


def _reach(name: str, at: float) -> str:
    """CTE name(signal, c): least signal that links of this similarity reach."""
    return f"{name}l AS (SELECT a, b FROM pp WHERE similarity >= {at} - 1e-12 UNION ALL SELECT b, a FROM pp WHERE similarity >= {at} - 1e-12), {name}r AS (SELECT signal, signal AS o FROM ss UNION SELECT r.signal, l.b FROM {name}r r JOIN {name}l l ON l.a = r.o), {name} AS (SELECT signal, min(o) AS c FROM {name}r GROUP BY signal)"


_G = """ed AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'has_nation' AS relation FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'has_customer' FROM customer
UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'has_supplier' FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'placed' FROM orders)"""
_WIDE = f"{CELLS}, w AS (SELECT trial_key, max(discount) FILTER (cell = 'CONTROL') AS y0, max(discount) FILTER (cell = 'A') AS ya, max(discount) FILTER (cell = 'B') AS yb, max(discount) FILTER (cell = 'AB') AS yab FROM trials GROUP BY 1)"
_SETS = "a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT coalesce(a.k, b.k) AS value, CASE WHEN b.k IS NULL THEN 'only_in_a' WHEN a.k IS NULL THEN 'only_in_b' ELSE 'both' END AS found FROM a FULL JOIN b ON a.k = b.k)"
_ACC = "avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)"
SQL = {
    "confusion_signals": f"WITH {_CS} SELECT * FROM cs",
    "recall_signals": f"WITH {_BN}, a AS (SELECT run, y_true, count(*) AS n, count(*) FILTER (y_true = y_pred) AS k FROM bn GROUP BY ALL) SELECT run, 'PER_CLASS_RECALL_LOW' AS kind, y_true AS class_label, {q9('1 - k / n')} AS magnitude, n - k AS samples FROM a WHERE k / n < 0.8",
    "signal_signatures": f"WITH {_CS} SELECT signature, count(*) AS n, min(run) AS first_run FROM ss GROUP BY signature",
    "similar_signals": f"WITH {_PAIR} SELECT a, b, similarity, TRUE AS exact FROM pp WHERE similarity >= 0.8",
    "signal_clusters": f"WITH RECURSIVE {_PAIR}, {_reach('mid', 0.95)} SELECT signal, c AS cluster FROM mid",
    "cluster_stability": f"""WITH RECURSIVE {_PAIR}, {_reach('hi', 0.97)}, {_reach('mid', 0.95)}, {_reach('lo', 0.93)}, j AS (SELECT mid.c AS cluster, hi.c AS ch, lo.c AS cl FROM mid JOIN hi USING (signal) JOIN lo USING (signal)),
i AS (SELECT cluster, max(n) AS inn FROM (SELECT cluster, ch, count(*) AS n FROM j GROUP BY 1, 2) GROUP BY 1), o AS (SELECT cl, count(*) AS out FROM j GROUP BY 1), z AS (SELECT cluster, any_value(cl) AS cl, count(*) AS size FROM j GROUP BY 1)
SELECT cluster, size, {q9('inn / size')} AS finer, {q9('size / out')} AS coarser, {q9('least(inn / size, size / out)')} AS stability FROM z JOIN i USING (cluster) JOIN o USING (cl)""",
    "cluster_measures": f"WITH {_CS} SELECT signature, count(*) AS signals, count(DISTINCT run) AS runs, {q9('count(DISTINCT run) / 25.0')} AS prevalence, {q9('avg(magnitude)')} AS mean_magnitude, {q9('max(magnitude)')} AS worst, CAST(sum(samples) AS BIGINT) AS samples FROM ss GROUP BY signature",
    "mode_cooccurrence": f"""WITH {_CS}, m AS (SELECT DISTINCT signature AS m, run AS r FROM ss), z AS (SELECT m, count(*) AS n FROM m GROUP BY m), j AS (SELECT x.m AS a, y.m AS b, count(*) AS shared FROM m x JOIN m y ON x.r = y.r AND x.m < y.m GROUP BY ALL)
SELECT a, b, shared AS "both", za.n + zb.n - shared AS either, {q9('shared / (za.n + zb.n - shared)')} AS jaccard FROM j JOIN z za ON za.m = a JOIN z zb ON zb.m = b""",
    "strongest_signal": f"WITH {_CS}, r AS (SELECT run, signal, magnitude, row_number() OVER (PARTITION BY run ORDER BY magnitude DESC, signal DESC) AS r FROM ss) SELECT run, signal, magnitude FROM r WHERE r = 1",
    "interaction_contrast": f"""WITH {_WIDE}, g AS (SELECT count(*) FILTER (y0 + ya + yb + yab IS NOT NULL) AS n, count(*) FILTER (y0 + ya + yb + yab IS NULL) AS dropped, avg(y0) FILTER (y0 + ya + yb + yab IS NOT NULL) AS y0, avg(ya) FILTER (y0 + ya + yb + yab IS NOT NULL) AS ya,
avg(yb) FILTER (y0 + ya + yb + yab IS NOT NULL) AS yb, avg(yab) FILTER (y0 + ya + yb + yab IS NOT NULL) AS yab FROM w)
SELECT n, dropped, {q9('y0')} AS control, {q9('ya')} AS a, {q9('yb')} AS b, {q9('yab')} AS ab, {q9('ya - y0')} AS effect_a, {q9('yb - y0')} AS effect_b, {q9('yab - ya - yb + y0')} AS contrast, {q9('(yab - ya - yb + y0) / abs(y0)')} AS relative, 'DERIVED' AS status FROM g""",
    "trial_contrasts": f"WITH {_WIDE} SELECT trial_key, {q9('yab - ya - yb + y0')} AS contrast FROM w WHERE yab - ya - yb + y0 IS NOT NULL",
    "graph_neighbours": f"WITH {_G} SELECT DISTINCT dst AS node FROM ed WHERE src = 'nation:3' AND relation = 'has_customer'",
    "graph_ancestors": f"WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 'order:5', 0 UNION SELECT src, depth + 1 FROM r JOIN ed ON dst = node WHERE depth < 12) SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "graph_descendants": f"WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 'region:1', 0 UNION SELECT dst, depth + 1 FROM r JOIN ed ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "graph_shortest_path": "WITH c AS (SELECT c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 5) SELECT CAST(0 AS INTEGER) AS step, 'customer:5' AS node FROM c UNION ALL SELECT 1, 'nation:' || n FROM c UNION ALL SELECT 2, 'region:' || r FROM c",
    "graph_degrees": f"WITH {_G}, u AS (SELECT src AS node, 1 AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, 1 FROM ed) SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM u GROUP BY node",
    "graph_components": f"""WITH {_G}, n AS (SELECT 'nation:' || n_nationkey AS node, n_regionkey AS k FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_regionkey FROM region UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'order:' || o_orderkey, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
g AS (SELECT k, min(node) AS component, count(*) AS nodes FROM n GROUP BY k) SELECT component, nodes FROM g""",
    "graph_difference": f"WITH {_G} SELECT *, 'added' AS change FROM ed WHERE dst = 'nation:4' UNION ALL SELECT *, 'removed' FROM ed WHERE dst LIKE 'supplier:1%'",
    "graph_unresolved": f"WITH {_G}, n AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed) SELECT node FROM n WHERE node NOT IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 10 <> 0)",
    "blocked_units": f"WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 'nation:7', 0 UNION SELECT dst, depth + 1 FROM r JOIN ed ON src = node WHERE depth < 12) SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node",
    "metric_outer_join": f"""WITH {PB}, a AS (SELECT source, {q9(_ACC)} AS base FROM p WHERE sample_id % 2 = 0 AND source <> 'src3' GROUP BY source), b AS (SELECT source, {q9(_ACC)} AS treated FROM p WHERE sample_id % 2 = 1 GROUP BY source)
SELECT source, {q9('base')} AS base, {q9('treated')} AS treated, {q9('treated - base')} AS delta, {q9('(treated - base) / abs(base)')} AS relative, CASE WHEN treated IS NULL THEN 'only_base' WHEN base IS NULL THEN 'only_treated' ELSE 'both' END AS side FROM a FULL JOIN b USING (source)""",
    "latest_order": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "attempt_numbers": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS attempt FROM orders",
    "pagination": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 40",
    "bounded_examples": f"WITH {PB}, r AS (SELECT lang, sample_id, row_number() OVER (PARTITION BY lang ORDER BY sample_id) AS r FROM p WHERE y_true <> y_pred) SELECT lang, count(*) AS n, string_agg(sample_id, ',' ORDER BY sample_id) FILTER (r <= 3) AS examples FROM r GROUP BY lang",
    "coverage": "WITH s AS (SELECT s_nationkey AS unit, CASE WHEN min(s_acctbal) < -500 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM supplier GROUP BY 1) SELECT coalesce(status, 'NOT_RUN') AS status, count(*) AS n FROM nation LEFT JOIN s ON unit = n_nationkey GROUP BY 1",
    "factorial_plan": "SELECT r_name, cell, CAST(seed AS INTEGER) AS seed FROM region, (SELECT unnest(['A', 'B', 'AB']) AS cell), (SELECT unnest([1, 2]) AS seed)",
    "set_difference": f"WITH {_SETS} SELECT * FROM f",
    "jaccard": f"WITH {_SETS} SELECT count(*) FILTER (found = 'both') AS both, count(*) AS either, {q9('count(*) FILTER (found = ' + repr('both') + ') / count(*)')} AS jaccard FROM f",
    "document_comparison": """WITH b AS (SELECT p_partkey AS k, p_retailprice * CASE WHEN p_partkey % 5 = 0 THEN 1.01::DOUBLE WHEN p_partkey % 7 = 0 THEN 1.0000001::DOUBLE ELSE 1.0::DOUBLE END AS y FROM part WHERE p_partkey % 11 <> 0)
SELECT CASE WHEN y IS NULL THEN 'INCOMPARABLE' WHEN p_retailprice = y THEN 'EQUAL' WHEN abs(p_retailprice - y) <= greatest(1e-6 * greatest(abs(p_retailprice), abs(y)), 1e-9) THEN 'APPROX' ELSE 'DIFFERENT' END AS outcome, count(*) AS n FROM part LEFT JOIN b ON k = p_partkey GROUP BY 1""",
    "as_of_join": f"""WITH u AS (SELECT event_id, user_id, ts, 1 AS side, NULL AS v FROM events WHERE event_type = 'purchase' UNION ALL SELECT NULL, user_id, ts, 0, value FROM events WHERE event_type <> 'purchase'),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, side ROWS UNBOUNDED PRECEDING) AS a FROM u) SELECT event_id, {q9('a')} AS as_of FROM w WHERE side = 1""",
    "ordinary_counters": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "pointer_projection": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
