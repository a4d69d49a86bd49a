"""Queries on reports over finished measures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..functions import identity as I
from ..functions import rng
from ..operators import failures as X
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import slices as L
from ..sources import records
from ..status import q9 as Q9
from .evaluation import PB, PM, q9
from .evidence import _CS, _G, _WIDE, node, signals
from .shift import _wilson
from .slicing import _SL, REAL
from .stress import u

T = frames.table
P = frames.pred_bin
FEATURES = ("balance", "segment", "phone")


def right(df):
    return df.withColumn("right", (F.col("y_true") == F.col("y_pred")).cast("double"))


def logits(s, d):
    return frames.pred_multi(s, d).select("sample_id", R.softmax(F.transform("scores", lambda x: x * 10)).alias("p"))


def stamped(s, d):
    """Event times written in several ways."""
    t, i = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 7
    text = F.when(i == 0, F.concat(t, F.lit("Z"))).when(i == 1, F.concat(t, F.lit("+00:00"))).when(i == 2, F.concat(t, F.lit("+02:00"))).when(i == 3, t).when(i == 4, "yesterday").when(i == 5, F.regexp_replace(t, r"^(\d{4})-01-", "$1-13-"))
    return T(s, d, "events").select(text.alias("at"))


def configurations(s, d):
    """Each customer's settings, and a changed copy of them."""
    c, k = T(s, d, "customer"), F.col("c_custkey")
    a = c.select("c_custkey", F.create_map(F.lit("/name"), "c_name", F.lit("/place/nation"), F.col("c_nationkey").cast("string"), F.lit("/segment"), "c_mktsegment").alias("document"))
    new = F.map_filter(
        F.create_map(
            F.lit("/name"), "c_name", F.lit("/place/nation"), F.when(k % 5 == 0, "none").otherwise(F.col("c_nationkey").cast("string")),
            F.lit("/segment"), F.when(k % 7 != 0, F.col("c_mktsegment")), F.lit("/tier"), F.when(k % 3 == 0, "gold"),
        ), lambda _, v: v.isNotNull(),
    )
    return a, c.select("c_custkey", new.alias("document"))


def in_slices(s, d):
    return L.in_slices(right(P(s, d)), REAL)


def customers(s, d):
    c, k = T(s, d, "customer"), F.col("c_custkey")
    return c.select(
        "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(k % 11 != 0, F.col("c_mktsegment")).alias("segment"), F.when((k % 13 != 0) | (F.col("c_mktsegment") != "BUILDING"), F.col("c_name")).alias("phone"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_nationkey") + 3).otherwise(F.col("c_nationkey")).alias("place"),
    )


def accuracy_of(s, d, part):
    a = M.accuracy(P(s, d).filter(F.col("sample_id") % 2 == part), ["source"])
    return a.select("source", F.col("accuracy").alias("value"), F.when(F.col("n") >= 5, "COMPUTED").otherwise("INSUFFICIENT_EVIDENCE").alias("status")).filter(F.col("source") != f"src{part}")


def sources(s, d):
    return M.accuracy(P(s, d), ["source"]).select("source", "accuracy", "n")


def priced(s, d):
    """The weak predictor of line prices, with the lines' return flags as slices."""
    lines, part = T(s, d, "lineitem"), T(s, d, "part")
    j = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_returnflag", F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * F.col("p_retailprice") * F.when(F.col("l_returnflag") == "R", 1.3).otherwise(1.0)).alias("y_pred"))


def findings(s, d):
    """All rules over a classifier by language, a regressor by return flag and events as batches, with thresholds that some of these measures meet."""
    m = R.classification_measures(P(s, d), "lang").unionByName(R.regression_measures(priced(s, d), "l_returnflag")).unionByName(R.latency_measures(T(s, d, "events"), "value"))
    return R.findings(m, R.with_thresholds(R.RULES, imbalance_ratio=1.2, minority_recall=0.7, high_confidence_error_rate=0.02, accuracy_drop=0.01, f1_drop=0.01, r2=0.99, mae_increase=0.05, rmse_increase=0.05))


def known_nodes(s, d):
    """Nodes that have a row, but for some suppliers."""
    name = lambda t, k, p: T(s, d, t).select(F.concat(F.lit(f"{p}:"), F.col(k).cast("string")).alias("node"))
    parts = [name("region", "r_regionkey", "region"), name("nation", "n_nationkey", "nation"), name("customer", "c_custkey", "customer"), name("orders", "o_orderkey", "order")]
    out = name("supplier", "s_suppkey", "supplier").filter("node not like '%7'")
    for p in parts:
        out = out.unionByName(p)
    return out


def graph_nodes(s, d):
    """Every node that edges name, with its kind; those without a row are made up and say so."""
    known = known_nodes(s, d).withColumn("known", F.lit(True))
    e = frames.edges(s, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(known, "node", "left")
    return ends.select(F.split("node", ":")[0].alias("kind"), F.coalesce("known", F.lit(False)).alias("known")).groupBy("kind", "known").agg(F.count("*").alias("nodes"))


def reached_kinds(s, d):
    """What a region leads to, by kind and distance."""
    r = G.reach(frames.edges(s, d), node(s, "region:2"), "OUT", 3)
    return r.groupBy("depth", F.split("node", ":")[0].alias("kind")).agg(F.count("*").alias("nodes"), F.min("node").alias("first"))


def lineage(s, d):
    """Each signal's run with the nation and region behind it."""
    n, r = T(s, d, "nation"), T(s, d, "region")
    j = signals(s, d).select("signal", "run").join(n, F.col("run") == F.col("n_nationkey"), "left").join(r.filter("r_regionkey != 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("signal", "n_name", "r_name", F.when(F.col("n_name").isNull(), "RUN_MISSING").when(F.col("r_name").isNull(), "REGION_MISSING").otherwise("LINKED").alias("link"))


def scopes(s, d):
    p, out = P(s, d), None
    for name, args in (("all", {"kind": "ALL"}), ("share", {"kind": "RANDOM_SUBSET", "fraction": 0.25, "seed": 3}), ("class", {"kind": "CLASS", "label": 1})):
        x = R.scope_mask(p, "sample_id", **args).select(F.lit(name).alias("scope"), "sample_id", "affected", F.when(F.col("affected"), F.col("score") * 0.5).otherwise(F.col("score")).alias("v"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("scope").agg(F.count("*").alias("n"), F.count_if("affected").alias("affected"), Q9(F.avg("v")).alias("mean_score"))


def parameters(s, d):
    """Retail prices as a model's parameters: scaled, and with noise of a twentieth of each array's root mean square."""
    p = T(s, d, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("double").alias("w"))
    rms = p.groupBy("p_brand").agg(F.sqrt(F.avg(F.col("w") * F.col("w"))).alias("rms"))
    rows = p.join(F.broadcast(rms), "p_brand")  # a row an array
    noise = rng.uniform(21, F.col("p_partkey")) * 2 - 1
    scaled = R.perturbed(rows, "p_brand", F.col("w"), F.col("w") * 0.9).withColumn("family", F.lit("PARAMETER_SCALE"))
    return scaled.unionByName(R.perturbed(rows, "p_brand", F.col("w"), F.col("w") + 0.05 * F.col("rms") * noise).withColumn("family", F.lit("PARAMETER_NOISE"))).select(
        "family", "array", "n", (F.floor(F.col("max_abs_change") * 1e6 + 0.5) / F.lit(1e6)).alias("max_abs_change"), (F.floor(F.col("relative_l2_change") * 1e6 + 0.5) / F.lit(1e6)).alias("relative_l2_change")
    )


def measured(s, d):
    return X.cluster_measures(signals(s, d), ["signature"], "run", "magnitude", "samples", 25)


def logged(s, d):
    """Predictions as JSON lines, written and read again with a strict schema."""
    return records.read_json_lines(s, records.write_json_lines(P(s, d).select("sample_id", "y_true", "y_pred", "lang")), "sample_id long, y_true int, y_pred int, lang string")


def manifest(s, d):
    """Every table's files, with their sizes and hashes."""
    return records.manifest(s, d)


def candidates(s, d):
    p = P(s, d)
    wrong = R.top_by(p.filter("y_true != y_pred"), ["lang"], [F.desc("confidence"), F.asc("sample_id")], 3).withColumn("kind", F.lit("CONFIDENT_ERROR"))
    unsure = R.top_by(p.filter("y_true = y_pred"), ["lang"], [F.asc("confidence"), F.asc("sample_id")], 3).withColumn("kind", F.lit("UNCONFIDENT_SUCCESS"))
    return wrong.unionByName(unsure).select("kind", "lang", "rank", "sample_id", Q9("confidence").alias("confidence"))


QUERIES = {
    "one_against_rest": lambda s, d: R.one_against_rest(frames.pred_multi(s, d), frames.PRIORITIES),
    "one_against_rest_macro": lambda s, d: R.macro_one_against_rest(frames.pred_multi(s, d), frames.PRIORITIES),
    "confidence_auroc": lambda s, d: M.roc_auc(P(s, d), "confidence", F.col("y_true") == F.col("y_pred")),
    "softmax": lambda s, d: logits(s, d).select("sample_id", Q9(F.array_max("p")).alias("top"), Q9(F.array_min("p")).alias("least"), Q9(F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).alias("total")),
    "cell_keys": lambda s, d: T(s, d, "lineitem").select(F.explode(F.array(F.col("l_quantity").cast("double"), F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_discount").cast("double")))).alias("v")).groupBy(R.cell_key(F.col("v")).alias("key")).agg(F.count("*").alias("n")),
    "timestamp_states": lambda s, d: stamped(s, d).groupBy(R.timestamp_state(F.col("at")).alias("state")).agg(F.count("*").alias("n")),
    "configuration_diff": lambda s, d: R.document_diff(*configurations(s, d), "c_custkey").groupBy("pointer", "change").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first")),
    "slice_measures": lambda s, d: R.binary_measures(in_slices(s, d), ["slice"]),
    "slice_pairs": lambda s, d: R.slice_pairs(in_slices(s, d).select("slice", F.col("sample_id").alias("id"), "right").filter("slice != '(all)'"), "right"),
    "group_missingness": lambda s, d: R.group_missingness(customers(s, d), "c_mktsegment", "BUILDING", "MACHINERY", FEATURES),
    "new_categories": lambda s, d: R.new_categories(customers(s, d), "c_mktsegment", "BUILDING", "MACHINERY", "place"),
    "fault_scopes": scopes,
    "topological_levels": lambda s, d: R.topological_levels(frames.edges(s, d)).groupBy("level").agg(F.count("*").alias("nodes"), F.min("node").alias("first")),
    "leaderboard": lambda s, d: R.board(sources(s, d), "source", "accuracy", "n", 5),
    "findings": findings,
    "profile_comparison": lambda s, d: R.profile_join(accuracy_of(s, d, 0), accuracy_of(s, d, 1), "source", "value"),
    "resource_comparison": lambda s, d: R.resource_summary(T(s, d, "events").withColumn("trial", F.dayofmonth("ts")), "event_type", "trial", "value", "view"),
    "graph_nodes": graph_nodes,
    "graph_reached_kinds": reached_kinds,
    "lineage_links": lineage,
    "parameter_stress": parameters,
    "cluster_criteria": lambda s, d: R.criteria(measured(s, d), ["signature"], {"signals": 2, "runs": 2, "mean_magnitude": 0.11, "prevalence": 0.08}),
    "cluster_compactness": lambda s, d: R.compactness(signals(s, d), "class_label", [("predicted_label", 2.0), ("band", 1.0)]),
    "top_clusters": lambda s, d: R.top_by(measured(s, d).withColumn("all", F.lit(1)), ["all"], [F.desc("signals"), F.desc("worst"), F.asc("signature")], 5).select("rank", "signature", "signals"),
    "largest_contrasts": lambda s, d: R.top_by(X.trial_contrasts(frames.trials(s, d), "discount").withColumn("all", F.lit(1)), ["all"], [F.desc(F.abs("contrast")), F.asc("trial_key")], 5).select("rank", "trial_key", "contrast"),
    "error_candidates": candidates,
    "label_keys": lambda s, d: P(s, d).select(F.explode(F.array(I.label_key(F.col("lang"), "string"), I.label_key(F.col("y_true"), "number"))).alias("key")).groupBy("key").agg(F.count("*").alias("n")),
    "derived_seeds": lambda s, d: T(s, d, "nation").select("n_nationkey", I.derived_seed(11, F.col("n_name"), F.lit("noise")).alias("seed")),
    "prediction_log": logged,
    "file_manifest": manifest,
    "stored_subset": lambda s, d: L.restricted(P(s, d), T(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("sample_id")), "sample_id").groupBy("lang").agg(F.count("*").alias("n")),
    "fault_by_slice": lambda s, d: R.binary_measures(in_slices(s, d).withColumn("y_pred", F.when(rng.uniform(31, F.col("sample_id")) < 0.2, 1 - F.col("y_true")).otherwise(F.col("y_pred"))), ["slice"]).filter("measure = 'accuracy'"),
}

_UNNEST = f"{PM}, uu AS (SELECT y_true, unnest(scores) AS score, unnest([{', '.join(repr(c) for c in frames.PRIORITIES)}]) AS label FROM p), cc AS (SELECT label, score, count(*) FILTER (y_true = label) AS pos, count(*) FILTER (y_true <> label) AS neg FROM uu GROUP BY 1, 2)"
_OVR = f"""{_UNNEST}, rr AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS seen FROM cc WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ovr AS (SELECT label, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, {q9('sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0)')} AS auc, {q9('sum(pos * tp / seen) / nullif(sum(pos), 0)')} AS ap FROM rr GROUP BY label)"""
_RIGHT = "CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_INS = "ins AS (" + " UNION ALL ".join(f"SELECT '{k}' AS slice, * FROM p WHERE {c}" for k, c in {"(all)": "TRUE", **_SL}.items()) + ")"


def _measures(source: str, pred: str = "y_pred") -> str:
    return f"""bc AS (SELECT slice, count(*) AS n, count(*) FILTER (y_true = 1 AND {pred} = 1) AS tp, count(*) FILTER (y_true <> 1 AND {pred} = 1) AS fp, count(*) FILTER (y_true = 1 AND {pred} <> 1) AS fn, count(*) FILTER (y_true <> 1 AND {pred} <> 1) AS tn FROM {source} GROUP BY slice),
bm AS (SELECT slice, n, unnest(['accuracy', 'precision', 'recall', 'f1', 'balanced_accuracy', 'error_rate']) AS measure, unnest([(tp + tn) / n, tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), 2 * tp / nullif(2 * tp + fp + fn, 0), (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, (fp + fn) / n]) AS v FROM bc),
bx AS (SELECT slice, measure, {q9('v')} AS value, n, CASE WHEN v IS NULL THEN 'UNDEFINED' WHEN n < 10 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'COMPUTED' END AS status FROM bm)"""


def _acc(part: int) -> str:
    return f"SELECT source, {q9(f'avg({_RIGHT})')} AS value, CASE WHEN count(*) >= 5 THEN 'COMPUTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM p WHERE sample_id % 2 = {part} AND source <> 'src{part}' GROUP BY source"


_CUST = """cu AS (SELECT c_mktsegment AS g, CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1 END AS balance, CASE WHEN c_custkey % 11 <> 0 THEN 0 ELSE 1 END AS segment, CASE WHEN c_custkey % 13 <> 0 OR c_mktsegment <> 'BUILDING' THEN 0 ELSE 1 END AS phone,
CASE WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey + 3 ELSE c_nationkey END AS place FROM customer)"""
_MEAS = f"{_CS}, me AS (SELECT signature, count(*) AS signals, count(DISTINCT run) AS runs, {q9('count(DISTINCT run) / 25.0')} AS prevalence, floor(CAST(sum(CAST(round(magnitude * 1e9) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 1e9 AS mean_magnitude, {q9('max(magnitude)')} AS worst FROM ss GROUP BY signature)"
_TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
_NODES = """kn AS (SELECT 'region:' || r_regionkey AS node FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'order:' || o_orderkey FROM orders
UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey % 10 <> 7)"""


def q6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


SQL = {
    "one_against_rest": f"WITH {_OVR} SELECT * FROM ovr",
    "one_against_rest_macro": f"WITH {_OVR}, a AS (SELECT avg(auc) AS auc, avg(ap) AS ap FROM ovr) SELECT 'auc_ovr_macro' AS measure, {q9('auc')} AS value, 'COMPUTED' AS status FROM a UNION ALL SELECT 'ap_ovr_macro', {q9('ap')}, 'COMPUTED' FROM a",
    "confidence_auroc": f"""WITH {PB}, c AS (SELECT confidence AS score, count(*) FILTER (y_true = y_pred) AS pos, count(*) FILTER (y_true <> y_pred) AS neg FROM p GROUP BY 1), r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, {q9('sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0)')} AS auc FROM r""",
    "softmax": f"""WITH {PM}, x AS (SELECT sample_id, scores, list_max(scores) AS m FROM p), e AS (SELECT sample_id, list_transform(scores, lambda v: exp(10 * v - 10 * m)) AS e FROM x)
SELECT sample_id, {q9('list_max(e) / list_sum(e)')} AS top, {q9('list_min(e) / list_sum(e)')} AS least, 1.0::DOUBLE AS total FROM e""",
    "cell_keys": """WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE CAST(l_discount AS DOUBLE) END FROM lineitem)
SELECT CASE WHEN v IS NULL THEN 'None' WHEN isnan(v) THEN 'nan' WHEN v = floor(v) AND abs(v) < 1e15 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS key, count(*) AS n FROM v GROUP BY 1""",
    "timestamp_states": """SELECT CASE event_id % 7 WHEN 0 THEN 'VALID' WHEN 1 THEN 'VALID' WHEN 2 THEN 'NOT_UTC' WHEN 3 THEN 'NAIVE' WHEN 4 THEN 'NOT_A_TIMESTAMP' WHEN 5 THEN CASE WHEN month(ts) = 1 THEN 'NOT_A_TIMESTAMP' ELSE 'NAIVE' END ELSE 'MISSING' END AS state, count(*) AS n FROM events GROUP BY 1""",
    "configuration_diff": """WITH d AS (SELECT '/place/nation' AS pointer, 'changed' AS change, c_custkey FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT '/segment', 'removed', c_custkey FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT '/tier', 'added', c_custkey FROM customer WHERE c_custkey % 3 = 0)
SELECT pointer, change, count(*) AS n, min(c_custkey) AS first FROM d GROUP BY 1, 2""",
    "slice_measures": f"WITH {PB}, {_INS}, {_measures('ins')} SELECT * FROM bx",
    "slice_pairs": "WITH " + PB + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({_SL[a]}) AS n_a, count(*) FILTER ({_SL[b]}) AS n_b, count(*) FILTER (({_SL[a]}) AND ({_SL[b]})) AS shared, {q9(f'avg({_RIGHT}) FILTER ({_SL[a]})')} AS mean_a, {q9(f'avg({_RIGHT}) FILTER ({_SL[b]})')} AS mean_b, "
        f"{q9(f'avg({_RIGHT}) FILTER ({_SL[a]}) - avg({_RIGHT}) FILTER ({_SL[b]})')} AS difference, CASE WHEN count(*) FILTER (({_SL[a]}) AND ({_SL[b]})) > 0 THEN 'UNDEFINED' ELSE 'DERIVED' END AS status FROM p"
        for a in _SL for b in _SL if a < b
    ),
    "group_missingness": "WITH " + _CUST + ", f AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, g, {f} AS gone FROM cu" for f in FEATURES) + f"""), a AS (SELECT feature, count(*) FILTER (g = 'BUILDING') AS nr, count(*) FILTER (g = 'MACHINERY') AS nc, count(*) FILTER (g = 'BUILDING' AND gone = 1) AS kr, count(*) FILTER (g = 'MACHINERY' AND gone = 1) AS kc FROM f GROUP BY feature)
SELECT feature, nr AS n_reference, nc AS n_comparison, {q9('kr / nr')} AS rate_reference, {q9('kc / nc')} AS rate_comparison, {q9(_wilson('kr', 'nr', False))} AS lower_reference, {q9(_wilson('kr', 'nr', True))} AS upper_reference,
{q9(_wilson('kc', 'nc', False))} AS lower_comparison, {q9(_wilson('kc', 'nc', True))} AS upper_comparison, {q9('kc / nc - kr / nr')} AS difference, CASE WHEN least(nr, nc) < 30 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'DERIVED' END AS status FROM a""",
    "new_categories": f"""WITH {_CUST}, c AS (SELECT CAST(place AS VARCHAR) AS category, count(*) FILTER (g = 'BUILDING') AS x, count(*) FILTER (g = 'MACHINERY') AS n FROM cu GROUP BY 1)
SELECT category, n, {q9('n / (SELECT sum(n) FROM c)')} AS fraction, n / (SELECT sum(n) FROM c) < 0.01 AS rare FROM c WHERE x = 0 AND n > 0""",
    "fault_scopes": f"""WITH {PB}, h AS (SELECT *, row_number() OVER (ORDER BY sha256('3:' || sample_id), sample_id) <= floor(0.25 * count(*) OVER () + 0.5) AS pick FROM p),
s AS (SELECT 'all' AS scope, TRUE AS hit, score FROM h UNION ALL SELECT 'share', pick, score FROM h UNION ALL SELECT 'class', y_true = 1, score FROM h)
SELECT scope, count(*) AS n, count(*) FILTER (hit) AS affected, {q9('avg(CASE WHEN hit THEN score * 0.5 ELSE score END)')} AS mean_score FROM s GROUP BY scope""",
    "topological_levels": f"""WITH RECURSIVE {_G}, ends AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed), r(node, level) AS (SELECT node, 0 FROM ends WHERE node NOT IN (SELECT dst FROM ed) UNION SELECT dst, level + 1 FROM r JOIN ed ON src = node), m AS (SELECT node, max(level) AS level FROM r GROUP BY node)
SELECT level, count(*) AS nodes, min(node) AS first FROM m GROUP BY level""",
    "leaderboard": f"""WITH {PB}, a AS (SELECT source, {q9(f'avg({_RIGHT})')} AS accuracy, count(*) AS n FROM p GROUP BY source), k AS (SELECT source, rank() OVER (ORDER BY accuracy DESC) AS rank FROM a WHERE n >= 5)
SELECT source, accuracy, n, rank, CASE WHEN n < 5 THEN 'EXCLUDED: coverage' ELSE 'INCLUDED' END AS status FROM a LEFT JOIN k USING (source)""",
    "findings": f"""WITH {PB}, c AS (SELECT y_true, count(*) AS n, avg({_RIGHT}) AS r FROM p GROUP BY y_true), b AS (SELECT count(*) AS n, sum({_RIGHT}) AS k, sum(confidence) AS c FROM p GROUP BY least(floor(confidence * 10), 9)),
sl AS (SELECT lang AS slice, count(*) AS n, avg({_RIGHT}) AS a, 2 * count(*) FILTER (y_true = 1 AND y_pred = 1) / nullif(2 * count(*) FILTER (y_true = 1 AND y_pred = 1) + count(*) FILTER (y_true <> y_pred), 0) AS f FROM p GROUP BY GROUPING SETS ((lang), ())),
s1 AS (SELECT x.slice, o.a - x.a AS da, o.f - x.f AS df FROM sl x, sl o WHERE o.slice IS NULL AND x.slice IS NOT NULL AND x.n >= 10),
rg AS (SELECT l_returnflag AS slice, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(t) AS r2 FROM (SELECT l_returnflag, l_extendedprice AS t, l_quantity * p_retailprice * CASE WHEN l_returnflag = 'R' THEN 1.3 ELSE 1.0 END - l_extendedprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY GROUPING SETS ((l_returnflag), ())),
s2 AS (SELECT x.slice, x.mae / o.mae - 1 AS dm, x.rmse / o.rmse - 1 AS dr FROM rg x, rg o WHERE o.slice IS NULL AND x.slice IS NOT NULL AND x.n >= 10),
f AS (SELECT 'class-imbalance' AS rule, 'NOTICE' AS severity, 'overall' AS affected, 'imbalance_ratio' AS measure, (SELECT max(n) / min(n) FROM c) AS v, '>=' AS comparison, 1.2::DOUBLE AS threshold
UNION ALL SELECT 'minority-recall', 'WARNING', (SELECT 'class:' || y_true FROM c ORDER BY n, y_true LIMIT 1), 'minority_recall', (SELECT r FROM c ORDER BY n, y_true LIMIT 1), '<', 0.7
UNION ALL SELECT 'ece-threshold', 'WARNING', 'overall', 'ece', (SELECT sum(abs(k - c)) / sum(n) FROM b), '>', 0.1
UNION ALL SELECT 'high-confidence-errors', 'WARNING', 'overall', 'high_confidence_error_rate', (SELECT count(*) FILTER (y_true <> y_pred AND confidence >= 0.9) / count(*) FROM p), '>', 0.02
UNION ALL SELECT 'r2-floor', 'WARNING', 'overall', 'r2', (SELECT r2 FROM rg WHERE slice IS NULL), '<', 0.99
UNION ALL SELECT 'latency-outlier', 'NOTICE', 'overall', 'latency_ratio', (SELECT max(value) / median(value) FROM events), '>', 5.0
UNION ALL SELECT 'slice-accuracy-drop', 'WARNING', 'slice:' || slice, 'accuracy_drop', da, '>', 0.01 FROM s1 UNION ALL SELECT 'slice-accuracy-drop', 'WARNING', 'slice:' || slice, 'f1_drop', df, '>', 0.01 FROM s1
UNION ALL SELECT 'slice-error-increase', 'WARNING', 'slice:' || slice, 'mae_increase', dm, '>', 0.05 FROM s2 UNION ALL SELECT 'slice-error-increase', 'WARNING', 'slice:' || slice, 'rmse_increase', dr, '>', 0.05 FROM s2)
SELECT rule, severity, affected, measure, {q9('v')} AS observed, comparison, threshold FROM f WHERE CASE comparison WHEN '>' THEN v > threshold WHEN '>=' THEN v >= threshold ELSE v < threshold END""",
    "profile_comparison": f"""WITH {PB}, a AS ({_acc(0)}), b AS ({_acc(1)}) SELECT source, a.value AS a, b.value AS b, CASE WHEN a.status = 'COMPUTED' AND b.status = 'COMPUTED' THEN {q9('b.value - a.value')} END AS difference,
CASE WHEN b.status IS NULL THEN 'ONLY_IN_A' WHEN a.status IS NULL THEN 'ONLY_IN_B' WHEN NOT (a.status = 'COMPUTED' AND b.status = 'COMPUTED') THEN 'NOT_COMPARABLE' WHEN a.value = b.value THEN 'EQUAL' ELSE 'DIFFERENT' END AS relation FROM a FULL JOIN b USING (source)""",
    "resource_comparison": f"""WITH t AS (SELECT event_type, day(ts) AS d, count(*) / sum(value) AS r FROM events GROUP BY 1, 2), g AS (SELECT event_type, count(*) AS trials, avg(r) AS m, stddev_samp(r) AS s FROM t GROUP BY 1)
SELECT event_type, trials, {q9('m')} AS throughput, CASE WHEN trials > 1 THEN {q9('s / m')} END AS cv, {q9("m / (SELECT m FROM g WHERE event_type = 'view')")} AS ratio, m < (SELECT m FROM g WHERE event_type = 'view') AS slower FROM g""",
    "graph_nodes": f"WITH {_G}, {_NODES}, ends AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed) SELECT split_part(ends.node, ':', 1) AS kind, kn.node IS NOT NULL AS known, count(*) AS nodes FROM ends LEFT JOIN kn USING (node) GROUP BY 1, 2",
    "graph_reached_kinds": f"WITH RECURSIVE {_G}, r(node, depth) AS (SELECT 'region:2', 0 UNION SELECT dst, depth + 1 FROM r JOIN ed ON src = node WHERE depth < 3), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT depth, split_part(node, ':', 1) AS kind, count(*) AS nodes, min(node) AS first FROM m GROUP BY 1, 2",
    "lineage_links": f"WITH {_CS} SELECT signal, n_name, r_name, CASE WHEN n_name IS NULL THEN 'RUN_MISSING' WHEN r_name IS NULL THEN 'REGION_MISSING' ELSE 'LINKED' END AS link FROM ss LEFT JOIN nation ON n_nationkey = run LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON r_regionkey = n_regionkey",
    "parameter_stress": f"""WITH w AS (SELECT p_brand AS a, p_partkey AS k, CAST(p_retailprice AS DOUBLE) AS w FROM part), m AS (SELECT a, sqrt(avg(w * w)) AS rms FROM w GROUP BY a),
d AS (SELECT 'PARAMETER_SCALE' AS family, a, w, w * 0.9::DOUBLE - w AS d FROM w UNION ALL SELECT 'PARAMETER_NOISE', a, w, w + 0.05::DOUBLE * rms * ({u(21, 'k')} * 2 - 1) - w FROM w JOIN m USING (a))
SELECT family, a AS array, count(*) AS n, {q6('max(abs(d))')} AS max_abs_change, {q6('sqrt(sum(d * d) / sum(w * w))')} AS relative_l2_change FROM d GROUP BY 1, 2""",
    "cluster_criteria": f"""WITH {_MEAS}, c AS (SELECT signature, signals >= 2 AND runs >= 2 AND mean_magnitude >= 0.11 AND prevalence >= 0.08 AS satisfied, unnest(['signals', 'runs', 'mean_magnitude', 'prevalence']) AS criterion, unnest([2.0, 2.0, 0.11, 0.08]::DOUBLE[]) AS required, unnest([signals, runs, mean_magnitude, prevalence]::DOUBLE[]) AS o FROM me)
SELECT signature, criterion, required, {q9('o')} AS observed, o >= required AS passed, satisfied FROM c""",
    "cluster_compactness": f"""WITH {_CS}, n AS (SELECT class_label, count(*) AS members FROM ss GROUP BY 1), v AS (SELECT class_label, 2.0 AS w, count(*) AS c FROM ss GROUP BY class_label, predicted_label UNION ALL SELECT class_label, 1.0, count(*) FROM ss GROUP BY class_label, band),
t AS (SELECT class_label, sum(w * c * (c - 1)) AS s FROM v GROUP BY 1) SELECT class_label, members, {q9('s / nullif(members * (members - 1) * 3.0, 0)')} AS compactness FROM n JOIN t USING (class_label)""",
    "top_clusters": f"WITH {_MEAS} SELECT CAST(row_number() OVER (ORDER BY signals DESC, worst DESC, signature) AS INTEGER) AS rank, signature, signals FROM me QUALIFY rank <= 5",
    "largest_contrasts": f"WITH {_WIDE}, c AS (SELECT trial_key, {q9('yab - ya - yb + y0')} AS contrast FROM w WHERE yab - ya - yb + y0 IS NOT NULL) SELECT CAST(row_number() OVER (ORDER BY abs(contrast) DESC, trial_key) AS INTEGER) AS rank, trial_key, contrast FROM c QUALIFY rank <= 5",
    "error_candidates": f"""WITH {PB}, r AS (SELECT 'CONFIDENT_ERROR' AS kind, lang, sample_id, confidence, row_number() OVER (PARTITION BY lang ORDER BY confidence DESC, sample_id) AS k FROM p WHERE y_true <> y_pred
UNION ALL SELECT 'UNCONFIDENT_SUCCESS', lang, sample_id, confidence, row_number() OVER (PARTITION BY lang ORDER BY confidence, sample_id) FROM p WHERE y_true = y_pred) SELECT kind, lang, CAST(k AS INTEGER) AS rank, sample_id, {q9('confidence')} AS confidence FROM r WHERE k <= 3""",
    "label_keys": f"""WITH {PB}, k AS (SELECT '"' || lang || '"' AS key FROM p UNION ALL SELECT CAST(y_true AS VARCHAR) FROM p) SELECT key, count(*) AS n FROM k GROUP BY key""",
    "derived_seeds": "SELECT n_nationkey, CAST('0x' || substr(sha256('11:' || length(n_name) || ':' || n_name || ';5:noise;'), 1, 15) AS BIGINT) AS seed FROM nation",
    "prediction_log": f"WITH {PB} SELECT sample_id, CAST(y_true AS INTEGER) AS y_true, CAST(y_pred AS INTEGER) AS y_pred, lang FROM p",
    "stored_subset": f"WITH {PB} SELECT lang, count(*) AS n FROM p WHERE sample_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang",
    "fault_by_slice": f"WITH {PB}, {_INS}, fl AS (SELECT slice, y_true, CASE WHEN {u(31)} < 0.2 THEN 1 - y_true ELSE y_pred END AS yp FROM ins), {_measures('fl', 'yp')} SELECT * FROM bx WHERE measure = 'accuracy'",
}
