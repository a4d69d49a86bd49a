"""Data-quality queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..operators import data_quality as Q
from ..operators import quality_rules as R
from .evaluation import q9
from .shift import _wilson

T = frames.table
KINDS = {"text": "CATEGORICAL", "size": "NUMERIC", "lang": "CATEGORICAL", "flag": "BOOLEAN"}


def planted(s, d):
    """Documents with missing tokens, infinities and misplaced words planted by id."""
    i = F.col("doc_id")
    return T(s, d, "documents").select(
        "doc_id", F.when(i % 17 == 0, "n/a").otherwise(F.col("text")).alias("text"),
        F.when(i % 19 == 0, "inf").when(i % 23 == 0, "many").when(i % 29 == 0, F.lit(None)).otherwise(F.col("n_chars").cast("string")).alias("size"),
        F.when(i % 31 == 0, "").otherwise(F.col("lang")).alias("lang"), F.when(i % 7 == 0, "yes").otherwise((i % 2).cast("string")).alias("flag"),
    )


def ref(s, d):
    return T(s, d, "documents").filter("doc_id % 3 != 0").withColumn("t", F.col("lang"))


def cmp(s, d):
    return T(s, d, "documents").filter("doc_id % 3 != 1").withColumn("t", F.col("lang"))


def events_side(s, d, side):
    return frames.drift_events(s, d).filter(F.col("side") == side)


TARGET = "t"


def targets(s, d):
    """Order status as a target: some missing, some numbers, one infinite, one class of its own."""
    i = F.col("o_orderkey")
    t = F.when(i % 41 == 0, F.lit(None)).when(i % 43 == 0, "7").when(i == 5, "inf").when(i == 6, "odd").otherwise(F.col("o_orderstatus"))
    return T(s, d, "orders").select("o_orderkey", t.alias(TARGET), F.when(i % 47 == 0, "n/a").when(i % 5 == 0, F.concat(F.lit("k"), (i - 1).cast("string"))).otherwise(F.concat(F.lit("k"), i.cast("string"))).alias("key"), "o_orderpriority")


def rules(s, d):
    p = planted(s, d)
    parts = (
        R.missing_rules(p, KINDS, 0.05, 0.4), R.identifier_rules(targets(s, d), "key", ["o_orderpriority"]),
        R.categorical_rules(p, KINDS, {"lang": ["en", "de", "fr"]}, 0.06, 100), R.distribution_rules(p.withColumn("none", F.lit(None).cast("string")), KINDS | {"none": "NUMERIC"}, 2.0, 0.45, 3),
        R.target_rules(targets(s, d), TARGET, 0.02, 5, 0.05, ["O", "F", "P", "7"]),
    )
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


QUERIES = {
    "quality_rules": rules,
    "quality_statuses": lambda s, d: R.statuses(rules(s, d), {"missingness": "RUN", "identifiers": "RUN", "categorical": "RUN", "distribution": "RUN", "target": "RUN", "target_leakage": "UNAVAILABLE", "group_comparison": "NOT_APPLICABLE", "duplicates": "RUN"}),
    "cell_classification": lambda s, d: Q.cells(planted(s, d), KINDS),
    "missingness": lambda s, d: Q.missingness(planted(s, d), KINDS, 0.05),
    "missing_patterns": lambda s, d: Q.missing_patterns(planted(s, d), KINDS),
    "schema_check": lambda s, d: Q.schema_check(T(s, d, "orders"), {"o_orderkey": "bigint", "o_totalprice": "int", "o_missing": "string"}),
    "sample_count": lambda s, d: Q.sample_count(T(s, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id", 100, 10_000_000),
    "duplicate_rows": lambda s, d: Q.duplicates(T(s, d, "documents"), ["text"], "source"),
    "identifier_like": lambda s, d: Q.identifier_like(T(s, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    "numeric_check": lambda s, d: Q.numeric_check(T(s, d, "lineitem").withColumn("constant", F.lit(7.0)), ["l_quantity", "l_discount", "constant"]),
    "bounds_check": lambda s, d: Q.bounds_check(T(s, d, "lineitem"), "l_quantity", 2, 49),
    "categorical_check": lambda s, d: Q.categorical_check(T(s, d, "orders"), "o_orderstatus", ["O", "F"]),
    "distribution_check": lambda s, d: Q.distribution_check(T(s, d, "lineitem"), "l_discount", "l_returnflag"),
    "target_check": lambda s, d: Q.target_check(T(s, d, "labels"), "toxic", 10, 0.2),
    "target_leakage": lambda s, d: Q.leakage(T(s, d, "orders").withColumn("copy", F.col("o_orderstatus")), ["copy", "o_orderpriority", "o_custkey"], "o_orderstatus"),
    "split_overlap": lambda s, d: Q.split_overlap(ref(s, d), cmp(s, d), "doc_id", ["text"], "t"),
    "temporal_order": lambda s, d: Q.temporal_order(events_side(s, d, "reference").select(F.col("event_id").alias("k")), events_side(s, d, "comparison").select(F.col("event_id").alias("k")), "k"),
    "benchmark_containment": lambda s, d: Q.containment(T(s, d, "documents"), T(s, d, "benchmark")),
    "quality_verdict": lambda s, d: Q.overall(Q.missingness(planted(s, d), KINDS, 0.05).select("status").unionByName(Q.bounds_check(T(s, d, "lineitem"), "l_quantity", 2, 49).select("status"))),
}

_PL = """pl AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'n/a' ELSE text END AS text,
CASE WHEN doc_id % 19 = 0 THEN 'inf' WHEN doc_id % 23 = 0 THEN 'many' WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS size,
CASE WHEN doc_id % 31 = 0 THEN '' ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN 'yes' ELSE CAST(doc_id % 2 AS VARCHAR) END AS flag FROM documents),
u AS (SELECT doc_id, 'text' AS feature, text AS v, 'C' AS k FROM pl UNION ALL SELECT doc_id, 'size', size, 'N' FROM pl UNION ALL SELECT doc_id, 'lang', lang, 'C' FROM pl UNION ALL SELECT doc_id, 'flag', flag, 'B' FROM pl),
cl AS (SELECT doc_id, feature, CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'n/a', 'na', 'null', 'none', 'nan') THEN 'missing' WHEN k = 'C' THEN 'valid'
 WHEN k = 'B' THEN CASE WHEN lower(trim(v)) IN ('true', 'false', '0', '1') THEN 'valid' ELSE 'invalid' END
 WHEN regexp_full_match(lower(trim(v)), '[+-]?(\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?') THEN 'valid' WHEN regexp_full_match(lower(trim(v)), '[+-]?inf(inity)?') THEN 'nonfinite' ELSE 'invalid' END AS class FROM u)"""
_MISS = f"""{_PL}, m AS (SELECT feature, count(*) AS n, count(*) FILTER (class = 'missing') AS missing FROM cl GROUP BY feature),
mi AS (SELECT feature, n, missing, {q9('missing / n')} AS rate, {q9(_wilson('missing', 'n', False))} AS lower, {q9(_wilson('missing', 'n', True))} AS upper, CASE WHEN missing / n > 0.05 THEN 'FAIL' ELSE 'PASS' END AS status FROM m)"""

_GONE = lambda c: f"({c} IS NULL OR lower(trim({c})) IN ('', 'n/a', 'na', 'null', 'none', 'nan'))"
_NUM = lambda c: f"regexp_full_match(lower(trim({c})), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?')"
_INF = lambda c: f"regexp_full_match(lower(trim({c})), '[+-]?inf(inity)?')"


def _v(check: str, subject: str, rule: str, level: str, affected: str, observed: str | None, configured: float | None, source: str) -> str:
    return f"SELECT '{check}' AS \"check\", {subject} AS subject, '{rule}' AS rule, '{level}' AS level, CAST({affected} AS BIGINT) AS affected, {q9(observed) if observed else 'NULL::DOUBLE'} AS observed, {f'{configured}::DOUBLE' if configured is not None else 'NULL::DOUBLE'} AS configured FROM {source}"


def _rules_sql() -> str:
    f = list(KINDS)
    lacking = " + ".join(f"CAST({_GONE(c)} AS INTEGER)" for c in f)
    ctes = [_PLANTED, "mi AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({_GONE(c)}) AS k, count(*) AS n FROM pl" for c in f) + ")", f"mr AS (SELECT count(*) AS n, count(*) FILTER (({lacking}) / 4 > 0.4) AS k FROM pl)"]
    parts = [_v("missingness", "feature", "feature_missing_rate_exceeded", "FAIL", "k", "k / n", 0.05, "mi WHERE k / n > 0.05"), _v("missingness", "'rows'", "row_missing_rate_exceeded", "FAIL", "k", "k / n", 0.4, "mr WHERE k > 0")]
    ctes += ["""tg AS (SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '7' WHEN o_orderkey = 5 THEN 'inf' WHEN o_orderkey = 6 THEN 'odd' ELSE o_orderstatus END AS t,
CASE WHEN o_orderkey % 47 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 0 THEN 'k' || (o_orderkey - 1) ELSE 'k' || o_orderkey END AS key, o_orderpriority FROM orders)""",
        f"kc AS (SELECT CASE WHEN NOT {_GONE('key')} THEN key END AS k, count(*) AS c, count(DISTINCT o_orderpriority) AS s FROM tg GROUP BY 1)"]
    parts += [
        _v("identifiers", "'key'", "duplicate_ids", "FAIL", "c", "g", None, "(SELECT sum(c) AS c, count(*) AS g FROM kc WHERE k IS NOT NULL AND c > 1) WHERE g > 0"),
        _v("identifiers", "'key'", "conflicting_rows_share_id", "FAIL", "c", "g", None, "(SELECT sum(c) AS c, count(*) AS g FROM kc WHERE k IS NOT NULL AND s > 1) WHERE g > 0"),
        _v("identifiers", "'key'", "missing_ids", "WARNING", "c", None, None, "(SELECT sum(c) AS c FROM kc WHERE k IS NULL) WHERE c > 0"),
    ]
    ctes += ["vc AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{k}' AS kind, CASE WHEN {_GONE(c)} THEN 'missing' " + (f"WHEN {_NUM(c)} THEN 'valid' WHEN {_INF(c)} THEN 'nonfinite' ELSE 'invalid' END AS class, CASE WHEN NOT {_GONE(c)} AND {_NUM(c)} THEN CAST(CAST({c} AS DOUBLE) AS VARCHAR) END AS v"
        if k == "NUMERIC" else f"WHEN lower(trim({c})) IN ('true', 'false', '0', '1') THEN 'valid' ELSE 'invalid' END AS class, CASE WHEN lower(trim({c})) IN ('true', '1') THEN 'true' ELSE 'false' END AS v" if k == "BOOLEAN" else f"ELSE 'valid' END AS class, {c} AS v") + " FROM pl" for c, k in KINDS.items()) + ")",
        "vv AS (SELECT feature, kind, v, count(*) AS c FROM vc WHERE class = 'valid' GROUP BY 1, 2, 3)", "vt AS (SELECT feature, kind, sum(c) AS n, count(*) AS d, max(c) AS top FROM vv GROUP BY 1, 2)",
        "vk AS (SELECT feature, skewness(x) AS s0, avg(x) AS m, count(x) AS n FROM (SELECT feature, CAST(v AS DOUBLE) AS x FROM vc WHERE class = 'valid' AND kind = 'NUMERIC') GROUP BY feature)",
        "vm AS (SELECT feature, any_value(n) AS n, (sum(power(x - m, 3)) / any_value(n)) / power(sum(power(x - m, 2)) / any_value(n), 1.5) AS skew FROM (SELECT feature, CAST(v AS DOUBLE) AS x FROM vc WHERE class = 'valid' AND kind = 'NUMERIC') JOIN vk USING (feature) GROUP BY feature)"]
    cat = "kind <> 'NUMERIC'"
    parts += [
        _v("categorical", "feature", "invalid_type", "FAIL", "c", None, None, f"(SELECT feature, count(*) AS c FROM vc WHERE {cat} AND class IN ('invalid', 'nonfinite') GROUP BY 1)"),
        _v("categorical", "feature", "invalid_category", "FAIL", "c", "k", None, "(SELECT feature, sum(c) AS c, count(*) AS k FROM vv WHERE feature = 'lang' AND v NOT IN ('en', 'de', 'fr') GROUP BY 1)"),
        _v("categorical", "feature", "rare_categories", "WARNING", "c", "k", 0.06, f"(SELECT feature, sum(c) AS c, count(*) AS k FROM vv JOIN vt USING (feature, kind) WHERE {cat} AND c / n < 0.06 GROUP BY 1)"),
        _v("categorical", "feature", "cardinality_exceeded", "FAIL", "n", "d", 100, f"vt WHERE {cat} AND d > 100"),
        _v("distribution", "feature", "skew_exceeds_configured", "WARNING", "n", "skew", 2.0, "vm WHERE abs(skew) > 2.0"),
        _v("distribution", "feature", "dominant_value", "WARNING", "top", "top / n", 0.45, "vt WHERE top / n > 0.45"),
        _v("distribution", "feature", "few_distinct_values", "WARNING", "n", "d", 3, "vt WHERE d < 3"),
        _v("distribution", "'none'", "no_valid_values", "INCONCLUSIVE", "0", None, None, "(SELECT 1)"),
    ]
    ctes += [f"ta AS (SELECT count(*) AS n, count(*) FILTER ({_GONE('t')}) AS missing, count(*) FILTER (NOT {_GONE('t')} AND {_NUM('t')}) AS valid, count(*) FILTER (NOT {_GONE('t')} AND {_INF('t')}) AS nonfinite, count(*) FILTER (NOT {_GONE('t')} AND NOT {_NUM('t')} AND NOT {_INF('t')}) AS invalid FROM tg)",
        f"tk AS (SELECT trim(t) AS label, count(*) AS c, sum(count(*)) OVER () AS n FROM tg WHERE NOT {_GONE('t')} AND NOT {_INF('t')} GROUP BY 1)"]
    parts += [
        _v("target", "'target'", "missing_targets", "WARNING", "missing", None, None, "ta WHERE missing > 0"),
        _v("target", "'target'", "missing_target_rate_exceeded", "FAIL", "missing", "missing / n", 0.02, "ta WHERE missing / n > 0.02"),
        _v("target", "'target'", "inconsistent_target_types", "FAIL", "least(invalid, valid)", None, None, "ta WHERE least(invalid, valid) > 0"),
        _v("target", "'target'", "nonfinite_target", "FAIL", "nonfinite", None, None, "ta WHERE nonfinite > 0"),
        _v("target", "'target'", "invalid_target_value", "FAIL", "c", "k", None, "(SELECT sum(c) AS c, count(*) AS k FROM tk WHERE label NOT IN ('O', 'F', 'P', '7')) WHERE k > 0"),
        _v("target", "'class:' || label", "singleton_class", "WARNING", "c", None, None, "tk WHERE c = 1"),
        _v("target", "'class:' || label", "class_below_min_count", "FAIL", "c", "c", 5, "tk WHERE c < 5"),
        _v("target", "'class:' || label", "class_below_min_proportion", "FAIL", "c", "c / n", 0.05, "tk WHERE c / n < 0.05"),
    ]
    return f"{', '.join(ctes)}, vio AS ({' UNION ALL '.join(parts)})"


_PLANTED = """pl AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'n/a' ELSE text END AS text,
CASE WHEN doc_id % 19 = 0 THEN 'inf' WHEN doc_id % 23 = 0 THEN 'many' WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS size,
CASE WHEN doc_id % 31 = 0 THEN '' ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN 'yes' ELSE CAST(doc_id % 2 AS VARCHAR) END AS flag FROM documents)"""
SQL = {
    "quality_rules": f"WITH {_rules_sql()} SELECT * FROM vio",
    "quality_statuses": f"""WITH {_rules_sql()}, st AS (SELECT * FROM (VALUES ('missingness', 'RUN'), ('identifiers', 'RUN'), ('categorical', 'RUN'), ('distribution', 'RUN'), ('target', 'RUN'), ('target_leakage', 'UNAVAILABLE'), ('group_comparison', 'NOT_APPLICABLE'), ('duplicates', 'RUN')) t("check", state)),
w AS (SELECT "check", count(*) AS k, min(list_position(['FAIL', 'WARNING', 'INCONCLUSIVE', 'UNAVAILABLE', 'NOT_APPLICABLE', 'PASS'], level)) AS p FROM vio GROUP BY 1),
e AS (SELECT "check", coalesce(k, 0) AS violations, CASE WHEN state <> 'RUN' THEN list_position(['FAIL', 'WARNING', 'INCONCLUSIVE', 'UNAVAILABLE', 'NOT_APPLICABLE', 'PASS'], state) ELSE coalesce(p, 6) END AS p FROM st LEFT JOIN w USING ("check")),
z AS (SELECT * FROM e UNION ALL SELECT '(all)', sum(violations), min(p) FROM e) SELECT "check", CAST(violations AS BIGINT) AS violations, ['FAIL', 'WARNING', 'INCONCLUSIVE', 'UNAVAILABLE', 'NOT_APPLICABLE', 'PASS'][p] AS status FROM z""",
    "cell_classification": f"WITH {_PL} SELECT feature, class, count(*) AS n FROM cl GROUP BY ALL",
    "missingness": f"WITH {_MISS} SELECT * FROM mi",
    "missing_patterns": f"""WITH {_PL}, p AS (SELECT doc_id, string_agg(CASE WHEN class = 'missing' THEN 'M' ELSE '.' END, '' ORDER BY CASE feature WHEN 'text' THEN 1 WHEN 'size' THEN 2 WHEN 'lang' THEN 3 ELSE 4 END) AS pattern FROM cl GROUP BY doc_id)
SELECT pattern, count(*) AS n FROM p GROUP BY pattern ORDER BY n DESC, pattern LIMIT 5""",
    "schema_check": """SELECT * FROM (VALUES ('o_orderkey', 'ok', 'PASS'), ('o_totalprice', 'invalid_type', 'FAIL'), ('o_missing', 'required_column_missing', 'FAIL')) t("column", rule, status)""",
    "sample_count": """WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL), a AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_ids, count(*) FILTER (c > 1) AS duplicate_ids FROM p)
SELECT *, CASE WHEN n < 100 OR n > 10000000 THEN 'FAIL' WHEN duplicate_ids > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM a""",
    "duplicate_rows": f"""WITH g AS (SELECT text, count(*) AS c, min(source) <> max(source) AS conflict FROM documents GROUP BY text)
SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) FILTER (c > 1) AS groups, CAST(coalesce(sum(c - 1) FILTER (c > 1), 0) AS BIGINT) AS duplicate_rows, {q9('coalesce(sum(c - 1) FILTER (c > 1), 0) / sum(c)')} AS rate, count(*) FILTER (conflict) AS conflicting_groups FROM g""",
    "identifier_like": f"""WITH u AS (SELECT 'c_custkey' AS c, CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)
SELECT c AS "column", count(*) AS n, count(DISTINCT v) AS distinct_values, {q9('count(DISTINCT v) / count(*)')} AS ratio, CASE WHEN count(DISTINCT v) / count(*) >= 0.98 THEN 'WARNING' ELSE 'PASS' END AS status FROM u GROUP BY c""",
    "numeric_check": f"""WITH u AS (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'constant', 7.0 FROM lineitem),
p AS (SELECT c, v, count(*) AS k FROM u GROUP BY ALL), a AS (SELECT c, sum(k) AS n, count(*) AS dd, max(k) AS top, min(v) AS lo, max(v) AS hi FROM p GROUP BY c)
SELECT c AS "column", CAST(n AS BIGINT) AS n, dd AS distinct_values, {q9('top / n')} AS modal_share, {q9('lo')} AS low, {q9('hi')} AS high, CASE WHEN dd = 1 THEN 'constant_feature' WHEN top / n >= 0.99 THEN 'near_constant_feature' ELSE 'varied' END AS rule FROM a""",
    "bounds_check": "SELECT count(l_quantity) AS n, count(*) FILTER (l_quantity < 2) AS below, count(*) FILTER (l_quantity > 49) AS above, CASE WHEN count(*) FILTER (l_quantity < 2 OR l_quantity > 49) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM lineitem",
    "categorical_check": f"""WITH c AS (SELECT o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS sh FROM c)
SELECT category, n, {q9('sh')} AS share, CASE WHEN category NOT IN ('O', 'F') THEN 'invalid_category' WHEN sh < 0.01 THEN 'rare' ELSE 'ok' END AS rule FROM s""",
    "distribution_check": f"""WITH p AS (SELECT l_returnflag, l_discount AS v, count(*) AS c, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_discount) AS r FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, CAST(sum(c) AS BIGINT) AS n, {q9('sum(CASE WHEN v = floor(v) THEN c ELSE 0 END) / sum(c)')} AS integer_share, {q9('max(v) FILTER (r = 1)')} AS modal_value, {q9('max(c) FILTER (r = 1) / sum(c)')} AS modal_share FROM p GROUP BY 1""",
    "target_check": f"""WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM c)
SELECT label, n, {q9('n / total')} AS p, {q9(_wilson('n', 'total', False))} AS lower, {q9(_wilson('n', 'total', True))} AS upper, CASE WHEN n = 1 THEN 'singleton_class' WHEN n < 10 THEN 'class_below_min_count' WHEN n / total < 0.2 THEN 'class_below_min_proportion' ELSE 'ok' END AS rule FROM t""",
    "target_leakage": f"""WITH u AS (SELECT 'copy' AS feature, o_orderstatus AS v, o_orderstatus AS t FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderstatus FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), o_orderstatus FROM orders),
p AS (SELECT feature, v, t, count(*) AS c FROM u GROUP BY ALL), w AS (SELECT feature, v, sum(c) AS n, max(c) AS top, sum(CASE WHEN v = t THEN c ELSE 0 END) AS same FROM p GROUP BY feature, v)
SELECT feature, CAST(sum(n) AS BIGINT) AS n, {q9('sum(same) / sum(n)')} AS equal_share, {q9('sum(top) FILTER (n >= 2) / sum(n) FILTER (n >= 2)')} AS purity, {q9('coalesce(sum(n) FILTER (n >= 2), 0) / sum(n)')} AS cover FROM w GROUP BY feature""",
    "split_overlap": """WITH r AS (SELECT * FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT * FROM documents WHERE doc_id % 3 <> 1), k AS (SELECT text, min(lang) AS lo, max(lang) AS hi FROM r GROUP BY text), m AS (SELECT lang = lo AND lang = hi AS same FROM c JOIN k USING (text))
SELECT (SELECT count(*) FROM c WHERE doc_id IN (SELECT doc_id FROM r)) AS ids_in_both, count(*) AS rows_with_known_vector, count(*) FILTER (same) AS agreeing, count(*) FILTER (NOT same) AS conflicting FROM m""",
    "temporal_order": """WITH r AS (SELECT event_id AS k FROM events WHERE ts < TIMESTAMP '2024-01-16'), c AS (SELECT event_id AS k FROM events WHERE ts >= TIMESTAMP '2024-01-16'), x AS (SELECT (SELECT max(k) FROM r) AS a, (SELECT min(k) FROM c) AS b),
y AS (SELECT a, b, (SELECT count(*) FROM c WHERE k <= a) AS na, (SELECT count(*) FROM r WHERE k >= b) AS nb FROM x) SELECT a AS reference_last, b AS comparison_first, na AS not_after, nb AS not_before, CASE WHEN na + nb > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM y""",
    "benchmark_containment": "SELECT item_id, count(DISTINCT doc_id) AS documents FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY item_id",
    "quality_verdict": f"""WITH {_MISS}, f AS (SELECT status FROM mi UNION ALL SELECT CASE WHEN count(*) FILTER (l_quantity < 2 OR l_quantity > 49) > 0 THEN 'FAIL' ELSE 'PASS' END FROM lineitem)
SELECT count(*) AS n, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS overall FROM f""",
}
