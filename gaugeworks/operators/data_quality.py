"""Data-quality checks. Each gives findings with a status; a check that can't be judged says so."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import framed
from ..status import q9, ratio, wilson
from .ordering import kept

TOKENS = ("", "n/a", "na", "null", "none", "nan")


def cell_class(c: Column, kind: str, tokens: Sequence[str] = TOKENS) -> Column:
    """valid, missing, nonfinite or invalid for a text cell of kind NUMERIC, CATEGORICAL or BOOLEAN. Nothing is coerced across kinds."""
    text = F.lower(F.trim(c))
    missing = c.isNull() | text.isin(*tokens)
    if kind == "NUMERIC":
        number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), "valid").when(text.rlike(r"^[+-]?inf(inity)?$"), "nonfinite").otherwise("invalid")
        return F.when(missing, "missing").otherwise(number)
    if kind == "BOOLEAN":
        return F.when(missing, "missing").when(text.isin("true", "false", "0", "1"), "valid").otherwise("invalid")
    return F.when(missing, "missing").otherwise("valid")


def cells(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(feature, class, n) for all declared features in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), cell_class(F.col(f).cast("string"), k).alias("class")) for f, k in kinds.items()]))
    return df.select(each.alias("x")).groupBy("x.feature", "x.class").agg(F.count("*").alias("n"))


def missingness(df: DataFrame, kinds: Mapping[str, str], limit: float) -> DataFrame:
    """(feature, n, missing, rate, lower, upper, status): FAIL above the limit."""
    c = cells(df, kinds).groupBy("feature").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("class") == "missing", F.col("n")).otherwise(0)).alias("missing"))
    low, high = wilson("missing", "n")
    rate = ratio("missing", "n")
    return c.select("feature", "n", "missing", q9(rate).alias("rate"), q9(low).alias("lower"), q9(high).alias("upper"), F.when(rate > limit, "FAIL").otherwise("PASS").alias("status"))


def missing_patterns(df: DataFrame, kinds: Mapping[str, str], k: int = 5) -> DataFrame:
    """(pattern, n): the k most frequent sets of missing features, M for missing and . for not, in declared order."""
    marks = F.concat(*[F.when(cell_class(F.col(f).cast("string"), kind) == "missing", "M").otherwise(".") for f, kind in kinds.items()])
    return df.groupBy(marks.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(k)


def schema_check(df: DataFrame, required: Mapping[str, str], allow_extra: bool = True) -> DataFrame:
    """(column, rule, status) from the declared types; the data isn't read."""
    have = dict(df.dtypes)
    rows = [(c, "required_column_missing" if c not in have else "invalid_type" if have[c] != t else "ok") for c, t in required.items()]
    rows += [] if allow_extra else [(c, "undeclared_column") for c in have if c not in required]
    out = df.sparkSession.createDataFrame(rows, "column string, rule string")
    return out.withColumn("status", F.when(F.col("rule") == "ok", "PASS").otherwise("FAIL"))


def sample_count(df: DataFrame, key: str, minimum: int, maximum: int) -> DataFrame:
    """(n, distinct_ids, duplicate_ids, status)."""
    per = df.groupBy(key).agg(F.count("*").alias("c"))
    a = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("distinct_ids"), F.count_if(F.col("c") > 1).alias("duplicate_ids"))
    status = F.when((F.col("n") < minimum) | (F.col("n") > maximum), "FAIL").when((F.col("n") == 0) | (F.col("duplicate_ids") > 0), "WARNING").otherwise("PASS")
    return a.withColumn("status", status)


def row_key(columns: Sequence[str]) -> Column:
    """A key by value of several columns; nulls equal each other and no text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def duplicates(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """(rows, groups, duplicate_rows, rate, conflicting_groups): equal feature vectors, and those with different targets."""
    key = [F.md5(F.coalesce(F.col(c).cast("string"), F.lit("\x00null"))).alias(f"k{i}") for i, c in enumerate(columns)]
    per = df.select(*key, (F.col(target) if target else F.lit(0)).alias("t")).groupBy(*[f"k{i}" for i in range(len(columns))]).agg(F.count("*").alias("c"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    a = per.agg(F.sum("c").alias("rows"), F.count_if(F.col("c") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicting_groups"))
    return a.select("rows", "groups", "duplicate_rows", q9(ratio("duplicate_rows", "rows")).alias("rate"), "conflicting_groups")


def identifier_like(df: DataFrame, columns: Sequence[str], limit: float = 0.98) -> DataFrame:
    """(column, n, distinct_values, ratio, status): WARNING where nearly every value is another."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.md5(F.col(c).cast("string")).alias("v")) for c in columns]))
    per = df.select(each.alias("x")).select("x.*").filter("v is not null").groupBy("column", "v").agg(F.count("*").alias("c"))
    a = per.groupBy("column").agg(F.sum("c").alias("n"), F.count("*").alias("distinct_values"))
    r = ratio("distinct_values", "n")
    return a.select("column", "n", "distinct_values", q9(r).alias("ratio"), F.when(r >= limit, "WARNING").otherwise("PASS").alias("status"))


def numeric_check(df: DataFrame, columns: Sequence[str], modal: float = 0.99) -> DataFrame:
    """(column, n, distinct_values, modal_share, low, high, rule): constant, near constant or varied."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    per = df.select(each.alias("x")).select("x.*").filter("v is not null").groupBy("column", "v").agg(F.count("*").alias("c"))
    a = per.groupBy("column").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.max("c").alias("top"), F.min("v").alias("low"), F.max("v").alias("high"))
    rule = F.when(F.col("d") == 1, "constant_feature").when(ratio("top", "n") >= modal, "near_constant_feature").otherwise("varied")
    return a.select("column", "n", F.col("d").alias("distinct_values"), q9(ratio("top", "n")).alias("modal_share"), q9("low").alias("low"), q9("high").alias("high"), rule.alias("rule"))


def bounds_check(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """(n, below, above, status)."""
    a = df.agg(F.count(column).alias("n"), F.count_if(F.col(column) < low).alias("below"), F.count_if(F.col(column) > high).alias("above"))
    return a.withColumn("status", F.when(F.col("below") + F.col("above") > 0, "FAIL").otherwise("PASS"))


def categorical_check(df: DataFrame, column: str, allowed: Sequence[str], rare: float = 0.01) -> DataFrame:
    """(category, n, share, rule): invalid_category, rare or ok."""
    c = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    share = ratio("n", F.sum("n").over(Window.partitionBy(F.lit(1))))  # categories, not rows
    rule = F.when(~F.col("category").isin(*allowed), "invalid_category").when(share < rare, "rare").otherwise("ok")
    return c.select("category", "n", q9(share).alias("share"), rule.alias("rule"))


def distribution_check(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, n, integer_share, modal_value, modal_share)."""
    per = df.groupBy(by, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("c"), "v"))
    r = per.withColumn("r", first)
    a = r.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v") == F.floor("v"), F.col("c")).otherwise(0)).alias("whole"), F.max(F.when(F.col("r") == 1, F.col("v"))).alias("m"), F.max(F.when(F.col("r") == 1, F.col("c"))).alias("top"))
    return a.select(by, "n", q9(ratio("whole", "n")).alias("integer_share"), q9("m").alias("modal_value"), q9(ratio("top", "n")).alias("modal_share"))


def target_check(df: DataFrame, target: str, minimum: int, share: float) -> DataFrame:
    """(label, n, p, lower, upper, rule): singleton classes, too few or too small a share."""
    everything = Window.partitionBy(F.lit(1))
    c = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("label")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(everything))
    low, high = wilson("n", "total")
    rule = F.when(F.col("n") == 1, "singleton_class").when(F.col("n") < minimum, "class_below_min_count").when(ratio("n", "total") < share, "class_below_min_proportion").otherwise("ok")
    return c.select("label", "n", q9(ratio("n", "total")).alias("p"), q9(low).alias("lower"), q9(high).alias("upper"), rule.alias("rule"))


def leakage(df: DataFrame, features: Sequence[str], target: str, support: int = 2) -> DataFrame:
    """(feature, n, equal_share, purity, cover): how often the feature equals the target, and how pure the target is within repeated values."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("v")) for f in features]))
    rows = df.select(each.alias("x"), F.col(target).cast("string").alias("t")).select("x.feature", "x.v", "t").filter("v is not null and t is not null")
    per = rows.groupBy("feature", "v", "t").agg(F.count("*").alias("c"))
    value = per.groupBy("feature", "v").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.sum(F.when(F.col("v") == F.col("t"), F.col("c")).otherwise(0)).alias("same"))
    often = F.col("n") >= support
    a = value.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum(F.when(often, F.col("n")).otherwise(0)).alias("covered"), F.sum(F.when(often, F.col("top")).otherwise(0)).alias("pure"))
    return a.select("feature", "n", q9(ratio("same", "n")).alias("equal_share"), q9(ratio("pure", "covered")).alias("purity"), q9(ratio("covered", "n")).alias("cover"))


def split_overlap(reference: DataFrame, comparison: DataFrame, key: str, features: Sequence[str], target: str) -> DataFrame:
    """(ids_in_both, rows_with_known_vector, agreeing, conflicting): rows of the comparison whose features occur in the reference."""
    ids = comparison.select(key).distinct().join(reference.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("ids_in_both"))
    vector = F.md5(framed(*[F.col(f) for f in features]))
    known = reference.select(vector.alias("v"), F.col(target).alias("t")).groupBy("v").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    met = comparison.select(vector.alias("v"), F.col(target).alias("t")).join(known, "v")
    same = (F.col("lo") == F.col("t")) & (F.col("hi") == F.col("t"))
    a = met.agg(F.count("*").alias("rows_with_known_vector"), F.count_if(same).alias("agreeing"), F.count_if(~same).alias("conflicting"))
    return ids.crossJoin(F.broadcast(a))  # one row each


def temporal_order(reference: DataFrame, comparison: DataFrame, key: str) -> DataFrame:
    """(reference_last, comparison_first, not_after, not_before, status)."""
    r = reference.agg(F.max(key).alias("reference_last"))
    c = comparison.agg(F.min(key).alias("comparison_first"))
    both = F.broadcast(r.crossJoin(c))  # one row
    late = comparison.crossJoin(both).agg(F.count_if(F.col(key) <= F.col("reference_last")).alias("not_after"))
    early = reference.crossJoin(both).agg(F.count_if(F.col(key) >= F.col("comparison_first")).alias("not_before"))
    out = r.crossJoin(c).crossJoin(late).crossJoin(early)
    return out.withColumn("status", F.when(F.col("not_after") + F.col("not_before") > 0, "WARNING").otherwise("PASS"))


#: Words of an item by which documents that may hold it are found, and items of fewer than three words, which are looked for in every document.
ANCHOR, SHORT_ITEMS = 8, 1000


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents): documents that contain an item's text whole.

    All words of an item but its first and last stand in such a document as they are, between spaces. The first ANCHOR of these (or
    as many as there are) are its anchor; runs of as many words of the documents meet it by their hash, without the texts, and only documents that
    meet an item are compared whole. Items without such words are compared with every document; more than SHORT_ITEMS of them are refused. Empty items and null texts are nowhere.
    """
    needles = items.filter("text is not null and text != ''").select("item_id", F.col("text").alias("needle"), F.split("text", " ").alias("w"))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    needles = needles.withColumn("anchor", F.transform(F.slice(inner, 1, ANCHOR), lambda w: F.xxhash64(w)))
    needles = kept(needles.select("item_id", "needle", F.size("anchor").alias("k"), F.xxhash64("anchor").alias("h")))
    lengths = [r["k"] for r in needles.select("k").distinct().collect()]  # at most ANCHOR + 1
    short = needles.filter("k = 0")
    if short.limit(SHORT_ITEMS + 1).count() > SHORT_ITEMS:
        raise ValueError(f"more than {SHORT_ITEMS} items of fewer than three words")
    texts = docs.filter("text is not null").select("doc_id", "text")
    hits = texts.join(F.broadcast(short.select("item_id", "needle")), F.contains(F.col("text"), F.col("needle"))).select("item_id", "doc_id")
    longer = [k for k in lengths if k]
    if longer:
        words = texts.withColumn("w", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))

        def runs_of(k: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.slice("w", i, k)))

        none = F.array().cast("array<bigint>")
        every = F.array_distinct(F.flatten(F.array(*[F.when(F.size("w") >= k, runs_of(k)).otherwise(none) for k in longer])))  # of numbers: by a hash set
        met = words.select("doc_id", F.explode(every).alias("h")).join(needles.filter("k > 0"), "h")
        met = met.select(F.col("doc_id").alias("met_id"), "item_id", "needle").distinct()
        found = texts.join(met, F.col("doc_id").eqNullSafe(F.col("met_id")) & F.contains(F.col("text"), F.col("needle")))
        hits = hits.unionByName(found.select("item_id", "doc_id"))
    return hits.distinct().groupBy("item_id").agg(F.count("doc_id").alias("documents"))


def overall(findings: DataFrame) -> DataFrame:
    """(status, n) and the worst status as one row (overall): FAIL before WARNING before INCONCLUSIVE before PASS."""
    worst = F.when(F.count_if(F.col("status") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("status") == "WARNING") > 0, "WARNING").when(F.count_if(F.col("status") == "INCONCLUSIVE") > 0, "INCONCLUSIVE").otherwise("PASS")
    return findings.agg(F.count("*").alias("n"), worst.alias("overall"))
