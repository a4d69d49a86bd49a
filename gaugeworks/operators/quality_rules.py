"""Rules of data quality whose limits are parameters: each gives the violations it finds, in one form.

(check, subject, rule, level, affected, observed, configured): level is FAIL or WARNING, affected the rows or values concerned, observed and configured the
figure and its limit (null where a rule has none). No violation, no row; statuses() says what that means for each check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..status import q9, ratio
from .data_quality import cell_class

#: Worst first.
LATTICE = ("FAIL", "WARNING", "INCONCLUSIVE", "UNAVAILABLE", "NOT_APPLICABLE", "PASS")


def violation(check: str, subject: Column, rule: str, level: str, affected: Column, observed: Column | None = None, configured: float | None = None) -> list[Column]:
    seen = F.lit(None).cast("double") if observed is None else q9(observed)
    return [
        F.lit(check).alias("check"), subject.cast("string").alias("subject"), F.lit(rule).alias("rule"), F.lit(level).alias("level"), affected.cast("long").alias("affected"),
        seen.alias("observed"), F.lit(configured).cast("double").alias("configured"),
    ]


def _together(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def missing_rules(df: DataFrame, kinds: Mapping[str, str], max_feature_rate: float, max_row_rate: float) -> DataFrame:
    """Features missing in too many rows, and rows that lack too many features; one pass."""
    gone = {f: cell_class(F.col(f).cast("string"), k) == "missing" for f, k in kinds.items()}
    lacking = sum((g.cast("int") for g in gone.values()), F.lit(0))
    a = df.agg(F.count("*").alias("n"), F.count_if(ratio(lacking, F.lit(len(kinds))) > max_row_rate).alias("rows"), *[F.count_if(g).alias(f"m_{f}") for f, g in gone.items()])
    each = a.select("n", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("k")) for f in kinds])))
    rate = ratio("k", "n")
    features = each.filter(rate > max_feature_rate).select(*violation("missingness", F.col("feature"), "feature_missing_rate_exceeded", "FAIL", F.col("k"), rate, max_feature_rate))
    rows = a.filter("rows > 0").select(*violation("missingness", F.lit("rows"), "row_missing_rate_exceeded", "FAIL", F.col("rows"), ratio("rows", "n"), max_row_rate))
    return features.unionByName(rows)


def identifier_rules(df: DataFrame, key: str, signature: Sequence[str], unique: bool = True) -> DataFrame:
    """Ids that are missing, occur more than once, or do so with different values of the signature's columns."""
    level = "FAIL" if unique else "WARNING"
    text = F.col(key).cast("string")
    gone = cell_class(text, "CATEGORICAL") == "missing"
    said = F.xxhash64(F.to_json(F.struct(*signature), {"ignoreNullFields": "false"}))
    per = df.select(F.when(~gone, text).alias("k"), said.alias("s")).groupBy("k").agg(F.count("*").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    twice, torn = F.col("k").isNotNull() & (F.col("c") > 1), F.col("k").isNotNull() & (F.col("lo") != F.col("hi"))
    rows = lambda w: F.coalesce(F.sum(F.when(w, F.col("c"))), F.lit(0))
    a = per.agg(rows(twice).alias("twice"), F.count_if(twice).alias("groups"), rows(torn).alias("torn"), F.count_if(torn).alias("torn_groups"), rows(F.col("k").isNull()).alias("gone"))
    return _together([
        a.filter("twice > 0").select(*violation("identifiers", F.lit(key), "duplicate_ids", level, F.col("twice"), F.col("groups"))),
        a.filter("torn > 0").select(*violation("identifiers", F.lit(key), "conflicting_rows_share_id", level, F.col("torn"), F.col("torn_groups"))),
        a.filter("gone > 0").select(*violation("identifiers", F.lit(key), "missing_ids", "WARNING", F.col("gone"))),
    ])


def _value_counts(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(feature, kind, class, v, c): how often each value occurs, all features in one pass; v only for valid cells."""
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(k).alias("kind"), cell_class(F.col(f).cast("string"), k).alias("class"), F.lower(F.trim(F.col(f).cast("string"))).alias("low"), F.col(f).cast("string").alias("v")) for f, k in kinds.items()]
    each = df.select(F.inline(F.array(*cells)))
    valid = F.col("class") == "valid"
    value = F.when(valid & (F.col("kind") == "NUMERIC"), F.expr("cast(try_cast(low as double) as string)")).when(valid & (F.col("kind") == "BOOLEAN"), F.when(F.col("low").isin("true", "1"), "true").otherwise("false")).when(valid, F.col("v"))
    return each.select("feature", "kind", "class", value.alias("v")).groupBy("feature", "kind", "class", "v").agg(F.count("*").alias("c"))


def categorical_rules(df: DataFrame, kinds: Mapping[str, str], allowed: Mapping[str, Sequence[str]] | None = None, rare: float | None = None, max_cardinality: int | None = None) -> DataFrame:
    """Cells of the wrong type, categories that aren't allowed, rare ones and too many of them, for features of kind CATEGORICAL or BOOLEAN."""
    counts = _value_counts(df, {f: k for f, k in kinds.items() if k != "NUMERIC"})
    bad = counts.filter(F.col("class").isin("invalid", "nonfinite")).groupBy("feature").agg(F.sum("c").alias("c"))
    out = [bad.select(*violation("categorical", F.col("feature"), "invalid_type", "FAIL", F.col("c")))]
    valid = counts.filter("class = 'valid'")
    total = valid.groupBy("feature").agg(F.sum("c").alias("n"), F.count("*").alias("d"))  # a row a feature
    met = valid.join(F.broadcast(total), "feature")
    if allowed:
        named = F.lit(False)
        for f, values in allowed.items():
            named = named | ((F.col("feature") == f) & ~F.col("v").isin(*values))
        wrong = met.filter(named).groupBy("feature").agg(F.sum("c").alias("c"), F.count("*").alias("k"))
        out.append(wrong.select(*violation("categorical", F.col("feature"), "invalid_category", "FAIL", F.col("c"), F.col("k"))))
    if rare is not None:
        few = met.filter(ratio("c", "n") < rare).groupBy("feature").agg(F.sum("c").alias("c"), F.count("*").alias("k"))
        out.append(few.select(*violation("categorical", F.col("feature"), "rare_categories", "WARNING", F.col("c"), F.col("k"), rare)))
    if max_cardinality is not None:
        out.append(total.filter(F.col("d") > max_cardinality).select(*violation("categorical", F.col("feature"), "cardinality_exceeded", "FAIL", F.col("n"), F.col("d"), max_cardinality)))
    return _together(out)


def distribution_rules(df: DataFrame, kinds: Mapping[str, str], max_skew: float, max_modal: float, min_distinct: int) -> DataFrame:
    """Numbers of too much skew, values that dominate, and features of too few distinct values. A feature without valid values is INCONCLUSIVE (rule no_valid_values).

    Moments are those of the population, summed over distinct values about their mean.
    """
    counts = _value_counts(df, kinds)
    valid = counts.filter("class = 'valid'").withColumn("x", F.when(F.col("kind") == "NUMERIC", F.col("v").try_cast("double")))
    total = valid.groupBy("feature", "kind").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.max("c").alias("top"), (F.sum(F.col("c") * F.col("x")) / F.sum(F.when(F.col("x").isNotNull(), F.col("c")))).alias("m"))
    dev = valid.join(F.broadcast(total.select("feature", "m")), "feature").withColumn("e", F.col("x") - F.col("m"))  # a row a feature
    moment = dev.groupBy("feature").agg(F.sum(F.col("c") * F.pow("e", 2)).alias("s2"), F.sum(F.col("c") * F.pow("e", 3)).alias("s3"))
    a = total.join(moment, "feature")
    skew = F.when((F.col("kind") == "NUMERIC") & (F.col("s2") > 0), (F.col("s3") / F.col("n")) / F.pow(F.col("s2") / F.col("n"), 1.5))
    modal = ratio("top", "n")
    named = F.array(*map(F.lit, kinds))
    none = df.sparkSession.range(1).select(F.explode(named).alias("feature")).join(total.select("feature"), "feature", "left_anti")
    return _together([
        a.withColumn("skew", skew).filter(F.abs("skew") > max_skew).select(*violation("distribution", F.col("feature"), "skew_exceeds_configured", "WARNING", F.col("n"), F.col("skew"), max_skew)),
        a.filter(modal > max_modal).select(*violation("distribution", F.col("feature"), "dominant_value", "WARNING", F.col("top"), modal, max_modal)),
        a.filter(F.col("d") < min_distinct).select(*violation("distribution", F.col("feature"), "few_distinct_values", "WARNING", F.col("n"), F.col("d"), min_distinct)),
        none.select(*violation("distribution", F.col("feature"), "no_valid_values", "INCONCLUSIVE", F.lit(0))),
    ])


def target_rules(df: DataFrame, target: str, max_missing: float, min_count: int, min_share: float, allowed: Sequence[str] | None = None, regression: bool = False) -> DataFrame:
    """Targets that are missing, of another type or not finite; for classes also singletons, rare and unknown ones. The target is a text cell."""
    state = cell_class(F.col(target).cast("string"), "NUMERIC")
    a = df.agg(F.count("*").alias("n"), *[F.count_if(state == s).alias(s) for s in ("missing", "valid", "nonfinite", "invalid")])
    name, rate = F.lit("target"), ratio("missing", "n")
    out = [
        a.filter("missing > 0").select(*violation("target", name, "missing_targets", "WARNING", F.col("missing"))),
        a.filter(rate > max_missing).select(*violation("target", name, "missing_target_rate_exceeded", "FAIL", F.col("missing"), rate, max_missing)),
    ]
    if regression:
        out += [
            a.filter("invalid > 0").select(*violation("target", name, "non_numeric_target", "FAIL", F.col("invalid"))),
            a.filter("nonfinite > 0").select(*violation("target", name, "nonfinite_target", "WARNING", F.col("nonfinite"))),
        ]
        return _together(out)
    both = F.least(F.col("invalid"), F.col("valid"))  # numbers and words in one target
    out += [
        a.filter(both > 0).select(*violation("target", name, "inconsistent_target_types", "FAIL", both)),
        a.filter("nonfinite > 0").select(*violation("target", name, "nonfinite_target", "FAIL", F.col("nonfinite"))),
    ]
    keyed = df.filter(state.isin("valid", "invalid")).groupBy(F.trim(F.col(target).cast("string")).alias("label")).agg(F.count("*").alias("c"))
    if allowed is not None:
        wrong = keyed.filter(~F.col("label").isin(*allowed)).agg(F.sum("c").alias("c"), F.count("*").alias("k")).filter("k > 0")
        out.append(wrong.select(*violation("target", name, "invalid_target_value", "FAIL", F.col("c"), F.col("k"))))
    total = keyed.agg(F.sum("c").alias("n"))
    met = keyed.crossJoin(F.broadcast(total))  # one row
    subject = F.concat(F.lit("class:"), F.col("label"))
    share = ratio("c", "n")
    out += [
        keyed.filter("c = 1").select(*violation("target", subject, "singleton_class", "WARNING", F.col("c"))),
        keyed.filter(F.col("c") < min_count).select(*violation("target", subject, "class_below_min_count", "FAIL", F.col("c"), F.col("c"), min_count)),
        met.filter(share < min_share).select(*violation("target", subject, "class_below_min_proportion", "FAIL", F.col("c"), share, min_share)),
    ]
    return _together(out)


def statuses(violations: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """(check, violations, status) of each check, and all together (check '(all)'): the worst level found, PASS without any.

    checks says by name whether a check was RUN, had no data to run on (UNAVAILABLE) or nothing that it applies to (NOT_APPLICABLE).
    """
    spark = violations.sparkSession
    stated = spark.createDataFrame([(c, s) for c, s in checks.items()], "check string, state string")
    order = F.array(*map(F.lit, LATTICE))
    found = violations.groupBy("check").agg(F.count("*").alias("violations"), F.min(F.array_position(order, F.col("level"))).alias("worst"))
    own = F.when(F.col("state") != "RUN", F.array_position(order, F.col("state"))).otherwise(F.coalesce("worst", F.lit(len(LATTICE))))
    each = stated.join(found, "check", "left").select("check", F.coalesce("violations", F.lit(0)).alias("violations"), own.alias("place"))
    every = each.agg(F.lit("(all)").alias("check"), F.sum("violations").alias("violations"), F.min("place").alias("place"))
    return each.unionByName(every).select("check", "violations", F.element_at(order, F.col("place").cast("int")).alias("status"))
