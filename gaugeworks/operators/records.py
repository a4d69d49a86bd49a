"""Keyed joins, set operations, paging and coverage over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..status import q9, ratio


def outer_deltas(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, base, treated, delta, relative, side): full outer by key; a missing side gives no delta."""
    j = a.select(key, F.col(value).alias("base")).join(b.select(key, F.col(value).alias("treated")), key, "full_outer")
    d = F.col("treated") - F.col("base")
    side = F.when(F.col("treated").isNull(), "only_base").when(F.col("base").isNull(), "only_treated").otherwise("both")
    return j.select(key, q9("base").alias("base"), q9("treated").alias("treated"), q9(d).alias("delta"), q9(F.try_divide(d, F.abs("base"))).alias("relative"), side.alias("side"))


def latest(df: DataFrame, key: Sequence[str], order: str, keep: Sequence[str]) -> DataFrame:
    """The row of greatest order of each key, by aggregation; ties go to the greatest of the kept columns."""
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in keep if c != order])).alias("best")
    return df.groupBy(*key).agg(best).select(*key, "best.*")


def attempts(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with attempt: 1, 2, ... of each key in order."""
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in key order; at most 500 a page."""
    return df.orderBy(key).offset(offset).limit(min(limit, 500))


def examples(df: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """(by, n, examples): count and the least `limit` keys of each group; no group is gathered."""
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= limit, F.col(key)))), ",").alias("examples"))


def coverage(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(status, n): planned units by what became of them; NOT_RUN without a record."""
    j = planned.select(*keys).distinct().join(done.select(*keys, "status"), list(keys), "left")
    return j.groupBy(F.coalesce("status", F.lit("NOT_RUN")).alias("status")).agg(F.count("*").alias("n"))


def factorial(*levels: DataFrame) -> DataFrame:
    """All combinations of a few small level tables: the plan of a design, not a join of data."""
    out = levels[0]
    for x in levels[1:]:
        out = out.crossJoin(F.broadcast(x))
    return out


def set_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(value, found): only_in_a, only_in_b or both."""
    x = a.select(F.col(column).alias("value")).distinct().withColumn("a", F.lit(True))
    y = b.select(F.col(column).alias("value")).distinct().withColumn("b", F.lit(True))
    j = x.join(y, "value", "full_outer")
    return j.select("value", F.when(F.col("b").isNull(), "only_in_a").when(F.col("a").isNull(), "only_in_b").otherwise("both").alias("found"))


def jaccard(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(both, either, jaccard); 1 for two empty sets."""
    c = set_difference(a, b, column).agg(F.count_if(F.col("found") == "both").alias("both"), F.count("*").alias("either"))
    return c.select("both", "either", q9(F.when(F.col("either") == 0, 1.0).otherwise(ratio("both", "either"))).alias("jaccard"))


def compare_documents(a: DataFrame, b: DataFrame, key: str, value: str, relative: float = 1e-6) -> DataFrame:
    """(outcome, n): EQUAL, APPROX, DIFFERENT or INCOMPARABLE for each key."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full_outer")
    near = F.abs(F.col("x") - F.col("y")) <= F.greatest(relative * F.greatest(F.abs("x"), F.abs("y")), F.lit(1e-9))
    o = F.when(F.col("x").isNull() | F.col("y").isNull(), "INCOMPARABLE").when(F.col("x") == F.col("y"), "EQUAL").when(near, "APPROX").otherwise("DIFFERENT")
    return j.groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the value of the last right row at or before its time, by key: one union and one window, no range join."""
    tagged = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    other = right.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.unionByName(other).withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_v")
