"""Exact order statistics without a task that holds a group's values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import kept

#: Values of a group that one task may order, and ranges that a group's values are cut into while there are more.
LIMIT, RANGES = 1_000_000, 64


def order_statistics(df: DataFrame, value: str, ranks: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, a column for each rank): the values at ranks from 0, given as columns of n, the group's number of values.

    Nulls and NaN are left out. Values are counted in ranges between sketched quantiles of their group; only the
    ranges that hold an asked rank go on, and are cut again while they have more than LIMIT values and more
    than one. What is left is ordered: no task orders more than LIMIT values, however many are equal. A rank beyond the group's values is null.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null and not isnan(__v)")
    size = kept(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()])).alias("t")
    wanted = size.select(*by, F.lit(0).cast("long").alias("__range"), F.col("n").alias("__count"), "__lo", "__hi", asked)
    wanted = wanted.select(*by, "__range", "__count", "__lo", "__hi", "t.name", "t.rank").filter(F.col("rank").between(0, F.col("__count") - 1))
    rows = rows.withColumn("__range", F.lit(0).cast("long"))
    key = [*by, "__range"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        joined = left.alias("a").join(right.alias("b"), condition, how)
        return joined if how == "left_semi" else joined.drop(*[F.col(f"b.{c}") for c in key])

    done = None
    while True:
        settled = wanted.filter("__lo = __hi").select(*by, "name", F.col("__lo").alias("__value"))  # equal values need no order
        done = settled if done is None else done.unionByName(settled)
        wanted = kept(wanted.filter("__lo < __hi"))
        most = wanted.agg(F.max("__count")).first()[0]
        if most is None or most <= LIMIT:
            break
        open_ranges = wanted.select(*key).distinct()
        rows = kept(meet(rows, open_ranges, "left_semi"))
        steps = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
        cuts = kept(rows.groupBy(*key).agg(F.array_distinct(F.percentile_approx("__v", steps, F.lit(10 * RANGES))).alias("__cuts")))
        # a cut ends its range, and its own value is a range by itself, so that equal values settle
        at = 2 * F.size(F.filter("__cuts", lambda c: c < F.col("__v"))) + F.array_contains("__cuts", F.col("__v")).cast("int")
        placed = meet(rows, cuts, "inner").withColumn("__to", F.col("__range") * (2 * RANGES) + at).drop("__cuts")
        counts = kept(placed.groupBy(*key, "__to").agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")))
        before = Window.partitionBy(*key).orderBy("__to").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        met = meet(wanted, counts, "inner").filter((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__n")))
        wanted = met.select(*by, F.col("__to").alias("__range"), F.col("__n").alias("__count"), F.col("__low").alias("__lo"), F.col("__high").alias("__hi"), "name", (F.col("rank") - F.col("__before")).alias("rank"))
        rows = placed.withColumn("__range", F.col("__to")).drop("__to")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("__v")) - 1
    placed = meet(rows, wanted.select(*key).distinct(), "left_semi").withColumn("__at", number.cast("long"))
    found = meet(wanted.withColumnRenamed("rank", "__rank"), placed, "inner").filter("__at = __rank").select(*by, "name", F.col("__v").alias("__value"))
    values = done.unionByName(found).groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("__value"))).alias(k) for k in ranks])
    return beside(size.select(*by, "n"), values, by)


def beside(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """a with b's other columns: one row a group in each, nulls of a group's name equal."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row each
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.alias("a").join(b.alias("b"), condition, "left").drop(*[F.col(f"b.{c}") for c in by])


def quantiles(df: DataFrame, value: str, at: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, a column for each name): type-7 quantiles, between the two values next to (n - 1) * level."""
    ranks, out = {}, []
    for k, (name, level) in enumerate(at.items()):
        place = (F.col("n") - 1) * F.lit(float(level))
        ranks |= {f"__l{k}": F.floor(place), f"__h{k}": F.ceil(place)}
        out.append((F.col(f"__l{k}") + (place - F.floor(place)) * (F.col(f"__h{k}") - F.col(f"__l{k}"))).alias(name))
    return order_statistics(df, value, ranks, by).select(*by, "n", *out)


def nearest_ranks(df: DataFrame, value: str, at: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, a column for each name): the least value that at least the level's share of the values doesn't exceed."""
    ranks = {k: F.greatest(F.ceil(F.col("n") * F.lit(float(level)) - 1e-9), F.lit(1)) - 1 for k, level in at.items()}
    return order_statistics(df, value, ranks, by).select(*by, "n", *at)
