"""Running sums and numbers over a global order, without a task that holds all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary
    folder serves a local master, and any other master is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gaugeworks-")
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: partition contents are then fixed, and the lineage is cut."""
    path = f"{shared(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column], by: Sequence[str] = (), following: Mapping[str, str] | None = None) -> DataFrame:
    """df with, for each name of `sums`, the sum of its column over the rows before in order, within `by`; and for each
    name of `following`, its column's value in the next row (a column that ascends with the order).

    Rows are cut into ranges of (by, order), each summed on its own. What lies
    before a range is a sum of range totals: one row a range, plus one for each
    group that crosses a border. Rows equal in order share a range, in any order.
    """
    following = following or {}
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = kept(df.withColumns({f"__{k}": c for k, c in sums.items()}).repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "__part").orderBy(*order)
    first = {f"__first_{k}": F.min(c) for k, c in following.items()}
    totals = placed.groupBy(*by, "__part").agg(F.count("*").alias("__rows"), *[F.sum(f"__{k}").alias(f"__{k}") for k in sums], *[c.alias(k) for k, c in first.items()])
    across = Window.partitionBy(*by).orderBy("__part")  # a row for each range
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = totals.select(
        *by, "__part", *[F.sum(f"__{k}").over(before).alias(f"__before_{k}") for k in sums], *[F.lead(k).over(across).alias(k) for k in first],
        F.count("*").over(Window.partitionBy(*by)).alias("__ranges"),
    ).filter("__ranges > 1").drop("__ranges")
    local = {k: F.coalesce(F.sum(f"__{k}").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k in sums}
    out = placed.withColumns(local | {k: F.lead(c).over(inside) for k, c in following.items()})
    out = out.join(F.broadcast(edges), [*by, "__part"], "left")  # at most two rows for each range
    out = out.withColumns({k: F.col(k) + F.coalesce(f"__before_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(k, f"__first_{k}") for k in following})
    return out.select(*df.columns, *sums, *following)
