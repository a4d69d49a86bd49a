"""Canonical frames built from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pred_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary predictor of document quality by length: (sample_id, y_true, y_pred, score, confidence, lang, source)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    score = F.col("n_chars").cast("double") / (F.col("n_chars") + 500)
    rows = labels.join(docs, "doc_id").withColumn("score", score)
    return rows.select(
        F.col("doc_id").alias("sample_id"), F.col("quality").alias("y_true"), F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("y_pred"),
        "score", F.greatest(F.col("score"), 1 - F.col("score")).alias("confidence"), "lang", "source",
    )


def pred_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-class predictor of order priority: (sample_id, cust, y_true, y_pred, scores); weights come from md5, so all engines agree."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    weights = F.array(
        *[
            F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), F.col("o_orderkey").cast("string"))), 1, 4), 16, 10).cast("long")
            + F.when(F.col("o_orderpriority") == c, 30000).otherwise(0)
            for k, c in enumerate(PRIORITIES)
        ]
    )
    rows = orders.withColumn("w", weights)
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    best = F.array_position("w", F.array_max("w"))
    return rows.select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("y_true"),
        F.element_at(F.array(*map(F.lit, PRIORITIES)), best.cast("int")).alias("y_pred"),
        F.transform("w", lambda x: x.cast("double") / total).alias("scores"),
    )


def pred_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weak predictor of line prices: (sample_id, y_true, y_pred)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred"),
    )


def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before and from 2024-01-16: (event_id, ts, side, value, event_type, flag)."""
    e = table(spark, sf_dir, "events")
    side = F.when(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00")), "reference").otherwise("comparison")
    return e.select("event_id", "user_id", "ts", side.alias("side"), "value", "event_type", (F.col("value") > 100).alias("flag"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2 x 2 design over ship months: (cell, trial_key, discount, price, n)."""
    lines = table(spark, sf_dir, "lineitem")
    cell = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "CONTROL")
    cell = cell.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "A")
    cell = cell.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "B")
    cell = cell.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "AB")
    rows = lines.select(cell.alias("cell"), F.date_format("l_shipdate", "yyyy-MM").alias("trial_key"), "l_discount", "l_extendedprice")
    return rows.filter("cell is not null").groupBy("cell", "trial_key").agg(
        F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("price"), F.count("*").alias("n")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key links as a typed graph: (src, dst, relation)."""

    def links(name: str, src: str, a: str, dst: str, b: str, relation: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select(F.concat(F.lit(f"{src}:"), F.col(a).cast("string")).alias("src"), F.concat(F.lit(f"{dst}:"), F.col(b).cast("string")).alias("dst"), F.lit(relation).alias("relation"))

    out = links("nation", "region", "n_regionkey", "nation", "n_nationkey", "has_nation")
    out = out.unionByName(links("customer", "nation", "c_nationkey", "customer", "c_custkey", "has_customer"))
    out = out.unionByName(links("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "has_supplier"))
    return out.unionByName(links("orders", "customer", "o_custkey", "order", "o_orderkey", "placed"))
