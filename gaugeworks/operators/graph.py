"""A typed graph as an edge table: neighbours, bounded search, paths, components, differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import kept

MAX_DEPTH = 12
#: A node of more edges than this, and than one in HOT_SHARE of all, is hot.
HOT_EDGES, HOT_SHARE = 1000, 100_000
#: Edges of two snapshots that one task compares.
TASK_EDGES = 500_000


def oriented(edges: DataFrame, direction: str, relations: Sequence[str] = ()) -> DataFrame:
    """(a, b) to walk along: OUT, IN or BOTH, only some relations if they are named."""
    e = edges.filter(F.col("relation").isin(*relations)) if relations else edges
    out, back = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return out if direction == "OUT" else back if direction == "IN" else out.unionByName(back)


def neighbours(edges: DataFrame, node: str, direction: str = "OUT", relations: Sequence[str] = ()) -> DataFrame:
    """(node) one step away, distinct."""
    return oriented(edges, direction, relations).filter(F.col("a") == node).select(F.col("b").alias("node")).distinct()


def reach(edges: DataFrame, start: DataFrame, direction: str = "OUT", depth: int | None = MAX_DEPTH, relations: Sequence[str] = ()) -> DataFrame:
    """(node, depth): breadth-first from start(node), the start at 0, up to `depth` steps or (None) to the end. Each round joins only the new nodes."""
    walk = oriented(edges, direction, relations)
    seen, d = kept(start.select("node").distinct().withColumn("depth", F.lit(0))), 0
    while depth is None or d < depth:
        d += 1
        front = seen.filter(F.col("depth") == d - 1).select(F.col("node").alias("a"))
        new = walk.join(front, "a").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = kept(new.withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if d % 16 == 0:  # a long walk's plan stays small
            seen = kept(seen)
    return seen


def shortest_path(edges: DataFrame, a: str, b: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(step, node) of one shortest path in either direction; of equal ones, that with the least node at each step back. No rows if there is none."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(a,)], "node string")
    seen = reach(edges, start, "BOTH", depth)
    end = seen.filter(F.col("node") == b).select("depth").first()
    if end is None:
        return spark.createDataFrame([], "step int, node string")
    walk, node, rows = oriented(edges, "BOTH"), b, [(end[0], b)]
    for d in range(end[0] - 1, -1, -1):  # one node a step, at most `depth` steps
        node = walk.filter(F.col("a") == node).select(F.col("b").alias("node")).join(seen.filter(F.col("depth") == d), "node").agg(F.min("node")).first()[0]
        rows.append((d, node))
    return spark.createDataFrame(rows, "step int, node string")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outgoing, incoming)."""
    each = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return each.groupBy("x.node").agg(F.sum("x.o").alias("outgoing"), F.sum("x.i").alias("incoming"))


def _with_low(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """rows(a, b) with low(a, low, degree): nodes of very many edges, of which there are few, are joined by broadcast, so that none is one task's work."""
    limit = max(HOT_EDGES, total // HOT_SHARE)
    if total <= limit:
        return rows.join(low.drop("degree"), "a")
    hot = low.filter(F.col("degree") > limit).select("a", "low")  # at most 2 * HOT_SHARE
    cold = rows.join(F.broadcast(hot.select("a")), "a", "left_anti").join(low.drop("degree"), "a")
    return rows.join(F.broadcast(hot), "a").unionByName(cold)


def _peeled(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, rest) of edges now(a, b), a > b, each once: leaves are the edges of nodes whose only neighbour is less, so that none is the least of its component."""
    tops = now.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    below = now.select(F.col("b").alias("a"), F.lit(True).alias("below")).distinct()
    tops = kept(tops.join(below, "a", "left").withColumn("leaf", (F.col("n") == 1) & F.col("below").isNull()))
    many = kept(tops.filter("n > 1").select("a"))
    rest = kept(tops.filter("n = 1 and not leaf").select("a", "b").unionByName(now.join(many, "a", "left_semi")))
    return tops.filter("leaf").select("a", "b"), rest


def _with_leaves(found: DataFrame, leaves: DataFrame, total: int) -> DataFrame:
    """found(node, component) with leaves(a, b), and with those b that are in no edge but theirs."""
    size = leaves.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("degree"))
    core = size.join(found.withColumnRenamed("node", "a"), "a", "left")
    low = kept(core.select("a", F.coalesce("component", "a").alias("low"), "degree", F.col("component").isNull().alias("alone")))
    hung = _with_low(leaves.select(F.col("b").alias("a"), F.col("a").alias("b")), low.drop("alone"), total)
    return found.unionByName(low.filter("alone").select(F.col("a").alias("node"), F.col("low").alias("component"))).unionByName(hung.select(F.col("b").alias("node"), F.col("low").alias("component")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least reachable node, by moving stars to larger and smaller nodes in turn until all edges are stars.

    Nodes whose only neighbour is less take its component at the end: while they are at least half of the edges, they
    are taken away, and only what is left goes through the rounds.
    As every round keeps what is connected, a graph in which each node points to one other, and that to none, has come to its end.
    """
    now = kept(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a != b").distinct())
    total, hung = now.count(), []
    while total:
        leaves, rest = _peeled(now)
        left = rest.count()
        hung.append((leaves, total))
        now, before, total = rest, total, left
        if 2 * left > before:
            break
    found = _stars(now, total)
    for leaves, count in reversed(hung):
        found = _with_leaves(found, leaves, count)
    return found


def _stars(now: DataFrame, total: int) -> DataFrame:
    while total:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("degree"))
        large = _with_low(both.filter("b > a"), low, total).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree"))
        moved = _with_low(large, least, total).filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = kept(moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        if now.groupBy("a").count().filter("count > 1").isEmpty() and now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        total = now.count()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, relation, change): edges added and removed between snapshots, each once; nulls are equal.

    Both snapshots are dealt by edge over so many tasks that each holds TASK_EDGES of them, about, whatever
    their number; edges that repeat take no more memory. Nothing is made distinct before, where a task's memory would grow with its part of a file.
    """
    key, spark = ["src", "dst", "relation"], old.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((old.count() + new.count()) / TASK_EDGES))
    both = old.select(*key, F.lit(True).alias("old")).unionByName(new.select(*key, F.lit(False).alias("old")))
    sides = both.repartition(tasks, *key).groupBy(*key).agg(F.bool_or("old").alias("was"), F.bool_and("old").alias("only"))
    return sides.filter(F.col("was") == F.col("only")).select(*key, F.when(F.col("was"), "removed").otherwise("added").alias("change"))


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): ends of edges that no node row has."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes, "node", "left_anti")


def blocked(depends: DataFrame, failed: DataFrame) -> DataFrame:
    """(node, depth): units that can't run since something they depend on, however far, failed. depends(src needs dst)."""
    walk = depends.select("src", "dst", F.lit("needs").alias("relation"))
    return reach(walk, failed, "IN", depth=None).filter("depth > 0")
