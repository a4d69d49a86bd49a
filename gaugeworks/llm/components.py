"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A node of more edges than this, and than one in HOT_SHARE of all, is joined by broadcast: there are few such nodes.
HOT_EDGES, HOT_SHARE = 1000, 100_000
#: Fewer edges than this go through the rounds with their leaves: to take these away costs a write more than a round.
PEEL_EDGES = 10_000


def _with_low(edges: DataFrame, low: DataFrame, hot_edges: int) -> DataFrame:
    """edges(a, b) with column low of low(a, low, degree), never all edges of a hot node, which has more than hot_edges (0: there is none), in one task.

    At most 2 * HOT_SHARE nodes are hot, whatever the graph.
    """
    if not hot_edges:
        return edges.join(low.drop("degree"), "a")
    hot = low.filter(F.col("degree") > hot_edges).select("a", "low")
    cold = edges.join(F.broadcast(hot.select("a")), "a", "left_anti").join(low.drop("degree"), "a")
    return edges.join(F.broadcast(hot), "a").unionByName(cold)


def _nodes(now: DataFrame) -> DataFrame:
    """(node, up, degree, other) of edges(a, b), a > b, each once: how many of its edges lead to less, how many it has, and the least other end."""
    up, down = (F.struct(F.col(x).alias("node"), F.lit(n).alias("up"), F.col(y).alias("other")) for x, n, y in (("a", 1, "b"), ("b", 0, "a")))
    return now.select(F.inline(F.array(up, down))).groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("degree"), F.min("other").alias("other"))


#: A node whose only neighbour is less: never the least of its component, and no way to others.
LEAF = "up = 1 and degree = 1"


def _state(now: DataFrame) -> tuple[int, int, int, int]:
    """(edges, most edges of a node, nodes whose stars must still be moved, leaves): none of the third, if each node points to one other, and that to none."""
    moving = (F.col("up") > 1) | (F.col("up") == 1) & (F.col("degree") > 1)
    zero = F.lit(0)
    return tuple(_nodes(now).agg(F.coalesce(F.sum("up"), zero), F.coalesce(F.max("degree"), zero), F.count_if(moving), F.count_if(F.expr(LEAF))).first())


def _hung(leaves: DataFrame, found: DataFrame, hot_edges: int) -> DataFrame:
    """(a, b) of leaves(a, b) with b's component by found(a, b), which lacks the least nodes of components."""
    at, known = leaves.select("a", F.col("b").alias("at")), found.select(F.col("a").alias("at"), "b")
    own = F.coalesce("b", "at").alias("b")
    if not hot_edges:
        return at.join(known, "at", "left").select("a", own)
    hot = at.groupBy("at").agg(F.count("*").alias("leaves")).filter(F.col("leaves") > hot_edges).select("at")
    placed = F.broadcast(hot.join(known, "at", "left").select("at", own))
    return at.join(placed, "at").select("a", "b").unionByName(at.join(F.broadcast(hot), "at", "left_anti").join(known, "at", "left").select("a", own))


def _large_star(edges: DataFrame, hot_edges: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("degree"))
    return _with_low(both.filter("b > a"), low, hot_edges).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame, hot_edges: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree"))
    moved = _with_low(down, low, hot_edges).filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): component is the least node reachable.

    Stars are moved towards the least neighbour, in turn to larger and to
    smaller nodes, until all edges are stars: O(log^2 n) rounds; no further one confirms it. No node's
    neighbours are gathered in one place: minima are aggregated before the
    shuffle, and the few nodes of very many edges, if there are any, are broadcast (see _with_low). Each round's edges are
    written to the shared folder, which cuts the lineage, and the round before
    is deleted. Where at least a quarter of many edges are those of leaves, these are taken away instead of
    a round and get their components at the end, so that settled edges aren't joined in every round. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    clean = edges.filter("a is not null and b is not null and a != b").select("a", "b")
    path = common.scratch(spark, "edges")
    clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(path)
    schema, hung = "a long, b long", []
    while True:
        now = spark.read.schema(schema).parquet(path)
        total, most, moving, leaves = _state(now)
        if not moving:
            break
        limit = max(HOT_EDGES, total // HOT_SHARE)
        hot_edges = limit if most > limit else 0
        old, path = path, common.scratch(spark, "edges")
        if total >= PEEL_EDGES and 4 * leaves >= total:
            apart = common.stored(_nodes(now).filter(LEAF).select(F.col("node").alias("a"), F.col("other").alias("b")), "leaves")
            hung.append((apart, hot_edges))
            now.join(apart, ["a", "b"], "left_anti").write.parquet(path)
        else:
            _small_star(_large_star(now, hot_edges).distinct(), hot_edges).distinct().write.parquet(path)
        common.remove(spark, old)
    found = [path]
    for apart, hot_edges in reversed(hung):
        path = common.scratch(spark, "edges")
        _hung(apart, spark.read.schema(schema).parquet(*found), hot_edges).write.parquet(path)
        found.append(path)
    now = spark.read.schema(schema).parquet(*found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
