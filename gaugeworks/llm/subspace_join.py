"""Near-duplicate embeddings by a pigeonhole join over subspaces (operator 12)."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected

#: Cosine from which two vectors link.
THRESHOLD = 0.98
#: Dimensions of a block, roughly.
BLOCK = 8
#: Coordinates are kept as whole numbers of this part of the unit length.
SCALE = 1 << 14
#: Vectors a cell of a label's block is to hold, roughly; cells of more rows than PART are cut into parts that meet pair by pair.
LEAF, PART = 1024, 4096
#: Vectors of which the cells' borders are taken. They decide where vectors meet, not which link.
SAMPLE = 10_000
#: Rows compared at once, and candidates verified at once.
STRIP, CHECKED = 256, 16_384


@functools.cache
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions: what two vectors differ by then spreads over all blocks alike."""
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[tuple[int, int]]:
    """Where each block of dimensions begins and ends."""
    cuts = np.linspace(0, d, max(1, round(d / BLOCK)) + 1).round().astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def budget(d: int, block: tuple[int, int], threshold: float) -> float:
    """Most that linked unit vectors can differ by, squared and in units of SCALE, in the block that is within its share.

    Vectors that link differ by 2 - 2 * threshold at most, squared; in one block at least
    they differ by no more than the block's share of that by its dimensions. Rounding to whole numbers adds at most
    one in each dimension.
    """
    k = block[1] - block[0]
    return (math.sqrt((2 - 2 * threshold) * k / d) * SCALE * (1 + 1e-9) + math.sqrt(k)) ** 2


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles, each scaled to a largest component of 1."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return values / np.abs(values).max(1, keepdims=True)


def _rotated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column("d").to_numpy()
        for d in np.unique(size):
            some = batch.filter(pa.array(size == d))
            v = matrix(some.column("embedding"))
            q = np.rint(v / np.linalg.norm(v, axis=1, keepdims=True) @ rotation(int(d)) * SCALE).astype("<i2")
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([row.tobytes() for row in q], pa.binary())], names=[*some.schema.names, "q"])


def _visits(q: np.ndarray, cuts: np.ndarray, bits: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of one block: each row in its own cell, and in those of a greater number that its budget reaches.

    A cell is a box between quartiles: the first bits cut each dimension at its
    median, further ones again at its quarters. Of two rows within the budget,
    one visits the other's cell or both are at home in it, once.
    """
    n, k = q.shape
    row, cell, home, left = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, limit)
    for i in range(min(bits, k)):
        edges = cuts[:, i] if bits > k + i else cuts[1:2, i]
        x = q[:, i].astype(np.float64)
        own = np.searchsorted(edges, x, "right")
        home = home * (len(edges) + 1) + own
        parts = []
        for j in range(len(edges) + 1):
            gap = np.where(j > own, edges[j - 1] - x if j else 0, np.where(j < own, x - edges[j] if j < len(edges) else 0, 0))[row]
            reach = gap * gap <= left
            parts.append((row[reach], cell[reach] * (len(edges) + 1) + j, (left - gap * gap)[reach]))
        row, cell, left = (np.concatenate(x) for x in zip(*parts))
    keep = cell >= home[row]
    return row[keep], cell[keep], cell[keep] == home[row[keep]]


def _placed(cuts: dict[int, np.ndarray], threshold: float, names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, bits = batch.column("d").to_numpy(), batch.column("bits").to_numpy()
            for d, b in sorted({*zip(size.tolist(), bits.tolist())}):
                some = batch.filter(pa.array((size == d) & (bits == b)))
                q = np.frombuffer(b"".join(some.column("q").to_pylist()), "<i2").reshape(-1, d)
                for k, (at, to) in enumerate(blocks(d)):
                    quartiles = cuts[d][:, at:to] if d in cuts else np.zeros((3, to - at))
                    row, cell, home = _visits(q[:, at:to], quartiles, b, budget(d, (at, to), threshold))
                    found = {"block": pa.array(np.full(len(row), k, np.int32)), "cell": pa.array(cell), "home": pa.array(home)}
                    taken = some.select([c for c in names if c not in found]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([found[c] if c in found else taken.column(c) for c in names], names=names)

    return run


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number of each component after edges (i, j) are added."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        to = np.arange(len(root))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to != (up := to[to])).any():
            to = up
        root = to[root]
    return root


def _within(q: np.ndarray, i: np.ndarray, j: np.ndarray, block: tuple[int, int], limit: float) -> np.ndarray:
    gap = q[i, block[0] : block[1]].astype(np.int64) - q[j, block[0] : block[1]]
    return (gap * gap).sum(1) <= limit


def _compared(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        d, b = table.column("d")[0].as_py(), table.column("block")[0].as_py()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        home, part = table.column("home").to_numpy(), table.column("part").to_numpy()
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), "<i2").reshape(-1, d)
        v = matrix(table.column("embedding").combine_chunks())
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        every = blocks(d)
        limits = [budget(d, x, threshold) for x in every]
        mine = q[:, every[b][0] : every[b][1]].astype(np.float64)  # whole numbers: sums of their products are exact
        square = (mine * mine).sum(1)
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for k in range(0, len(left), STRIP):
            a = left[k : k + STRIP]
            near = square[a][:, None] + square[right][None, :] - 2 * (mine[a] @ mine[right].T) <= limits[b]
            near &= home[a][:, None] | home[right][None, :]
            if low == high:
                near &= a[:, None] < right[None, :]
            x, y = np.nonzero(near)
            x, y = a[x], right[y]
            for s in range(0, len(x), CHECKED):
                i, j = x[s : s + CHECKED], y[s : s + CHECKED]
                for e in range(b):  # an earlier block that is within its share has the pair
                    fresh = ~_within(q, i, j, every[e], limits[e])
                    i, j = i[fresh], j[fresh]
                same = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
                i, j = i[same], j[same]
                links += np.bincount(i, weight[j], len(node)).astype(np.int64) + np.bincount(j, weight[i], len(node)).astype(np.int64)
                root = _merge(root, i, j)
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]), "root": pa.array(node[root[some]])})

    return run


def usable() -> Column:
    """Whether a row can link at all."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label): those of one label and length whose cosine is threshold or more link.

    Equal vectors of a label are taken once, with their number. Unit vectors are rotated and cut into
    blocks of about BLOCK dimensions; of two that link, one block at least differs by no more
    than its share of the squared distance. In each block vectors are dealt to cells, boxes of its
    space as fine as the label is large, and visit the neighbouring cells within the budget; what meets there
    is compared in that block, and then exactly, in doubles, if no earlier block has the
    pair already. So each pair is verified once. A task gives the links of each vector and a
    spanning forest, never pairs. Crowded cells are cut into parts of about PART rows, each pair of
    which is a group of its own: no group holds more than about two parts. The work for vectors that
    all lie near each other grows with their square, as every pair must be counted.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components link
    with nothing: n_links 0, component_id their own vec_id, kept. Repeated vec_ids are rows like others, with
    a result each; null ids link but are never a component's least id, unless there is no other. No rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("usable", usable())
    classes = rows.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = classes.withColumns({"d": F.size("embedding"), "node": F.monotonically_increasing_id()})
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    classes = common.stored(classes.mapInArrow(_rotated, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", q binary"), "subspace-classes")
    sample = classes.select("d", "q", F.xxhash64("node").alias("at")).orderBy("at", "q").limit(SAMPLE).select("d", "q").toArrow()
    size, cuts = sample.column("d").to_numpy(), {}
    for d in np.unique(size).tolist():
        q = np.frombuffer(b"".join(sample.filter(pa.array(size == d)).column("q").to_pylist()), "<i2").reshape(-1, d)
        cuts[d] = np.quantile(q, [0.25, 0.5, 0.75], axis=0)
    sizes = classes.groupBy("label", "d").agg(F.count("*").alias("n"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / LEAF)), F.lit(0)), F.lit(2 * BLOCK)).cast("int")
    sizes = common.stored(sizes.select("label", "d", bits.alias("bits")), "subspace-labels")

    kinds |= {"block": "int", "cell": "long", "home": "boolean", "q": "binary"}
    key = ["label", "d", "block", "cell"]

    def place(names: list[str]) -> DataFrame:
        needed = dict.fromkeys([*[c for c in names if c not in ("block", "cell", "home")], "label", "d", "q"])
        return classes.join(sizes, ["label", "d"]).select(*needed, "bits").mapInArrow(_placed(cuts, threshold, names), ", ".join(f"{c} {kinds[c]}" for c in names))

    crowded = place(key).groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > PART)
    crowded = common.stored(crowded.select(*key, F.ceil(F.col("n") / PART).cast("int").alias("parts")), "subspace-crowded")
    met = place([*key, "home", "node", "weight", "q", "embedding"]).join(crowded, key, "left")
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = met.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other")
    found = common.stored(met.groupBy(*key, "low", "high").applyInArrow(_compared(threshold), "node long, links long, root long"), "subspace-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    own = classes.select("label", "embedding", "node", "first", "weight").join(links, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = common.stored(own, "subspace-components")
    least = own.groupBy("component").agg(F.min("first").alias("least"))
    result = own.join(least, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least", F.lit(True).alias("usable"))
    out = rows.join(result, ["label", "embedding", "usable"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE ok AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
c AS (SELECT vec_id, min(other) AS least FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
