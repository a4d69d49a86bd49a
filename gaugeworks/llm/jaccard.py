"""Exact n-gram Jaccard join of document texts with prefix trees (operator 4)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
#: Keys that a task gathers before it sorts and sends them.
FLUSH = 500_000
#: Bytes of keys that meet at once, and how many such slices a task takes one after another. Sets that resemble each other
#: meet in most slices, and a task gives their link once.
SLICE_BYTES, SLICES = 16 << 20, 4
#: Bytes of a key and of a set's number that are sent. What they can't tell apart only becomes a candidate.
KEY_BYTES, NODE_BYTES = 6, 5
#: Tasks in which the keys of a small table meet.
LEAST_SHARDS = 8
#: Sets under one prefix tree; larger candidate blocks are split and their parts paired.
BLOCK_SETS = 1000
#: Shingles under one prefix tree, likewise: a join takes about 100 bytes for each.
BLOCK_SHINGLES = 500_000


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, hasher: common.WordHasher, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; of fewer words, the whole sequence as one."""
    words, _, _, first = hasher.words(raw, offsets)
    value = np.zeros(len(words), np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for k in range(min(n, len(words))):
        value[: len(words) - k] = value[: len(words) - k] * step + words[k:]
    value = common.mix64(value)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(value[a : b - n + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    x = x * step + w
            out.append(common.mix64(np.array([x])))
        else:
            out.append(words[:0])
    return out


class Bands:
    """Size bands, and into how many ranges of the global order the sets of a band are cut.

    Shingles are ordered by hash. Two sets of sizes a <= b that link have b <=
    100 a / T, so they are in the same band or in neighbouring ones, and differ
    in at most s = (a + b) (100 - T) / (100 + T) shingles. Cut into s + 1 + spare
    ranges, they hold the same shingles in at least 1 + spare ranges. Ranges with
    few shingles say little. Each set leaves out those with fewer than c, for the
    largest c that leaves out at most `spare`. Of the two sets' c the larger
    still leaves one range in which they agree and that neither leaves out.
    """

    def __init__(self, threshold: int):
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(self.low[-1] * 100 // threshold + 1)
        self.edges = np.array(self.low)
        t = threshold
        self.differ = np.array([2 * (hi - 1) * (100 - t) // (100 + t) for hi in self.low[1:]])
        self.spare = np.ceil(0.25 * (self.differ + 1)).astype(np.int64)
        self.ranges = np.where(self.differ > 0, self.differ + 1 + self.spare, 0)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1


def range_keys(sets: list[np.ndarray], ids: np.ndarray, bands: Bands, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, id): a key for each range of each set, in the set's own band and in the next.

    usual: sorted shingles to leave out of all sets, which makes no two sets differ more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    if len(usual):
        rare = usual[np.minimum(np.searchsorted(usual, flat), len(usual) - 1)] != flat
        flat, owner = flat[rare], owner[rare]
    own = np.searchsorted(bands.edges, sizes, "right") - 1
    mixed = common.mix64(flat + np.uint64(0x632BE59BD9B4E019))
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    keys, whose = [], []
    for up in (0, 1):
        band = np.where(sizes > 0, own + up, 0)
        ranges = np.where(sizes > 0, bands.ranges[band], 0)
        k = ((flat >> np.uint64(32)) * ranges[owner].astype(np.uint64)) >> np.uint64(32)
        begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (k[1:] != k[:-1]))) if len(flat) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(flat))
        doc, size = owner[begin], stop - begin
        used = ranges[doc] > 0
        left = bands.spare[band] - (ranges - np.bincount(doc[used], minlength=len(sets)))
        empty = left < 0  # more ranges without a shingle than may be left out
        least = np.ones(len(sets), np.int64)
        for c in range(1, 8):
            left = left - np.bincount(doc[used & (size == c)], minlength=len(sets))
            least += (left >= 0) & (least == c)
        keep = used & (size >= least[doc])
        place = common.mix64((band[doc].astype(np.uint64) << np.uint64(40)) + k[begin] + np.uint64(1))
        keys.append(common.mix64((total[stop] - total[begin]) ^ place)[keep])
        whose.append(ids[doc[keep]])
        for d in np.flatnonzero(empty & (ranges > 0)):
            missing = np.setdiff1d(np.arange(ranges[d], dtype=np.uint64), k[begin[doc == d]])
            keys.append(common.mix64(common.mix64((np.uint64(band[d]) << np.uint64(40)) + missing + np.uint64(1))))
            whose.append(np.full(len(missing), ids[d]))
    return np.concatenate(keys), np.concatenate(whose)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    """Number of a set among candidates: equal sets have one, whichever documents hold them. Two sets of one number only share a block."""
    return int.from_bytes(digest[:NODE_BYTES], "little")


def _profiles(n: int, bands: Bands) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.WordHasher(SEPARATORS)
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            for i, j in common.row_chunks(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher, n)
                digest = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands.band(len(s)) for s in sets], pa.int64()),
                        pa.array(digest, pa.binary()), pa.array([_node(d) for d in digest], pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "band", "content", "node"],
                )

    return run


def _pairs_once(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
    return x[new], y[new]


def _packed(keys: np.ndarray, nodes: np.ndarray) -> bytes:
    """Byte by byte, so that the first ones of ascending keys compress: all first bytes, then all second ones."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].T.tobytes() + nodes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :NODE_BYTES].T.tobytes()


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns = packed.reshape(KEY_BYTES + NODE_BYTES, -1)
    out = np.zeros((2, columns.shape[1], 8), np.uint8)
    out[0, :, :KEY_BYTES], out[1, :, :NODE_BYTES] = columns[:KEY_BYTES].T, columns[KEY_BYTES:].T
    return out[0].view(">u8")[:, 0].astype(np.uint64), out[1].view("<i8")[:, 0].astype(np.int64)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node beside the least node of its key, where that is another."""
    keys, nodes = _pairs_once(keys, nodes)
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    least = nodes[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return _pairs_once(nodes[nodes != least], least[nodes != least])


CUT = np.uint64(64 - 8 * KEY_BYTES)


def _send(n: int, bands: Bands, slices: int, shards: np.ndarray, usual: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        k, i = _pairs_once(np.concatenate(keys) >> CUT << CUT, np.concatenate(nodes))
        to = (((k >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)  # ascending, as k is
        at = np.searchsorted(to, np.arange(slices + 1))
        rows = [(int(shards[s * len(shards) // slices]), s, _packed(k[at[s] : at[s + 1]], i[at[s] : at[s + 1]])) for s in np.flatnonzero(at[1:] > at[:-1]).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["shard", "slice", "packed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, keys, nodes, held = common.WordHasher(SEPARATORS), [], [], 0
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            for i, j in common.row_chunks(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher, n)
                k, d = range_keys(sets, np.array([_node(_digest(s)) for s in sets], np.int64), bands, usual)
                keys.append(k)
                nodes.append(d)
                held += len(k)
                if held >= FLUSH:
                    yield flush(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield flush(keys, nodes)

    return run


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (see _stars) of the keys of a task's slices, which come one after another, each link once."""
    at, keys, nodes = -1, [], []
    a = b = np.zeros(0, np.int64)

    def more() -> tuple[np.ndarray, np.ndarray]:
        x, y = _stars(np.concatenate(keys), np.concatenate(nodes))
        return _pairs_once(np.concatenate([a, x]), np.concatenate([b, y]))

    def links() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        for s, packed in zip(batch.column("slice").to_pylist(), batch.column("packed")):
            if s != at and keys:
                a, b = more()
                keys, nodes = [], []
                if len(a) >= FLUSH:
                    yield links()
                    a = b = a[:0]
            at = s
            k, i = _unpacked(np.frombuffer(packed.as_buffer(), np.uint8))
            keys.append(k)
            nodes.append(i)
    if keys:
        a, b = more()
    yield links()


class PrefixTree:
    """Sets as paths of a compressed trie, shingles ordered from the most shared to the least.

    A node is a run of shingles that the same sets share; nodes are kept as
    arrays in breadth order. A probe goes down level by level with the overlap so
    far of each node, worked out once for all sets below it, and leaves a
    subtree when that overlap and what may still come (of the probe or of the
    sets below) can't reach the overlap that the sizes ask for.
    """

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray, threshold: int):
        self.threshold = threshold
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        parent, start, stop, source = [-1], [0], [0], [order[0] if order else 0]
        children: list[list[int]] = [[]]
        ends: list[list[int]] = [[]]
        stack = [0]
        last = np.zeros(0, np.int64)
        for i in order:
            p = paths[i]
            m = min(len(p), len(last))
            differ = np.flatnonzero(p[:m] != last[:m])
            common_len = int(differ[0]) if len(differ) else m
            while stop[stack[-1]] > common_len and start[stack[-1]] >= common_len:
                stack.pop()
            top = stack[-1]
            if stop[top] > common_len:  # cut the node in two
                lower = len(parent)
                parent.append(top)
                start.append(common_len)
                stop.append(stop[top])
                source.append(source[top])
                children.append(children[top])
                ends.append(ends[top])
                for c in children[lower]:
                    parent[c] = lower
                stop[top], children[top], ends[top] = common_len, [lower], []
            if len(p) > common_len:
                node = len(parent)
                parent.append(top)
                start.append(common_len)
                stop.append(len(p))
                source.append(i)
                children.append([])
                ends.append([])
                children[top].append(node)
                stack.append(node)
            ends[stack[-1]].append(i)
            last = p
        # breadth order, so that children stand together
        queue = [0]
        for node in queue:
            queue += children[node]
        place = np.empty(len(queue), np.int64)
        place[queue] = np.arange(len(queue))
        self.child_at = np.cumsum([1, *(len(children[q]) for q in queue)])
        self.tokens = np.concatenate([paths[source[q]][start[q] : stop[q]] for q in queue]) if paths else np.zeros(0, np.int64)
        self.token_at = np.cumsum([0, *(stop[q] - start[q] for q in queue)])
        self.end_at = np.cumsum([0, *(len(ends[q]) for q in queue)])
        self.ends = np.array([i for q in queue for i in ends[q]], np.int64)
        self.depth = np.array([stop[q] for q in queue], np.int64)
        self.last_token = np.array([paths[source[q]][stop[q] - 1] if stop[q] else -1 for q in queue], np.int64)
        n = len(queue)
        self.least_size, self.deepest = np.full(n, 1 << 60), np.zeros(n, np.int64)
        for at in range(n - 1, -1, -1):
            q = queue[at]
            for i in ends[q]:
                self.least_size[at] = min(self.least_size[at], sizes[i])
                self.deepest[at] = max(self.deepest[at], len(paths[i]))
            if at:
                up = place[parent[q]]
                self.least_size[up] = min(self.least_size[up], self.least_size[at])
                self.deepest[up] = max(self.deepest[up], self.deepest[at])
        self.sizes = sizes

    def partners(self, path: np.ndarray, size: int, member: np.ndarray) -> np.ndarray:
        """Sets that link with the probe. member: scratch, a flag by shingle, all False."""
        t = self.threshold
        member[path] = True
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            a, b = self.token_at[nodes], self.token_at[nodes + 1]
            length = b - a
            bounds = np.cumsum(length)
            index = np.arange(bounds[-1]) + np.repeat(a - (bounds - length), length)
            total = np.append(0, np.cumsum(member[self.tokens[index]]))
            overlap = overlap + total[bounds] - total[bounds - length]
            rest = np.minimum(len(path) - np.searchsorted(path, self.last_token[nodes], "right"), self.deepest[nodes] - self.depth[nodes])
            alive = (100 + t) * (overlap + rest) >= t * (size + self.least_size[nodes])
            nodes, overlap = nodes[alive], overlap[alive]
            a, b = self.end_at[nodes], self.end_at[nodes + 1]
            for k in np.flatnonzero(b > a):
                ends = self.ends[a[k] : b[k]]
                found.append(ends[(100 + t) * overlap[k] >= t * (size + self.sizes[ends])])
            a, b = self.child_at[nodes], self.child_at[nodes + 1]
            length = b - a
            overlap = np.repeat(overlap, length)
            bounds = np.cumsum(length)
            nodes = np.arange(bounds[-1]) + np.repeat(a - (bounds - length), length) if len(nodes) else nodes
        member[path] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def join_block(sets: list[np.ndarray], part: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of a block's sets, as each set's least local component member. Sets of part 0 probe those of part 1, if there are two."""
    sizes = np.array([len(s) for s in sets], np.int64)
    shingles, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(shingles), np.int64)
    order[np.argsort(-count, kind="stable")] = np.arange(len(shingles))
    shared = count > 1
    bounds = np.cumsum([0, *sizes])
    paths = [np.sort(order[r[shared[r]]]) for r in (rank[a:b] for a, b in zip(bounds, bounds[1:]))]
    two = bool(part.any())
    right = np.flatnonzero(part == 1) if two else np.arange(len(sets))
    left = np.flatnonzero(part == 0) if two else right
    tree = PrefixTree([paths[i] for i in right], sizes[right], threshold)
    member, root = np.zeros(len(shingles), bool), [*range(len(sets))]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in left.tolist():
        for j in right[tree.partners(paths[i], int(sizes[i]), member)].tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(i, top(i)) for i in range(len(sets)) if top(i) != i]


def _join(n: int, threshold: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        hasher = common.WordHasher(SEPARATORS)
        order = np.argsort(np.asarray(table.column("doc_id")), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        ids, part = np.asarray(table.column("doc_id")), np.asarray(table.column("part"))
        sets: list[np.ndarray] = []
        raw, offsets = common.text_buffers(table.column("text").chunk(0))
        for i, j in common.row_chunks(offsets):
            sets += shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher, n)
        links = np.array(join_block(sets, part, threshold), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[links[:, 0]], "b": ids[links[:, 1]]})

    return run


#: Documents whose shingles are counted to find the usual ones.
SAMPLE = 5000


def _usual(docs: DataFrame, n: int, count: int) -> np.ndarray:
    """Shingles of more than one document in 500, by a sample of about SAMPLE documents.

    They only help to keep candidates apart: whichever shingles are named here, no link
    is lost. As a document has few of them, so has the list: at most 500 documents' worth.
    """
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, count // SAMPLE))) == 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.WordHasher(SEPARATORS)
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            for i, j in common.row_chunks(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher, n)
                value, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["value", "times"])

    counted = sample.mapInArrow(run, "value long, times long").groupBy("value").agg(F.sum("times").alias("times"))
    found = counted.filter(F.col("times") > max(8, min(count, SAMPLE) / 500)).select("value").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _load() -> Column:
    """Of how many parts the rows must be."""
    return F.greatest(F.count("*") / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)


def _parts(inside: DataFrame) -> DataFrame:
    """(doc_id, component, left, right, part) from inside(node, component, band, n_shingles): under which pairs of parts a set is joined.

    A block of up to BLOCK_SETS sets and BLOCK_SHINGLES shingles is one part. A larger one has parts by size
    band, and within a band at random; a part meets the parts of its own band and
    of the next, the only ones whose sizes allow a link.
    """
    load = _load()
    size = inside.groupBy("component").agg(F.count("*").alias("sets"), load.alias("load")).filter("sets > 1")
    whole = inside.join(size, "component").withColumn("band", F.when(F.col("load") > 1, F.col("band")).otherwise(0))
    count = whole.groupBy("component", "band").agg(F.ceil(load).alias("parts"))
    below = count.select("component", (F.col("band") + 1).alias("band"), F.col("parts").alias("lower"))
    above = count.select("component", (F.col("band") - 1).alias("band"), F.col("parts").alias("upper"))
    placed = whole.join(count, ["component", "band"]).join(below, ["component", "band"], "left").join(above, ["component", "band"], "left")
    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = placed.select(F.col("node").alias("doc_id"), "component", "band", "parts", "lower", "upper", mine.alias("mine"))

    def name(band, part):
        return F.struct(band.alias("band"), part.alias("part"))

    def upto(n):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    def pair(left, right, part: int):
        return F.struct(left.alias("left"), right.alias("right"), F.lit(part).alias("part"))

    band, mine = F.col("band"), F.col("mine")
    own = name(band, mine)
    met = F.concat(
        F.transform(F.sequence(mine, F.col("parts") - 1), lambda y: pair(own, name(band, y), 0)),
        F.transform(upto(mine), lambda y: pair(name(band, y), own, 1)),
        F.transform(upto(F.col("upper")), lambda y: pair(own, name(band + 1, y), 0)),
        F.transform(upto(F.col("lower")), lambda y: pair(name(band - 1, y), own, 1)),
    )
    return placed.select("doc_id", "component", F.explode(met).alias("pair")).select("doc_id", "component", "pair.left", "pair.right", "pair.part")


def _blocks(stars: DataFrame, first: DataFrame) -> DataFrame:
    """(node, component, band, n_shingles) of stars(a, b) over the numbers of first(number, node, band, n_shingles): sets by block.

    Two sets with a common key are in the star of its least set. Components of stars
    hold each set once, but chains join sets that have nothing in common, and the
    more, the larger the table is. A component that is more than a part (see _parts) is
    replaced by its stars where these send fewer shingles to joins.
    """
    sent = (F.sum("n_shingles") * F.ceil(_load())).alias("sent")
    chained = common.stored(components.connected(stars).withColumnRenamed("node", "number").withColumnRenamed("component", "chain").join(first, "number"), "blocks")
    large = common.stored(chained.groupBy("chain").agg(_load().alias("load"), sent).filter("load > 1"), "large")
    ends = (F.struct(F.col(x).alias("number"), F.col("b").alias("component")) for x in "ab")
    inside = chained.join(large.select("chain"), "chain", "left_semi")
    starred = common.stored(stars.select(F.inline(F.array(*ends))).distinct().join(inside, "number"), "starred")
    apart = starred.groupBy("chain", "component").agg(sent).groupBy("chain").agg(F.sum("sent").alias("apart"))
    better = common.stored(apart.join(large, "chain").filter("apart < sent").select("chain"), "better")
    whole = chained.join(better, "chain", "left_anti").select("node", F.col("chain").alias("component"), "band", "n_shingles")
    return common.stored(whole.unionByName(starred.join(better, "chain", "left_semi").select(*whole.columns)), "inside")


def _rows_once(known: DataFrame, sized: DataFrame) -> DataFrame:
    """Rows of known with each (doc_id, text) once; only rows of ids that occur more than once are compared."""
    doubled = common.stored(sized.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "doubled")
    once = known.join(doubled, "doc_id", "left_anti")
    return once.unionByName(known.join(doubled, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def near_duplicates(docs: DataFrame, n: int = 4, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text).

    Two documents link when 100 * |A & B| >= threshold * |A | B| for their sets
    of distinct n-word shingles; component_id is the least doc_id that links reach.
    The result is exact (shingles stand for their 64-bit hashes).

    1. Equal sets: one representative each; only these go on.
    2. Candidates: each set's shingles, in global (hash) order, are cut into
       ranges; sets that link agree in a range (see Bands). Keys meet by shuffle,
       sorted and made distinct in each task first, and give links to the least
       set of the key, never all pairs. Components of these links are blocks, or where these are large, the stars of links around a least set.
    3. Each block's sets become a prefix tree that every set probes; of equal rows of an id one takes part. A block of
       more than BLOCK_SETS sets or BLOCK_SHINGLES shingles is split, and its parts are joined two by two.
    4. Components of the links found.

    A null or empty text and one without words have no shingles and link with
    nothing. Rows with a null doc_id get a null component and link with nothing.
    Repeated rows with one doc_id and text give repeated results; with one doc_id
    and different texts, a link of either joins the id. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = common.texts(docs)
    known = rows.filter("doc_id is not null")
    bands = Bands(threshold)
    profiles = common.stored(rows.mapInArrow(_profiles(n, bands), "doc_id long, n_shingles long, band long, content binary, node long"), "profiles")
    sized = profiles.filter("n_shingles > 0 and doc_id is not null")
    least = sized.groupBy("content").agg(F.min("doc_id").alias("least"), F.first("band").alias("band"), F.first("n_shingles").alias("n_shingles"), F.first("node").alias("number"), F.count("*").alias("copies"))
    total = sized.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    share = 2.6 * (100 - threshold) / (100 + threshold) * 2  # keys for each shingle, about
    slices = max(LEAST_SHARDS, math.ceil(total[0] * share * 16 / SLICE_BYTES))
    shards = common.shard_numbers(spark, max(LEAST_SHARDS, math.ceil(slices / SLICES)))
    sent = known.mapInArrow(_send(n, bands, slices, shards, _usual(known, n, total[1])), "shard int, slice int, packed binary")
    met = sent.repartition(len(shards), "shard").sortWithinPartitions("slice").mapInArrow(_meet, "a long, b long")
    stars = common.stored(met.distinct(), "stars")
    # one set of equal ones goes on
    inside = _blocks(stars, least.select("number", F.col("least").alias("node"), "band", "n_shingles"))
    pairs = _parts(inside)
    # trees are work for the processors, not bytes: as many partitions as asked for, not fewer by size
    dealt = _rows_once(known, sized).join(pairs, "doc_id").repartition(common.partitions(spark), "component", "left", "right")
    grouped = dealt.groupBy("component", "left", "right")
    links = components.connected(grouped.applyInArrow(_join(n, threshold), "a long, b long"))
    # a set's component is looked up once, not for each copy; sets of very many copies, of which there are few, are broadcast
    known_sets = least.join(links, F.col("least") == F.col("node"), "left").select("content", "copies", F.coalesce("component", "least").alias("component"))
    hot = F.broadcast(known_sets.filter(F.col("copies") > max(components.HOT_EDGES, total[1] // components.HOT_SHARE)).drop("copies"))
    rest = profiles.join(hot.select("content"), "content", "left_anti").join(known_sets.drop("copies"), "content", "left")
    members = profiles.join(hot, "content").unionByName(rest)
    own = F.when(F.col("n_shingles") > 0, F.col("component"))
    return members.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + least(4, len(ws)) - 1), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - least(4, len(ws)) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * both_have >= 85 * (nx.c + ny.c - both_have)),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.to_id)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
