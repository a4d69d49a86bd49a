"""Benchmark decontamination with suffix arrays of the training text (operator 7)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Every byte that parts words, after A-Z are lower-cased.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Benchmark text that every task searches at once; a larger benchmark is searched in blocks of this size, one after the other.
BLOCK_BYTES = 8 << 20
#: Bytes of text under one suffix array, and words: a longer text is cut into overlapping pieces.
SHARD_BYTES, SHARD_WORDS = 4 << 20, 1 << 20
WINDOW = 13


class SuffixArray:
    """The word suffixes of a shard of texts, sorted by their first `depth` words, or wholly (None).

    A suffix ends with its text; words are ordered by hash. They are numbered by
    rank among the shard's distinct words, as many as fit are packed into the
    63-bit key by which suffixes are sorted first, and ties are sorted by the
    groups of the suffixes 1, 2, 4, ... keys further on.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int | None):
        self.words, self.first, n = words, first, len(words)
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.bits = len(self.vocabulary).bit_length() or 1
        self.step = 63 // self.bits
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.left = first[1:][doc] - np.arange(n) if n else np.zeros(0, np.int64)  # words to the end of the text
        padded = np.zeros(n + self.step, np.int64)
        padded[:n] = rank + 1
        self.key = np.zeros(n, np.int64)
        for k in range(self.step):
            self.key = (self.key << self.bits) | np.where(self.left > k, padded[k : k + n], 0)
        self.order = np.argsort(self.key, kind="stable")
        if n:
            self._refine(depth)

    def _refine(self, depth: int | None) -> None:
        n, order, done = len(self.order), self.order, self.step
        begins = np.append(True, self.key[order][1:] != self.key[order][:-1])
        group, group_of = np.cumsum(begins), np.empty(n, np.int64)
        while depth is None or done < depth:
            tied = ~begins
            tied[:-1] |= ~begins[1:]
            at = np.flatnonzero(tied)
            here = order[at]
            further = self.left[here] > done
            if not further.any():
                break
            group_of[order] = group
            after = np.where(further, group_of[np.minimum(here + done, n - 1)], 0)
            by = np.lexsort((after, group[at]))
            order[at], after = here[by], after[by]
            begins[at[1:]] |= after[1:] != after[:-1]
            group = np.cumsum(begins)
            done *= 2

    def number(self, words: np.ndarray) -> np.ndarray:
        """Ranks of a query's words from 1, or -1 where the shard has no such word."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        k = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == words, k + 1, -1)

    def ranges(self, cells: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word ranks (of `sizes` words, filled up with 0) the range of suffixes that start with it."""
        low, high = np.zeros(len(cells), np.int64), np.full(len(cells), len(self.order))
        for at in range(0, cells.shape[1], self.step):
            value = np.zeros(len(cells), np.int64)
            for k in range(at, at + self.step):
                value = (value << self.bits) | (np.where(k < sizes, cells[:, k], 0) if k < cells.shape[1] else 0)
            free = np.clip(at + self.step - np.minimum(sizes, cells.shape[1]), 0, self.step)
            live = np.flatnonzero((free < self.step) & (low < high))
            value, free = value[live], free[live]
            a = self._bisect(at, value, low[live], high[live])
            high[live] = self._bisect(at, value + (np.int64(1) << (self.bits * free)), a, high[live])
            low[live] = a
        return low, high

    def _bisect(self, at: int, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first suffix of each range whose key `at` words on isn't less than the value."""
        low, high, n = low.copy(), high.copy(), len(self.order)
        while (some := np.flatnonzero(low < high)).size:
            mid = (low[some] + high[some]) // 2
            suffix = self.order[mid]
            key = np.where(self.left[suffix] > at, self.key[np.minimum(suffix + at, n - 1)], 0)
            less = key < value[some]
            low[some[less]] = mid[less] + 1
            high[some[~less]] = mid[~less]
        return low


class Benchmark:
    """The words of a block of items, and the suffixes that are searched.

    Searched are all suffixes of at least `window` words, by their first
    `window`, and items of fewer words as a whole. Equal ones form a class and
    are searched once.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw = [text.encode("utf-8") for _, text in items]
        hasher = common.WordHasher(SEPARATORS)
        self.words, _, _, self.first = hasher.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.ids, self.window = [i for i, _ in items], window
        count = np.diff(self.first)
        size, starts = np.minimum(count, window), np.where(count > 0, count - np.minimum(count, window) + 1, 0)
        self.owner = np.repeat(np.arange(len(items)), starts)
        self.suffix = np.arange(len(self.owner)) - np.repeat(np.cumsum(starts) - starts, starts) + self.first[:-1][self.owner]
        sizes = size[self.owner]
        self.prints = Prints(self.words)
        content = common.mix64(self.prints.of(self.suffix, sizes) + sizes.astype(np.uint64))
        _, where, self.class_of = np.unique(content, return_index=True, return_inverse=True)
        self.at, self.sizes = self.suffix[where], sizes[where]
        pairs = np.unique(np.stack([self.class_of, self.owner], 1), axis=0) if len(where) else np.zeros((0, 2), np.int64)
        self.items_at, self.items = np.searchsorted(pairs[:, 0], np.arange(len(where) + 1)), pairs[:, 1]

    def ranges(self, array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """For each class, the range of the shard's suffixes that start with it."""
        rank = array.number(self.words)
        unknown = np.append(0, np.cumsum(rank < 0))
        known = np.flatnonzero(unknown[self.at + self.sizes] == unknown[self.at])
        index = np.minimum(self.at[known][:, None] + np.arange(self.window), max(len(rank) - 1, 0))
        low, high = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        low[known], high[known] = array.ranges(rank[index] if len(rank) else index, self.sizes[known])
        return low, high


class Prints:
    """Fingerprints of any runs of words, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: np.ndarray):
        power, inverse = np.full(len(words) + 1, common.WordHasher.BASE, np.uint64), np.full(len(words) + 1, pow(common.WordHasher.BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.multiply.accumulate(inverse, out=inverse)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=self.total[1:])

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) * self.inverse[at]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every place in the ranges."""
    count = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(low)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]


def _hits(words: np.ndarray, first: np.ndarray, test: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(word place, class) of every occurrence in a shard. A text beyond SHARD_WORDS is searched in pieces that overlap by a window."""
    places, classes = [], []
    cuts = [(0, len(words))] if len(first) != 2 else [(a, a + SHARD_WORDS) for a in range(0, max(len(words), 1), SHARD_WORDS)]
    for a, b in cuts:
        piece = words[a : b + test.window - 1]
        array = SuffixArray(piece, first if len(cuts) == 1 else np.array([0, len(piece)]), test.window)
        which, at = _spread(*test.ranges(array))
        place = array.order[at] + a
        own = place < b
        places.append(place[own])
        classes.append(which[own])
    return np.concatenate(places), np.concatenate(classes)


def _scan(items: list[tuple[str, str]], window: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, test = common.WordHasher(SEPARATORS), Benchmark(items, window)
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            for i, j in common.row_chunks(offsets, SHARD_BYTES):
                words, _, _, first = hasher.words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                place, class_ = _hits(words, first, test)
                size = test.sizes[class_]
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, place, 1)
                np.add.at(mark, place + size, -1)
                hit = np.cumsum(mark[:-1]) > 0
                # runs of hit words within each text, and the items found there
                doc = np.searchsorted(first, place, "right") - 1
                found = np.unique(np.stack([doc, class_], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
                row, at = _spread(test.items_at[found[:, 1]], test.items_at[found[:, 1] + 1])
                pairs = np.unique(np.stack([found[row, 0], test.items[at]], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
                edge = np.zeros(len(words) + 1, bool)
                edge[first] = True
                before, after = np.append(False, hit)[:-1], np.append(hit, False)[1:]
                begin = np.flatnonzero(hit & (~before | edge[:-1]))
                stop = np.flatnonzero(hit & (~after | edge[1:])) + 1
                spans_at, items_at = np.searchsorted(begin, first), np.searchsorted(pairs[:, 0], np.arange(len(first)))
                owner = np.searchsorted(first, begin, "right") - 1
                spans = pa.StructArray.from_arrays(
                    [pa.array(begin - first[owner]), pa.array(stop - first[owner])], names=["begin", "stop"]
                )
                names = pa.array([test.ids[k] for k in pairs[:, 1].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), batch.column("row_key").slice(i, j - i), pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(spans_at.astype(np.int32)), spans),
                        pa.ListArray.from_arrays(pa.array(items_at.astype(np.int32)), names),
                    ],
                    names=["doc_id", "row_key", "n_words", "spans", "items"],
                )

    return run


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items (id as string, text) in blocks of bounded size (or one item), one block on the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")))
    for i, text in rows.toLocalIterator():
        block.append((i, text))
        size += len(text.encode("utf-8")) + 64
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCH_SCHEMA = "doc_id long, row_key string, n_words long, spans array<struct<begin:long,stop:long>>, items array<string>"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keys: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items): for each row of docs the hit words, as [begin, stop), and the items found.

    With `keys` there is also row_key, sha256 of the text, which tells rows of one doc_id apart.

    Each task sorts the word suffixes of its shards of documents, and
    binary-searches every suffix of the benchmark's items in them: the places
    that share its first `window` words (or all words of a shorter item) are
    hit; a longer match is the union of those of successive suffixes. The
    benchmark goes to the tasks in blocks of at most block_bytes or one item.
    With several blocks, each one's finds are written to the shared folder
    before the next block is read, and united at the end; each block costs a scan of docs.

    A null text has no words; an item without words has no suffixes; items with a
    null id are found but not named. A null doc_id stays null. Rows with the same
    doc_id are each judged alone; repeated items count once. A very long text is searched in
    overlapping pieces. An empty benchmark finds nothing; other columns are ignored.
    """
    rows, some = common.texts(docs), blocks(benchmark, block_bytes)
    first, second = next(some, []), next(some, None)
    if second is None:
        keyed = rows.withColumn("row_key", F.sha2("text", 256) if keys else F.lit(None).cast("string"))
        found = keyed.mapInArrow(_scan(first, window), MATCH_SCHEMA)
        return found if keys else found.drop("row_key")
    keyed, path = rows.withColumn("row_key", F.sha2("text", 256)), common.scratch(docs.sparkSession, "benchmark-blocks")
    for k, block in enumerate(itertools.chain([first, second], some)):
        part = keyed.mapInArrow(_scan(block, window), MATCH_SCHEMA)
        part = part if k == 0 else part.filter(F.size("spans") > 0)
        part.withColumn("block", F.lit(k)).write.mode("append").parquet(path)
    found = docs.sparkSession.read.schema(f"{MATCH_SCHEMA}, block int").parquet(path)
    # equal rows (same id and text) have equal results: a row of the first block each, with the others' finds
    united = found.groupBy("doc_id", "row_key").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
        F.flatten(F.collect_set("items")).alias("items"), F.count(F.when(F.col("block") == 0, 1)).alias("copies"),
    )
    return united.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *(["row_key"] if keys else []), "n_words", _merged("spans").alias("spans"), "items")


def _merged(spans: str):
    """Union of intervals: sorted, then joined where they touch."""
    start = F.array().cast("array<struct<begin:bigint,stop:bigint>>")

    def join(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (x["begin"] <= F.try_element_at(done, F.lit(-1))["stop"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, join)


def verdicts(found: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) and columns to keep: at least a twentieth of the words are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["begin"])
    named = F.array_compact("items")
    return found.withColumn("items", F.array_distinct("items")).select(
        "doc_id", *keep, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(named)), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


class LongestMatch:
    """Longest common prefixes of benchmark suffixes and a shard's suffixes, compared by fingerprints of whole runs."""

    def __init__(self, array: SuffixArray, test: Benchmark):
        self.array, self.test, self.prints = array, test, Prints(array.words)
        self.left = test.first[1:][test.owner] - test.suffix  # words to the end of the item

    def shared(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words that benchmark suffix `row` shares with the suffix at place `at` of the array, by bisection on their number."""
        p, q = self.test.suffix[row], self.array.order[at]
        low, high = np.zeros(len(row), np.int64), np.minimum(self.left[row], self.array.left[q])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.test.prints.of(p, mid) == self.prints.of(q, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def bisect(self, row: np.ndarray, low: np.ndarray, high: np.ndarray, go_right: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (some := np.flatnonzero(low < high)).size:
            mid = (low[some] + high[some]) // 2
            right = go_right(some, mid, self.shared(row[some], mid))
            low[some[right]] = mid[right] + 1
            high[some[~right]] = mid[~right]
        return low

    def search(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, low, high): the longest match of each suffix and the range of the array that holds it, inside the given range."""
        array, test = self.array, self.test

        def below(some: np.ndarray, mid: np.ndarray, shared: np.ndarray) -> np.ndarray:
            p, q = test.suffix[row[some]], array.order[mid]
            ended = shared == self.left[row[some]]
            short = shared == array.left[q]
            mine = test.words[np.minimum(p + shared, len(test.words) - 1)]
            other = array.words[np.minimum(q + shared, len(array.words) - 1)]
            return ~ended & (short | (other < mine))

        at, n = self.bisect(row, low, high, below), np.zeros(len(row), np.int64)
        for near, inside in ((at - 1, at > low), (at, at < high)):
            k = np.flatnonzero(inside)
            n[k] = np.maximum(n[k], self.shared(row[k], near[k]))
        begin = self.bisect(row, low, at, lambda some, mid, shared: shared < n[some])
        return n, begin, self.bisect(row, at, high, lambda some, mid, shared: shared >= n[some])


def _longest(items: list[tuple[str, str]], at_least: int, batch_rows: int = 100_000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, test = common.WordHasher(SEPARATORS), Benchmark(items, at_least)
        names = pa.array(test.ids, pa.string())
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            for i, j in common.row_chunks(offsets, SHARD_BYTES):
                words, _, _, first = hasher.words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                array = SuffixArray(words, first, None)
                low, high = test.ranges(array)
                row = np.flatnonzero((low < high)[test.class_of])
                n, low, high = LongestMatch(array, test).search(row, low[test.class_of[row]], high[test.class_of[row]])
                # a suffix that only continues the match of the one before says nothing new
                begins = np.append(True, (row[1:] != row[:-1] + 1) | (test.owner[row[1:]] != test.owner[row[:-1]]) | (n[1:] != n[:-1] - 1)) if len(row) else np.zeros(0, bool)
                row, n, low, high = row[begins], n[begins], low[begins], high[begins]
                bounds, k = np.cumsum(high - low), 0
                while k < len(row):
                    m = max(k + 1, int(np.searchsorted(bounds, (bounds[k - 1] if k else 0) + batch_rows, "right")))
                    which, at = _spread(low[k:m], high[k:m])
                    place, which, k = array.order[at], which + k, m
                    doc = np.searchsorted(first, place, "right") - 1
                    owner = test.owner[row[which]]
                    columns = [
                        names.take(pa.array(owner)), pa.array(test.suffix[row[which]] - test.first[owner]), pa.array(n[which]),
                        batch.column("doc_id").take(pa.array(i + doc)), pa.array(place - first[doc]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item_place", "n_words", "doc_id", "word_place"])

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, at_least: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, item_place, n_words, doc_id, word_place): the longest verbatim match of every suffix of every item in each
    shard of documents, and all places that hold it, if it has at_least words or the whole of a shorter item.

    Matches are of any length. A suffix is left out where its match is the rest of
    the match of the suffix one word before. A shard is some whole texts, so a
    place with a shorter match isn't listed where the shard has a longer one.
    Nulls, repeated rows and empty tables count as in matches(); a very long text is sorted as a whole.
    """
    spark, rows = docs.sparkSession, common.texts(docs)
    schema = "item_id string, item_place long, n_words long, doc_id long, word_place long"
    some = blocks(benchmark, block_bytes)
    first, second = next(some, []), next(some, None)
    if second is None:
        return rows.mapInArrow(_longest(first, at_least), schema)
    path = common.scratch(spark, "longest-matches")
    for block in itertools.chain([first, second], some):
        rows.mapInArrow(_longest(block, at_least), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(matches(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), sized AS (SELECT item, ws, least(13, len(ws)) AS sz FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, sz, array_to_string(list_slice(ws, i, i + sz - 1), ' ') AS g
  FROM (SELECT item, ws, sz, unnest(generate_series(1, len(ws) - sz + 1)) AS i FROM sized)),
sizes AS (SELECT DISTINCT sz FROM win),
grams AS (SELECT doc_id, i, sz, array_to_string(list_slice(ws, i, i + sz - 1), ' ') AS g
  FROM (SELECT doc_id, ws, sz, unnest(generate_series(1, len(ws) - sz + 1)) AS i FROM d JOIN sizes ON len(ws) >= sz)),
occ AS (SELECT doc_id, i, sz, item FROM grams JOIN win USING (sz, g)),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + sz - 1)) AS w FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
