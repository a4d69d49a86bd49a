"""Removal of repeated byte strings with a logarithmic family of suffix arrays (operator 3)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes whose fingerprint orders the suffixes.
GRAM = 32
#: Suffixes that a task gathers before it sorts and sends them.
FLUSH = 250_000
#: Bytes of suffix entries under one reducer.
SHARD_BYTES = 16 << 20
#: Batches in which a table is ingested.
BATCHES = 4
#: Bits of a suffix's place below its gram's fingerprint when anchors are chosen.
PLACE_BITS = 22
#: Bytes in which anchors are chosen at once; longer texts are cut into overlapping pieces. Some dozen arrays of eight bytes a byte stand beside them.
PIECE_BYTES = 1 << 18
#: Documents that are looked at for hot grams, about, the least of them that make a gram hot, and the bytes of contexts,
#: reckoned for the whole table, that one gram may bring to a task.
HOT_SAMPLE, HOT_DOCUMENTS, HOT_BYTES = 20_000, 8, 2 << 20
#: Strings of hot grams that a task gathers before it sorts and sends them, and contexts that it cuts out at once.
STRING_FLUSH, CONTEXT_ROWS = 500_000, 5_000
#: Characters of a text that deal the rows of a repeated doc_id.
RANGE_CHARS = 256

FIELDS = ("key", "context", "doc", "start", "shape")


class Sampler:
    """The suffixes of each text that are kept, so that every string of `length` bytes is found by one of them.

    Of the grams in a string, the one of least fingerprint (the leftmost of
    equals) is its anchor: equal strings have equal anchors at equal places.
    Strings that start one after the other and share an anchor are one entry:
    key (the gram's fingerprint), context (the fingerprint of all the bytes that
    they cover), where they start, how many they are, and the anchor's place.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, length: int):
        self.length, self.grams = length, length - GRAM + 1
        self.size = 0

    def powers(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = n
        self.power = np.full(n, self.BASE, np.uint64)
        self.power[0] = 1
        self.inverse = np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def entries(self, raw: np.ndarray, offsets: np.ndarray, step: int = 0) -> tuple[np.ndarray, ...]:
        """(key, context, text number, start, shape) with shape = anchor's place * 128 + strings - 1. step: string starts in a piece."""
        step = step or PIECE_BYTES
        if len(raw) <= step:
            return self._entries(raw, offsets)
        parts = []
        for a in range(0, len(raw), step):  # each string begins in one piece
            b, first = min(len(raw), a + step + self.length - 1), int(np.searchsorted(offsets, a, "right")) - 1
            inner = offsets[(offsets > a) & (offsets < b)] - a
            key, context, text, start, shape = self._entries(raw[a:b], np.concatenate([[0], inner, [b - a]]))
            parts.append((key, context, text + first, start + np.where(text == 0, a - offsets[first], 0), shape))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _entries(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(raw)
        if n < self.length:
            return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
        self.powers(n + 1)
        value = raw.astype(np.uint64) + np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * self.power[:n], out=total[1:])
        count = n - GRAM + 1
        gram = common.mix64((total[GRAM:] - total[:count]) * self.inverse[:count])
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (gram & ~low) | np.arange(count, dtype=np.uint64)
        width = 1
        while width < self.grams:  # the least over windows of doubled width
            step = min(width, self.grams - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        anchor = (least & low).astype(np.int64)
        whole = np.zeros(n + 1, np.int64)  # strings that don't cross texts
        sizes = np.diff(offsets)
        long = sizes >= self.length
        np.add.at(whole, offsets[:-1][long], 1)
        np.add.at(whole, offsets[1:][long] - self.length + 1, -1)
        valid = np.cumsum(whole)[: len(anchor)] > 0
        # grams that cross texts don't occur in valid strings
        change = np.append(True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]) & valid
        change[offsets[:-1][long]] = True
        start = np.flatnonzero(change)
        ends = np.flatnonzero(valid & np.append(change[1:] | ~valid[1:], True))
        at = anchor[start]
        stop = ends + self.length
        context = (total[stop] - total[start]) * self.inverse[start]
        shape = (at - start) * 128 + (ends - start)
        context = common.mix64(context ^ common.mix64(shape.astype(np.uint64)))
        text = np.searchsorted(offsets, start, "right") - 1
        # anchors are small fingerprints; mixed again, their keys fill the whole range evenly
        return common.mix64(gram[at] + np.uint64(0x632BE59BD9B4E019)), context, text, start - offsets[text], shape


def packed(x: np.ndarray) -> bytes:
    """Bytes plane by plane, so that compression finds the planes of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(blobs: list[bytes], kind: type) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).ravel() for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


KINDS = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
BLOB_SCHEMA = "shard int, kind string, " + ", ".join(f"{f} binary" for f in FIELDS)
BLOB_NAMES = ["shard", "kind", *FIELDS]
BLOB_TYPES = [pa.int32(), pa.string(), *[pa.binary()] * 5]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] if rows else [[]] * len(BLOB_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, BLOB_TYPES)], names=BLOB_NAMES)


def _order(e: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    by = np.lexsort((e[3], e[2], e[1], e[0]))
    return tuple(x[by] for x in e)


def _classes(e: tuple[np.ndarray, ...]) -> np.ndarray:
    """In sorted entries, where an entry's key and context differ from those before."""
    return np.append(True, (e[0][1:] != e[0][:-1]) | (e[1][1:] != e[1][:-1])) if len(e[0]) else np.zeros(0, bool)


def _take(e: tuple[np.ndarray, ...], which: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(x[which] for x in e)


def _row(shard: int, kind: str, e: tuple[np.ndarray, ...]) -> tuple:
    return (shard, kind, *map(packed, e))


def _to(value: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges a fingerprint is in."""
    return (((value >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _among(value: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is one of some sorted ones."""
    return some[np.minimum(np.searchsorted(some, value), len(some) - 1)] == value if len(some) else np.zeros(len(value), bool)


def _later(e: tuple[np.ndarray, ...], new: np.ndarray) -> np.ndarray:
    """Entries that start later than the first of their class."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return (e[2] != e[2][first]) | (e[3] != e[3][first])


def _build(length: int, shards: np.ndarray, hot: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffix entries of a task's texts, sorted, equal ones found within the task, by range of the key, or of the context for hot keys."""

    def flush(parts: list[tuple[np.ndarray, ...]], count: int) -> pa.RecordBatch:
        e = _order(tuple(np.concatenate(x) for x in zip(*parts)))
        new = _classes(e)
        later = _later(e, new)
        rows = []
        if later.any():
            rows.append(_row(int(shards[count % len(shards)]), "covered", _take(e, later)))
        e = _take(e, ~later)
        to = _to(np.where(_among(e[0], hot), e[1], e[0]), len(shards))
        by = np.argsort(to, kind="stable")
        at = np.searchsorted(to[by], np.arange(len(shards) + 1))
        rows += [_row(int(shards[s]), "new", _take(e, by[at[s] : at[s + 1]])) for s in np.flatnonzero(at[1:] > at[:-1])]
        return _batch(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sampler, parts, held, count = Sampler(length), [], 0, TaskContext.get().partitionId()
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            doc = np.asarray(batch.column("doc_id"))
            for i, j in common.row_chunks(offsets, PIECE_BYTES):
                e = sampler.entries(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append((e[0], e[1], doc[i:j][e[2]], e[3], e[4]))
                held += len(e[0])
                if held >= FLUSH:
                    yield flush(parts, count)
                    parts, held, count = [], 0, count + 1
        if held:
            yield flush(parts, count)

    return run


def _scan(merge: int, hot: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """A shard of the new batch's suffix array, scanned together with that of every level.

    Gives what is covered, which entries share a gram but not the context
    (`open`), the array of the new level (the batch with the `merge` lowest
    levels) and no rows for the levels that stay. Entries of a hot gram lie in
    several shards, and new ones are always open.
    """

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        blobs = [table.column(f).to_pylist() for f in FIELDS]

        def of(kind: str) -> tuple[np.ndarray, ...]:
            return tuple(unpacked([b for b, k in zip(col, kinds) if k == kind], t) for col, t in zip(blobs, KINDS))

        shard = table.column("shard")[0].as_py()
        rows = [_row(shard, "covered", e)] if len((e := of("covered"))[0]) else []
        new = of("new")
        level_names = sorted({k for k in kinds if k.startswith("level")})
        levels = [of(k) for k in level_names]
        sources = [new, *levels]
        e = tuple(np.concatenate(x) for x in zip(*sources))
        source = np.repeat(np.arange(len(sources)), [len(s[0]) for s in sources])
        by = np.lexsort((e[3], e[2], e[1], e[0]))
        e, source = _take(e, by), source[by]
        begins = _classes(e)
        later = _later(e, begins)
        if (now := later & (source == 0)).any():
            rows.append(_row(shard, "covered", _take(e, now)))
        e, source, begins = _take(e, ~later), source[~later], begins[~later]
        if len(begins):
            key_begins = np.append(True, e[0][1:] != e[0][:-1])
            number = np.cumsum(key_begins) - 1
            contexts = np.bincount(number, weights=_classes(e))
            fresh = np.bincount(number, weights=source == 0)
            opened = (contexts > 1) & (fresh > 0)
            is_hot = _among(e[0], hot)
            if (which := np.where(is_hot, source == 0, opened[number])).any():
                rows.append(_row(shard, "open", _take(e, which)))
        kept = {f"level{k:02d}" for k in range(merge)}
        into = np.isin(source, [0, *(k + 1 for k, n in enumerate(level_names) if n in kept)])
        if into.any():
            rows.append(_row(shard, f"level{merge:02d}", _take(e, into)))
        return pa.Table.from_batches([_batch(rows)])

    return run


class SuffixFamily:
    """Suffix arrays in levels: level k holds 2**k batches; two of one size become one of the next.

    A batch's array is sharded by ranges of the sort key, and each shard is
    scanned with the same shard of all levels. Levels are Parquet tables in the
    shared folder; one that has been merged is deleted.
    Batches must come in ascending order of document id.
    """

    def __init__(self, spark: SparkSession, length: int, shards: int, hot: np.ndarray | None = None):
        self.spark, self.length = spark, length
        self.shards = common.shard_numbers(spark, shards)
        self.hot = np.zeros(0, np.uint64) if hot is None else hot
        self.count = 0
        self.levels: dict[int, str] = {}
        self.found: list[str] = []

    def ingest(self, batch: DataFrame) -> None:
        """batch(doc_id, text), with ids above those of earlier batches."""
        merge = 0
        while merge in self.levels:
            merge += 1
        rows = batch.mapInArrow(_build(self.length, self.shards, self.hot), BLOB_SCHEMA)
        for path in self.levels.values():
            rows = rows.unionByName(self.spark.read.schema(BLOB_SCHEMA).parquet(path))
        scanned = rows.repartition(len(self.shards), "shard").groupBy("shard").applyInArrow(_scan(merge, self.hot), BLOB_SCHEMA)
        path = common.scratch(self.spark, "suffixes")
        table = F.when(F.col("kind").startswith("level"), "level").otherwise(F.col("kind"))
        scanned.withColumn("table", table).write.partitionBy("table").option("compression", "zstd").parquet(path)
        for k in range(merge):
            common.remove(self.spark, self.levels.pop(k))
        self.levels[merge] = f"{path}/table=level"
        self.found.append(path)
        self.count += 1
        self.levels = {k: p for k, p in self.levels.items() if self._there(p)}

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def rows(self, table: str) -> DataFrame:
        """covered or open entries of all batches so far."""
        paths = [p for p in (f"{x}/table={table}" for x in self.found) if self._there(p)]
        read = self.spark.read.schema(BLOB_SCHEMA)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], BLOB_SCHEMA)


DEALT_SCHEMA = "bucket int, doc binary, a binary, b binary, c binary"
DEALT_NAMES = ["bucket", "doc", "a", "b", "c"]
DEALT_TYPES = [pa.int32(), *[pa.binary()] * 4]


def _deal(doc: np.ndarray, columns: list[np.ndarray], buckets: np.ndarray) -> pa.RecordBatch:
    """Rows of 64-bit integers by bucket of their document, packed: one row a bucket, however many documents it has."""
    columns = [*columns, *[np.zeros(0, np.int64)] * (3 - len(columns))]
    to = (common.mix64(doc.view(np.uint64)) % np.uint64(len(buckets))).astype(np.int64)
    by = np.argsort(to, kind="stable")
    at = np.searchsorted(to[by], np.arange(len(buckets) + 1))
    rows = []
    for k in np.flatnonzero(at[1:] > at[:-1]):
        w = by[at[k] : at[k + 1]]
        rows.append((int(buckets[k]), packed(doc[w]), *(packed(c[w]) if len(c) else b"" for c in columns)))
    parts = [*zip(*rows)] if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, DEALT_TYPES)], names=DEALT_NAMES)


def _by_document(name: str, width: int) -> Callable[[pa.Table], pa.Table]:
    """One row for each document of a bucket: its distinct rows of `width` integers, in order."""

    def run(table: pa.Table) -> pa.Table:
        doc, *columns = (unpacked(table.column(c).to_pylist(), np.int64) for c in DEALT_NAMES[1 : 2 + width])
        by = np.lexsort((*columns[::-1], doc))
        doc, rows = doc[by], np.column_stack([c[by] for c in columns])
        if len(doc):
            new = np.append(True, (doc[1:] != doc[:-1]) | (rows[1:] != rows[:-1]).any(1))
            doc, rows = doc[new], rows[new]
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        parts = [rows[i:j].tobytes() for i, j in zip(at, [*at[1:], len(doc)])]
        return pa.table({"doc_id": pa.array(doc[at]), name: pa.array(parts, pa.binary())})

    return run


def _covers(length: int, buckets: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, start, shape = (unpacked([batch.column(f)[k].as_py()], np.int64) for f in FIELDS[2:])
                yield _deal(doc, [start, start + (shape & 127) + length], buckets)

    return run


def _open_rows(buckets: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, doc, start, shape = (unpacked([batch.column(f)[k].as_py()], np.int64) for f in ("key", "doc", "start", "shape"))
                yield _deal(doc, [key, start, shape], buckets)

    return run


CONTEXT_SCHEMA = "shard int, kind string, key binary, doc binary, start binary, shape binary, context binary"
CONTEXT_NAMES = [x.split()[0] for x in CONTEXT_SCHEMA.split(", ")]


def _string_prints(rows: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the strings at each place of each context."""
    width = rows.shape[1]
    base = np.multiply.accumulate(np.append(np.uint64(1), np.full(width, Sampler.BASE, np.uint64)))
    inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(width - length, pow(Sampler.BASE, -1, 1 << 64), np.uint64)))
    total = np.zeros((len(rows), width + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * base[:width], axis=1, out=total[:, 1:])
    return common.mix64((total[:, length:] - total[:, : width - length + 1]) * inverse)


def _strings(rows: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, shape: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, document, start) of every string of the contexts. Equal strings have equal grams, so the key is part of the fingerprint."""
    prints = np.concatenate([_string_prints(rows[q : q + 1000], length) for q in range(0, len(rows), 1000)])
    entry, place = np.nonzero(np.arange(prints.shape[1]) <= (shape & 127)[:, None])
    return common.mix64(prints[entry, place] ^ key[entry]), doc[entry], start[entry] + place


def _repeats(value: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """The first of each class of equal strings (fingerprint, document, start), and the others (document, start)."""
    order = np.lexsort((at, doc, value))
    value, doc, at = value[order], doc[order], at[order]
    new = np.append(True, value[1:] != value[:-1]) if len(value) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(value) else np.zeros(0, np.int64)
    later = (doc != doc[first]) | (at != at[first])
    return (value[new], doc[new], at[new]), (doc[later], at[later])


def _runs(doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings that begin one after the other as spans (document, begin, stop)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    begin = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    stop = np.append(begin[1:], True) if len(at) else begin
    return doc[begin], at[begin], at[stop] + length


def _contexts(length: int, shards: np.ndarray, hot: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of open entries, from the joined texts, by shard of their key.

    Of hot grams the strings themselves are sent, by shard of their own
    fingerprint: their contexts need not meet in one place. Equal strings of a
    task are compared before, so that only the first of them is sent.
    """
    width = 2 * length - GRAM

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.string(), *[pa.binary()] * 5])], names=CONTEXT_NAMES)

    def flush(parts: list[tuple[np.ndarray, ...]], count: int) -> pa.RecordBatch:
        (value, doc, at), others = _repeats(*(np.concatenate(x) for x in zip(*parts)))
        to = _to(value, len(shards))  # ascending, as the values are
        bounds = np.searchsorted(to, np.arange(len(shards) + 1))
        rows = []
        for s in np.flatnonzero(bounds[1:] > bounds[:-1]):
            w = slice(bounds[s], bounds[s + 1])
            rows.append((int(shards[s]), "strings", value[w].tobytes(), doc[w].tobytes(), at[w].tobytes(), b"", b""))
        doc, begin, stop = _runs(*others, length)
        rows.append((int(shards[count % len(shards)]), "spans", b"", doc.tobytes(), begin.tobytes(), stop.tobytes(), b""))
        return batch_of(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, held, count = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            doc = np.asarray(batch.column("doc_id"))
            for i, j in common.row_chunks(offsets, PIECE_BYTES):
                lists = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in batch.column("entries").slice(i, j - i).to_pylist()]
                rows = np.column_stack([np.repeat(np.arange(i, j), [len(x) for x in lists]), np.concatenate(lists)])
                for k in range(0, len(rows), CONTEXT_ROWS):
                    r = rows[k : k + CONTEXT_ROWS]
                    key, start, shape = r[:, 1].copy().view(np.uint64), r[:, 2].copy(), r[:, 3].copy()
                    begin = offsets[r[:, 0]] + start
                    size = (shape & 127) + length
                    cell = begin[:, None] + np.arange(width)
                    bytes_ = np.where(np.arange(width) < size[:, None], raw[np.minimum(cell, len(raw) - 1)], 0).astype(np.uint8)
                    is_hot = _among(key, hot)
                    if is_hot.any():
                        parts.append(_strings(bytes_[is_hot], key[is_hot], doc[r[is_hot, 0]], start[is_hot], shape[is_hot], length))
                        held += len(parts[-1][0])
                        if held >= STRING_FLUSH:
                            yield flush(parts, count)
                            parts, held, count = [], 0, count + 1
                    cold = np.flatnonzero(~is_hot)
                    to = _to(key[cold], len(shards))
                    by = np.argsort(to, kind="stable")
                    at, out = np.searchsorted(to[by], np.arange(len(shards) + 1)), []
                    for s in np.flatnonzero(at[1:] > at[:-1]):
                        w = cold[by[at[s] : at[s + 1]]]
                        out.append((int(shards[s]), "contexts", key[w].tobytes(), doc[r[w, 0]].tobytes(), start[w].tobytes(), shape[w].tobytes(), bytes_[w].tobytes()))
                    if out:
                        yield batch_of(out)
        if held:
            yield flush(parts, count)

    return run


def _compare(length: int, buckets: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Strings of open entries that start later than an equal one, for all keys and all strings of a shard."""
    width = 2 * length - GRAM

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()

        def column(kind: str, name: str, dtype: type) -> np.ndarray:
            return np.frombuffer(b"".join(v for v, k in zip(table.column(name).to_pylist(), kinds) if k == kind), dtype)

        key, doc, start, shape = (column("contexts", c, t) for c, t in (("key", np.uint64), ("doc", np.int64), ("start", np.int64), ("shape", np.int64)))
        rows = column("contexts", "context", np.uint8).reshape(-1, width)
        by = np.argsort(key, kind="stable")
        bounds = np.append(np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1])), len(by)) if len(by) else np.zeros(1, np.int64)
        _, others = _repeats(*(column("strings", c, t) for c, t in (("key", np.uint64), ("doc", np.int64), ("start", np.int64))))
        parts, k = [others], 0
        while k < len(bounds) - 1:  # whole keys, about 5,000 entries at a time
            m = max(k + 1, int(np.searchsorted(bounds, bounds[k] + 5_000, "right")) - 1)
            some = by[bounds[k] : bounds[m]]
            k = m
            parts.append(_repeats(*_strings(rows[some], key[some], doc[some], start[some], shape[some], length))[1])
        found = _runs(*(np.concatenate(x) for x in zip(*parts)), length)
        known = [column("spans", c, np.int64) for c in ("doc", "start", "shape")]
        which, begin, stop = (np.concatenate(x) for x in zip(found, known))
        return pa.Table.from_batches([_deal(which, [begin, stop], buckets)])

    return run


def _hot_grams(docs: DataFrame, length: int, n: int) -> np.ndarray:
    """Grams that occur with different contexts in so many documents that the contexts exceed HOT_BYTES, by a sample, sorted.

    They only decide where entries meet, so whichever are named here, the result is the same.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length)
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            for i, j in common.row_chunks(offsets, PIECE_BYTES):
                e = sampler.entries(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = np.unique(np.stack([e[0], e[1], e[2].astype(np.uint64)]), axis=1)
                (key, context), times = np.unique(found[:2], axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(times)], names=["key", "context", "times"])

    every = max(1, n // HOT_SAMPLE)
    least = max(HOT_DOCUMENTS, HOT_BYTES // (2 * length + 8) // every)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    by_context = sample.mapInArrow(run, "key long, context long, times long").groupBy("key", "context").agg(F.sum("times").alias("times"))
    by_key = by_context.groupBy("key").agg(F.sum("times").alias("times"), F.count("*").alias("contexts"))
    found = by_key.filter((F.col("times") >= least) & (F.col("contexts") > 1)).select("key").collect()  # bounded by the sample
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _cut(names: list[str], with_text: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without their spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column("text"))
            lists, out = batch.column("spans").to_pylist(), []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                text = raw[a:b]
                removed = runs = 0
                if lists[k]:
                    pairs = np.frombuffer(lists[k], np.int64).reshape(-1, 2)
                    mark = np.zeros(b - a + 1, np.int32)
                    np.add.at(mark, pairs[:, 0], 1)
                    np.add.at(mark, pairs[:, 1], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    removed = int(gone.sum())
                    runs = int((gone & ~np.append(False, gone[:-1])).sum())
                    text = text[~gone]
                kept = text.tobytes()
                out.append((b - a, removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            columns = [*zip(*out)] if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = dict(zip(["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"], (pa.array(c, t) for c, t in zip(columns, kinds))))
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, batches: int = BATCHES, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of docs(doc_id, text), and columns to carry along.

    Every byte of a text (as UTF-8) that is covered by a string of `length` bytes
    that also starts earlier, in a document of smaller id or further left in the
    same one, is removed; strings are judged on the input. kept_text leaves out
    what is left of characters that were cut. Exact (strings stand for their
    fingerprints of at least 64 bits, compared only under equal anchors).

    The table is ingested in `batches` ranges of doc_id into a SuffixFamily. The
    arrays are sparse: of each text, only the suffixes at anchors, enough to find
    every string (see Sampler). Entries whose whole context occurred before are
    covered at once. Where a gram occurs in different contexts, the contexts'
    bytes meet under the gram and their strings are compared one by one. Grams
    that very many documents hold (hot ones, by a sample) are dealt out by
    context and then by string, so that no gram is one task's work.

    A text of any length is cut into overlapping pieces where anchors are chosen, and otherwise held whole by one task.
    Null and empty texts have no bytes. Rows with a null doc_id count as
    earlier than all others. Rows that share a doc_id are documents of their
    own, in order of their texts, however many they are: all rows are then numbered
    in order of doc_id and text. Rows with one doc_id and equal first RANGE_CHARS
    characters are sorted in one task. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = common.texts(docs, carry=carry)
    facts = rows.agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")
    ).first()
    unique = facts["n"] == facts["ids"]
    if unique:
        keyed = rows.withColumn("own_id", F.col("doc_id"))
    else:
        ranged = rows.repartitionByRange(common.partitions(spark), F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS))
        ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        # ascends within a partition and from one to the next
        keyed = common.stored(ranged.withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "keyed")
    entries = facts["bytes"] * 2 / (length - GRAM + 2)
    shards = max(common.partitions(spark), math.ceil(entries * 40 / SHARD_BYTES))
    plain = keyed.select("doc_id", "text")
    cuts = plain.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.001) if facts["n"] else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    hot = _hot_grams(plain, length, facts["n"])
    family = SuffixFamily(spark, length, shards, hot)
    shards = family.shards
    for a, b in zip(bounds, bounds[1:]):
        part = plain
        if a is not None:
            part = part.filter(F.col("doc_id") > a)
        if b is not None:
            part = part.filter(F.col("doc_id") <= b)
        family.ingest(part)
    opened = family.rows("open").mapInArrow(_open_rows(shards), DEALT_SCHEMA)
    listed = opened.repartition(len(shards), "bucket").groupBy("bucket").applyInArrow(_by_document("entries", 3), "doc_id long, entries binary")
    sent = plain.join(listed, "doc_id").mapInArrow(_contexts(length, shards, hot), CONTEXT_SCHEMA)
    partial = common.stored(sent.repartition(len(shards), "shard").groupBy("shard").applyInArrow(_compare(length, shards), DEALT_SCHEMA), "spans")
    covered = family.rows("covered").mapInArrow(_covers(length, shards), DEALT_SCHEMA)
    spans = covered.unionByName(partial).repartition(len(shards), "bucket").groupBy("bucket").applyInArrow(_by_document("spans", 2), "doc_id long, spans binary")
    names = ["own_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []), *carry]
    kinds = {"own_id": T.LongType(), "kept_sha256": T.StringType(), "kept_text": T.StringType()} | {c: docs.schema[c].dataType for c in carry}
    schema = T.StructType([T.StructField(n, kinds.get(n, T.LongType())) for n in names])
    joined = keyed.join(spans, "doc_id", "left").select("own_id", "text", "spans", *carry)
    return joined.mapInArrow(_cut(names, with_text), schema).withColumnRenamed("own_id", "doc_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read(spark, sf_dir, "documents"), with_text=False)
