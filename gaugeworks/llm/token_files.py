"""Token ids as ORC files, ordered by document id (operator 1)."""

from __future__ import annotations

import functools
import math
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import byte_alphabet

SCHEMA = "doc_id long, local_start long, n_tokens long, ids array<int>, shard int"
#: Bounds the distinct pieces a worker remembers.
MEMO = 900_000
#: Bytes of text in a file, roughly: sets the number of range partitions.
SHARD_BYTES = 32 << 20


#: White space other than the space and the line feed.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Packers of short lists of ids.
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    n = len(ids)
    return PACKERS[n](*ids) if n < 16 else struct.pack(f"<{n}I", *ids)


class Pieces(dict):
    """Ids by piece; a piece that isn't there is encoded, with `before` before it, when it is first asked for."""

    def __init__(self, coder: PieceEncoder, before: str):
        self.coder, self.before = coder, before

    def __missing__(self, piece: str) -> bytes:
        return self.coder.add(self, piece)


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece between single spaces once.

    In a byte-level vocabulary no token and no word of the pre-tokenizer holds a
    space after a character that isn't white space, so a text may be cut before
    every such space. A text in which a space stands between white space is
    given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.shown = dict(enumerate(byte_alphabet()))
        self.space, self.ends = self.shown[32], {}
        self.line = pack(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.unsafe = regex.compile(r"(?:\s|^) (?:\s|$)")
        self.clear()

    def plain(self, memo: dict[str, bytes], before: str, piece: str) -> bytes | None:
        """Ids of letters with full stops and commas behind them: one word of the pre-tokenizer, with the
        space before it, and another. None for all else."""
        word = piece.rstrip(".,")
        if not word.isalpha():
            return None
        if (ids := memo.get(word)) is None:  # get() doesn't add
            shown = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.shown)
            memo[word] = ids = pack([t.id for t in self.tokenizer.model.tokenize(self.space + shown if before else shown)])
        if len(word) < len(piece):
            if (tail := self.ends.get(end := piece[len(word) :])) is None:
                tail = self.ends[end] = pack(self.tokenizer.encode(end, add_special_tokens=False).ids)
            memo[piece] = ids = ids + tail
        return ids

    def add(self, memo: Pieces, piece: str) -> bytes:
        """Ids of a piece that memo doesn't have yet, and has from then on."""
        ids = None
        if "\n" in piece:
            head, *tails = piece.split("\n")
            parts = [self.plain(memo, memo.before, head), *(self.plain(self.first, "", t) for t in tails)]
            if None not in parts:
                ids = self.line.join(parts)
        else:
            ids = self.plain(memo, memo.before, piece)
        if ids is None:
            ids = pack(self.tokenizer.encode(memo.before + piece, add_special_tokens=False).ids)
        memo[piece] = ids
        return ids

    def clear(self) -> None:
        self.first, self.rest = Pieces(self, ""), Pieces(self, " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        split, whole = [], []
        for i, t in enumerate(texts):
            # without other white space, a space can only be followed by white space or the end in these ways
            plain = "  " not in t and " \n" not in t and not t.endswith(" ") and not any(map(t.__contains__, OTHER_SPACE))
            if not plain and self.unsafe.search(t):
                whole.append(i)
            elif t:
                split.append((i, t.split(" ")))
        if len(self.rest) + len(self.first) > MEMO:
            self.clear()
        first, get = self.first, self.rest.__getitem__
        for i, p in split:
            head = p.pop(0)
            out[i] = first[head] + b"".join(map(get, p))
        for i in whole:
            e = self.tokenizer.encode(texts[i], add_special_tokens=False)
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


@functools.cache
def _encoder(path: str) -> PieceEncoder:
    """One a worker process: later tasks of the worker find its memory of pieces."""
    return PieceEncoder(path)


def _write_rows(path: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, at, shard = _encoder(path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            offsets = common.text_buffers(batch.column("text"))[1]
            for i, j in common.row_chunks(offsets):
                rows = [x + end for x in encoder.encode(batch.column("text").slice(i, j - i).to_pylist())]
                lengths = np.array([len(x) // 4 for x in rows], np.int64)
                bounds = np.zeros(len(rows) + 1, np.int64)
                np.cumsum(lengths, out=bounds[1:])
                flat = np.frombuffer(b"".join(rows), "<u4").view(np.int32)
                arrays = [
                    ids.slice(i, j - i), pa.array(at + bounds[:-1]), pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat)), pa.array(np.full(len(rows), shard, np.int32)),
                ]
                at += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "local_start", "n_tokens", "ids", "shard"])

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, shards: int | None = None, stripe_mb: int = 16
) -> None:
    """Encode docs(doc_id, text) and write ORC files under path, in ascending doc_id order.

    Rows are range-partitioned and sorted by doc_id; each range is one folder
    shard=N with (doc_id, local_start, n_tokens, ids). ORC stores the ids as
    run-length encoded integers in stripes that are read independently, with a
    row index and a Bloom filter on doc_id, so a look-up by id skips files,
    stripes and row groups. local_start is the document's first id within its
    shard; the shards' totals are the only thing needed to turn it into a place
    in the whole stream.

    Files hold about SHARD_BYTES of text, whatever the session's number of
    partitions; `shards` overrides that. Ranges are cut by doc_id and a hash of the
    text, so no text is sampled to the driver and repeated ids can be parted.

    A null text has just the end id. A null doc_id comes first. Rows that share
    a doc_id stand next to each other, by a hash of the text. A text of any length is one
    row, encoded as a whole. No rows give no files. Other columns are ignored.
    """
    rows = common.texts(docs)
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / SHARD_BYTES))
    keys = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
    (
        ordered.mapInArrow(_write_rows(tokenizer, end_id), SCHEMA)
        .write.option("compression", "snappy")
        .option("orc.stripe.size", stripe_mb << 20)
        .option("orc.row.index.stride", 1000)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .partitionBy("shard")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; filters on doc_id are pushed down to stripes, row groups and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = np.asarray(ids.values).astype("<u4", copy=False)
        bounds = np.asarray(ids.offsets)
        crc = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())
        keep = [batch.column(c) for c in ("doc_id", "shard", "local_start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, crc], names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before.

    A shard's base is the sum of the shards before it: one row a file, however long the files are.
    """
    rows = read_token_files(spark, path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard
    base = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    found = rows.select("doc_id", "shard", "local_start", "n_tokens", "ids").mapInArrow(
        _crc, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long"
    )
    return found.join(F.broadcast(base), "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch(spark, "op1-tokens")
    write_token_files(common.read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(spark, path)
