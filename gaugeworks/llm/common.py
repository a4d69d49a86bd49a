"""Shared helpers: scratch folders, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; longer single texts are handled whole.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder for intermediate tables that driver and executors both reach.

    The session's spark.checkpoint.dir is used; where it is unset, a temporary
    folder serves a local master, and any other master is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gaugeworks-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and keeps partition contents stable."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shard_numbers(spark: SparkSession, n: int) -> np.ndarray:
    """n ascending integers that repartition(n, column of integers) deals to n different partitions: a shard is then a task."""
    part, found, at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part"), {}, 0
    while len(found) < n:
        for r in spark.range(at, at + 8 * n + 64).select("id", part).groupBy("part").agg(F.min("id").alias("id")).collect():
            found.setdefault(r["part"], r["id"])
        at += 8 * n + 64
    return np.sort(np.array([*found.values()], np.int64))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id long, text string) and the columns to carry along: no others, null texts as empty ones."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carry
    )


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (raw[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (raw[:0], np.zeros(1, np.int64))


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes every word of a block of texts at once, by prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse

    def __init__(self, separators: bytes):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.grow(CHUNK_BYTES + 1)

    def grow(self, n: int) -> None:
        self.power = np.full(n, self.BASE, np.uint64)
        self.power[0] = 1
        self.inverse = np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word, and for each text the index of its first word (one more at the end).

        Long blocks are hashed in pieces that end at a separator, so that the steps between need little memory.
        """
        cuts = [0]
        while len(raw) - cuts[-1] > 2 * CHUNK_BYTES:
            cuts.append(self._separator(raw, cuts[-1] + CHUNK_BYTES))
        if len(cuts) == 1:
            return self._words(raw, offsets)
        parts = []
        for a, b in zip(cuts, [*cuts[1:], len(raw)]):
            inner = offsets[(offsets > a) & (offsets < b)] - a
            value, start, end, _ = self._words(raw[a:b], np.concatenate([[0], inner, [b - a]]))
            parts.append((value, start + a, end + a))
        value, start, end = (np.concatenate(x) for x in zip(*parts))
        return value, start, end, np.searchsorted(start, offsets)

    def _separator(self, raw: np.ndarray, at: int) -> int:
        while at < len(raw):
            found = np.flatnonzero(~self.is_word[self.lower[raw[at : at + 65536]]])
            if len(found):
                return at + int(found[0])
            at += 65536
        return len(raw)

    def _words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        if n + 1 > len(self.power):
            self.grow(n + 1)
        low = self.lower[raw]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = self.is_word[low]
        edge = np.zeros(n + 1, bool)
        edge[offsets[(offsets >= 0) & (offsets <= n)]] = True  # words don't cross texts
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
        value = (total[ends] - total[starts]) * self.inverse[starts]
        value = mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return value, starts, ends, np.searchsorted(starts, offsets)
