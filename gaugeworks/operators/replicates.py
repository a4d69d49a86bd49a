"""Many redrawn versions of a table at once: counts, labels and swaps of every replicate worked out row by row.

A row has a number from md5 of the seed and its key. A replicate has two coefficients, and what a row gets in it
follows from a * number + b modulo a prime: any engine, partitioning or retry draws alike, and neither rows nor
replicates have to be numbered or shuffled. Tasks sum all replicates of the rows they read; only sums meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import kept

#: The prime of the draws.
PRIME = 2147483647
#: Rows worked out at once, and groups that a task sums before it passes them on.
STRIP, GROUPS = 2048, 2000
#: Rows in a block of an ordered table, as a power of two.
BLOCK_BITS = 12
#: Standard deviations within which the last place of a drawn split is looked for first.
REACH = 6.0


def coefficients(seed: int, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """By replicate, from 1 on: a from 1 to PRIME - 1, b from 0 to PRIME - 1."""
    number = lambda k, r: int(hashlib.md5(f"{seed}:{k}:{r}".encode()).hexdigest()[:15], 16)
    every = range(1, replicates + 1)
    return np.array([1 + number("a", r) % (PRIME - 1) for r in every], np.int64), np.array([number("b", r) % PRIME for r in every], np.int64)


def number(seed: int, *keys: Column) -> Column:
    """A row's number below PRIME."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % PRIME


def poisson_steps() -> list[int]:
    """A count is the number of steps at or below the draw: the distribution function of Poisson(1) in units of PRIME."""
    out, term, total, k = [], math.exp(-1), math.exp(-1), 0
    while math.floor(PRIME * total) < PRIME - 1 and k < 12:
        out.append(math.floor(PRIME * total))
        k += 1
        term /= k
        total += term
    return out


@dataclass
class Draws:
    """What rows get in each replicate. Replicate 0 is the table as it is: 1 for every row, or its own label.

    kind "counts": how often a row is drawn, Poisson(1); "split": 1 if the draw is at most the replicate's threshold;
    "masks": 1 if the bit of the row's number is set, for all rearrangements of few rows; "swap": 1 with probability 1/2.
    """

    kind: str
    seed: int
    replicates: int
    thresholds: list[int] = field(default_factory=list)
    masks: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.a, self.b = coefficients(self.seed, 0 if self.masks else self.replicates)
        self.steps = np.array(poisson_steps(), np.int64)

    def matrix(self, x: np.ndarray, own: np.ndarray | None = None, some: np.ndarray | None = None) -> np.ndarray:
        """A row for each row, a column for each replicate from 0 on, or for those in `some`."""
        first = np.ones(len(x), np.int64) if own is None else own.astype(np.int64)
        if self.kind == "masks":
            out = np.array(self.masks, np.int64)[None, :] >> x[:, None] & 1
        else:
            u = (x[:, None] * self.a[None, :] + self.b[None, :]) % PRIME
            if self.kind == "counts":
                out = np.searchsorted(self.steps, u.ravel(), "right").reshape(u.shape)
            elif self.kind == "split":
                out = (u <= np.array(self.thresholds, np.int64)[None, :]).astype(np.int64)
            else:
                out = (u < PRIME // 2).astype(np.int64)
        out = np.concatenate([first[:, None], out], 1)
        return out if some is None else out[:, some]


def _group_codes(batch: pa.RecordBatch, by: Sequence[str], known: dict[tuple, int]) -> np.ndarray:
    keys = zip(*(batch.column(c).to_pylist() for c in by)) if by else [()] * len(batch)
    return np.array([known.setdefault(k, len(known)) for k in keys], np.int64)


def _summed(draws: Draws, by: Sequence[str], sums: Sequence[str], label: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        total = np.zeros((len(sums), 0, draws.replicates + 1))

        def rows() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in known], kinds[c]) for i, c in enumerate(by)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(list(t), pa.list_(pa.float64())) for t in total)], names=[*by, *sums])

        kinds: dict[str, pa.DataType] = {}
        for batch in batches:
            kinds = {c: batch.column(c).type for c in by}
            for k in range(0, len(batch), STRIP):
                part = batch.slice(k, STRIP)
                code = _group_codes(part, by, known)
                if len(known) > total.shape[1]:
                    total = np.concatenate([total, np.zeros((len(sums), len(known) - total.shape[1], total.shape[2]))], 1)
                drawn = draws.matrix(part.column("__x").to_numpy(), part.column("__own").to_numpy(zero_copy_only=False) if label else None)
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(code) else order
                for i, c in enumerate(sums):
                    value = part.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                    total[i, code[order[at]]] += np.add.reduceat(drawn[order] * value[order, None], at, axis=0)
                if len(known) > GROUPS:
                    yield rows()
                    known.clear()
                    total = np.zeros((len(sums), 0, draws.replicates + 1))
        if known:
            yield rows()

    return run


def replicate_sums(df: DataFrame, draws: Draws, x: Column, sums: Mapping[str, Column], by: Sequence[str] = (), label: Column | None = None) -> DataFrame:
    """(by..., replicate, sums...): each sum's values times what their rows get, by replicate, 0 for the table as it is.

    One pass over df: a task passes on a row for each group it has seen, with all replicates as arrays; no row
    is repeated for a replicate. `label` says what a row gets in replicate 0; without it that is 1. Null values count as 0.
    """
    if not sums:
        raise ValueError("nothing to sum")
    kinds = dict(df.dtypes)
    own = [] if label is None else [F.coalesce(label, F.lit(False)).cast("boolean").alias("__own")]
    rows = df.select(*by, x.cast("long").alias("__x"), *own, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in sums.items()])
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"`{k}` array<double>" for k in sums)])
    arrays = rows.mapInArrow(_summed(draws, by, list(sums), label is not None), schema)
    each = arrays.select(*by, F.posexplode(F.arrays_zip(*sums)).alias("replicate", "z")).select(*by, "replicate", *[F.col(f"z.{k}").alias(k) for k in sums])
    return each.groupBy(*by, "replicate").agg(*[F.sum(k).alias(k) for k in sums])


def ordered(df: DataFrame, value: str, x: Column, *more: Column) -> DataFrame:
    """(v, x, more..., range, block, at) in order of value, written to the shared folder.

    Rows are cut into ranges of the order; a block is 2 ** BLOCK_BITS rows in a row of one range, at their place in it.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.select(F.col(value).cast("double").alias("v"), x.cast("long").alias("x"), *more).filter("v is not null and not isnan(v)")
    placed = rows.repartitionByRange(n, "v").sortWithinPartitions("v", "x").withColumn("__id", F.monotonically_increasing_id())
    at = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept(placed.withColumns({"range": F.shiftright("__id", 33).cast("int"), "block": F.shiftright(at, BLOCK_BITS), "at": at}).drop("__id"))


def _chosen(draws: Draws) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending")])
        replicate, rank = wanted.column("replicate").to_numpy(), wanted.column("local").to_numpy()
        every, column = np.unique(replicate, return_inverse=True)
        reached = np.cumsum(draws.matrix(rows.column("x").to_numpy(), some=every), axis=0)
        at = [int(np.searchsorted(reached[:, c], r)) for c, r in zip(column, rank)]
        return pa.table({"replicate": wanted.column("replicate"), "target": wanted.column("target"), "value": rows.column("v").take(pa.array(at, pa.int64()))})

    return run


def order_statistics(rows: DataFrame, draws: Draws, targets: Mapping[str, Column]) -> DataFrame:
    """(replicate, n, one column for each target) of ordered() rows: the value at which drawn counts reach the target rank.

    Targets are ranks from 1, as columns of n, the replicate's number of drawn rows. Counts are summed by range and
    by block; a rank's range and then its block follow from those sums, and only such blocks are read again, each a
    bounded group. Replicate 0 is the table as it is. A replicate without rows has nulls.
    """
    blocks = kept(replicate_sums(rows, draws, F.col("x"), {"w": F.lit(1.0)}, ["range", "block"]).select("range", "block", "replicate", F.col("w").cast("long").alias("w")))
    by_range = blocks.groupBy("replicate", "range").agg(F.sum("w").alias("w"))
    size = by_range.groupBy("replicate").agg(F.sum("w").alias("n"))
    wanted = size.select("replicate", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("target"), c.cast("long").alias("rank")) for k, c in targets.items()])).alias("t"))
    wanted = wanted.select("replicate", "t.target", "t.rank").filter("rank >= 1")

    def step(sums: DataFrame, order: str, on: Sequence[str], asked: DataFrame) -> DataFrame:
        before = Window.partitionBy("replicate", "target").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        met = sums.join(asked, list(on)).withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        return met.filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("w"))).withColumn("rank", F.col("rank") - F.col("before")).drop("before", "w")

    found = step(blocks, "block", ["replicate", "range"], step(by_range, "range", ["replicate"], wanted))
    found = kept(found.select("range", "block", "replicate", "target", F.col("rank").alias("local")))
    asked = rows.join(found.select("range", "block").distinct(), ["range", "block"], "left_semi").select("range", "block", "at", "v", "x")
    values = asked.groupBy("range", "block").cogroup(found.groupBy("range", "block")).applyInArrow(_chosen(draws), "replicate int, target string, value double")
    wide = values.groupBy("replicate").agg(*[F.max(F.when(F.col("target") == k, F.col("value"))).alias(k) for k in targets])
    return size.join(wide, "replicate", "left")


def split_thresholds(df: DataFrame, x: Column, take: int, n: int, seed: int, replicates: int) -> Draws:
    """Draws that give `take` of the n rows of df to the second group in each replicate: those of least draw.

    The last of them is looked for within REACH standard deviations of where it is to be expected: a task counts
    the draws below and passes on those inside, about 2 * REACH * sqrt(n / 4) for each replicate. Rows of equal draw
    stay together. `replicates` thresholds reach the driver.
    """
    a, b = coefficients(seed, replicates)
    reach = REACH
    while True:
        mid, half = PRIME * take / n, reach * PRIME * math.sqrt(max(take * (n - take), 1) / n**3)
        low, high = math.floor(mid - half), math.ceil(mid + half)

        def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below = np.zeros(replicates, np.int64)
            for batch in batches:
                for k in range(0, len(batch), STRIP):
                    u = (batch.column("x").slice(k, STRIP).to_numpy()[:, None] * a[None, :] + b[None, :]) % PRIME
                    below += (u < low).sum(0)
                    _, r = inside = np.nonzero((u >= low) & (u <= high))
                    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32) + 1), pa.array(u[inside]), pa.array(np.ones(len(r), np.int64))], names=["replicate", "u", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(np.full(replicates, -1, np.int64)), pa.array(below)], names=["replicate", "u", "n"])

        counted = df.select(x.cast("long").alias("x")).mapInArrow(near, "replicate int, u long, n long").groupBy("replicate", "u").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("replicate").orderBy("u"))
        last = counted.withColumn("upto", upto).filter((F.col("u") >= 0) & (F.col("upto") >= take)).groupBy("replicate").agg(F.min("u").alias("u"), F.min(F.col("upto") - F.col("n")).alias("before"))
        found = {r["replicate"]: r["u"] for r in last.filter(F.col("before") < take).collect()}
        if len(found) == replicates or low <= 0 and high >= PRIME:
            return Draws("split", seed, replicates, thresholds=[found.get(r, PRIME) for r in range(1, replicates + 1)])
        reach *= 4
