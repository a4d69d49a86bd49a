"""How the sources of each language differ in their words (operator 13)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a language that must hold a term for it to be kept.
MIN_DOCS = 10
#: Terms reported for a group.
TOP = 10
#: Probabilities are whole numbers of this part.
SCALE = 1_000_000_000
#: Bytes of text tokenised at once, and the distinct terms and pending counts a task holds before it passes them on.
BLOCK_BYTES, TERMS, PENDING = 4 << 20, 400_000, 2_000_000
#: Counts in a shard of terms: eight times the pairs of sources, so that the shards' partial sums are fewer than the counts, within these limits.
SHARD_LEAST, SHARD_MOST = 10_000, 4_000_000
PARTIAL = "lang string, source string, term string, n long, docs long"
BLOCK = "lang string, source string, part string, item string, value long"


class Tokenizer:
    """Terms of a block of UTF-8 texts: letters of A-Z, lower-cased, a-z, and all bytes from 0x80.

    A table by byte tells what a term is made of; terms begin and end where that
    changes or a text ends. Slices are grouped by xxhash; each is then compared,
    byte by byte, with the first of its group, and those that differ (hashes that
    collide) are told apart by their bytes.
    """

    def __init__(self, mask: int = (1 << 64) - 1):
        import xxhash

        self.hash, self.mask = xxhash.xxh3_64_intdigest, mask
        self.inside = np.zeros(256, bool)
        self.inside[65:91] = self.inside[97:123] = self.inside[128:] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.clear()

    def clear(self) -> None:
        self.by_hash: dict[int, int] = {}
        self.by_bytes: dict[bytes, int] = {}
        self.terms: list[bytes] = []

    def number(self, value: int, term: bytes) -> int:
        """The term's number; terms of one hash beyond the first are found by their bytes."""
        k = self.by_hash.get(value)
        if k is None:
            k = self.by_hash[value] = len(self.terms)
            self.terms.append(term)
        elif self.terms[k] != term:
            if (k := self.by_bytes.get(term)) is None:
                k = self.by_bytes[term] = len(self.terms)
                self.terms.append(term)
        return k

    def cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term number) of each occurrence in order."""
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = self.inside[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        if not len(starts):
            return starts, starts
        low = self.lower[raw]
        data, h, mask = low.tobytes(), self.hash, self.mask
        values = np.array([h(data[a:b]) & mask for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
        found, first, group = np.unique(values, return_index=True, return_inverse=True)
        numbers = np.array([self.number(v, data[a:b]) for v, a, b in zip(found.tolist(), starts[first].tolist(), ends[first].tolist())], np.int64)
        out = numbers[group]
        length, model = ends - starts, starts[first][group]
        same = length == (ends - starts)[first][group]
        size = np.where(same, length, 0)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = low[np.repeat(starts, size) + at] != low[np.repeat(model, size) + at]
        same[np.repeat(np.arange(len(size)), size)[differs]] = False
        for i in np.flatnonzero(~same).tolist():
            out[i] = self.number(int(values[i]), data[starts[i] : ends[i]])
        return np.searchsorted(offsets, starts, "right") - 1, out


class Counter:
    """Occurrences and documents of each (language, source, term), summed up as far as memory is set aside for it."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.tokenizer.clear()
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.n, self.docs = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, column: pa.Array, langs: list[str], sources: list[str]) -> None:
        raw, offsets = common.text_buffers(column)
        text, term = self.tokenizer.cut(raw, offsets)
        width = max(len(self.tokenizer.terms), 1)
        pair, n = np.unique(text * width + term, return_counts=True)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], np.int64)
        keys = group[pair // width] << 32 | pair % width
        self.keys, self.n, self.docs = np.concatenate([self.keys, keys]), np.concatenate([self.n, n]), np.concatenate([self.docs, np.ones(len(keys), np.int64)])

    def compact(self) -> None:
        self.keys, inverse = np.unique(self.keys, return_inverse=True)
        sums = [np.zeros(len(self.keys), np.int64) for _ in range(2)]
        np.add.at(sums[0], inverse, self.n)
        np.add.at(sums[1], inverse, self.docs)
        self.n, self.docs = sums

    def full(self) -> bool:
        if len(self.keys) > PENDING:
            self.compact()
        return len(self.keys) > PENDING // 2 or len(self.tokenizer.terms) > TERMS

    def take(self) -> Iterator[pa.RecordBatch]:
        """What has been counted, in batches; nothing is left."""
        self.compact()
        terms, groups = pa.array(self.tokenizer.terms, pa.binary()), [*self.groups]
        langs, sources = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
        for k in range(0, len(self.keys), 50_000):
            keys = self.keys[k : k + 50_000]
            group = pa.array(keys >> 32)
            columns = [langs.take(group), sources.take(group), terms.take(pa.array(keys & 0xFFFFFFFF)).cast(pa.string()), pa.array(self.n[k : k + 50_000]), pa.array(self.docs[k : k + 50_000])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        self.clear()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter(Tokenizer())
    for batch in batches:
        offsets = common.text_buffers(batch.column("text"))[1]
        for i, j in common.row_chunks(offsets, BLOCK_BYTES):
            part = batch.slice(i, j - i)
            counter.add(part.column("text"), part.column("lang").to_pylist(), part.column("source").to_pylist())
            if counter.full():
                yield from counter.take()
    yield from counter.take()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(text, lang, source): occurrences of each term, and how many documents hold it."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return plain.mapInArrow(_counted, PARTIAL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total) for n <= total < 2**53, without a product that overflows."""
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sum of each run of values; empty runs give 0."""
    out = np.zeros(len(starts), np.int64)
    some = np.flatnonzero(stops > starts)
    if len(some):
        out[some] = np.add.reduceat(np.append(values, 0), np.stack([starts[some], stops[some]], 1).ravel())[::2]
    return out


class Shard:
    """One language's counts of some of its terms as a CSR matrix, a row for each source, with all sources of the language."""

    def __init__(self, counts: pa.Table, groups: pa.Table):
        groups = groups.sort_by([("source", "ascending")])
        self.sources = groups.column("source").combine_chunks()
        self.total = groups.column("total").to_numpy()
        self.lang_total = int(groups.column("lang_total")[0].as_py())
        words = pc.unique(counts.column("term"))
        self.terms = words.take(pc.array_sort_indices(words))  # UTF-8 order: a term's number breaks ties
        row = pc.index_in(counts.column("source"), self.sources).to_numpy()
        col = pc.index_in(counts.column("term"), self.terms).to_numpy()
        order = np.lexsort([col, row])
        self.col, self.n = col[order].astype(np.int64), counts.column("n").to_numpy()[order]
        self.row = row[order].astype(np.int64)
        self.start = np.searchsorted(self.row, np.arange(len(self.sources) + 1))
        self.p = scaled(self.n + 2, self.total[self.row])
        self.none = scaled(np.full(len(self.total), 2), self.total) if len(self.terms) else np.zeros(len(self.total), np.int64)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each source its divergences from all later ones, summed over the shard's terms.

        Terms that neither source has add the same each; of those that only this
        source has, equal counts are taken together; the rest follows the later
        sources' entries, summed row by row.
        """
        size = len(self.terms)
        dense = np.zeros(size, np.int64)
        for a in range(len(self.sources) - 1):
            own = slice(self.start[a], self.start[a + 1])
            dense[:] = self.none[a]
            dense[self.col[own]] = self.p[own]
            rest = slice(self.start[a + 1], len(self.col))
            col, p, row = self.col[rest], self.p[rest], self.row[rest]
            starts, stops = self.start[a + 1 : -1] - rest.start, self.start[a + 2 :] - rest.start
            mine, none = dense[col], self.none[a + 1 :]
            held = np.zeros(size, bool)
            held[self.col[own]] = True
            shared = held[col]
            # over the later source's terms, less what those that both hold would give were they this source's alone
            value = divergence(mine, p) - np.where(shared, divergence(mine, self.none[row]), 0)
            out = _sums(value, starts, stops)
            distinct, times = np.unique(self.p[own], return_counts=True)
            for k in range(0, len(distinct), 1024):
                out += (divergence(distinct[k : k + 1024, None], none[None, :]) * times[k : k + 1024, None]).sum(0)
            both = _sums(shared.astype(np.int64), starts, stops)
            neither = size - (own.stop - own.start) - (stops - starts) + both
            yield a, out + neither * divergence(self.none[a], none)

    def over(self, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each source its terms, at most top, that it uses more than its language does, with their divergence."""
        every = np.zeros(len(self.terms), np.int64)
        np.add.at(every, self.col, self.n)
        q = scaled(every + 2, np.full(len(every), self.lang_total))[self.col]
        value = divergence(self.p, q)
        for a in range(len(self.sources)):
            k = np.flatnonzero(self.p[self.start[a] : self.start[a + 1]] > q[self.start[a] : self.start[a + 1]]) + self.start[a]
            k = k[np.lexsort([self.col[k], -value[k]])[:top]]
            if len(k):
                yield a, self.col[k], value[k]


def _measured(top: int) -> Callable[..., Iterator[pa.RecordBatch]]:
    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        shard, lang = Shard(counts, groups), groups.column("lang")[0].as_py()
        source, item, value, part = [], [], [], []
        n = len(shard.sources)
        for a, sums in shard.pairs():
            later = np.arange(a + 1, n)
            source += [np.full(n - a - 1, a)]
            item.append(shard.sources.take(pa.array(later)))
            value.append(sums)
            part.append(np.zeros(n - a - 1, bool))
        for a, terms, sums in shard.over(top):
            source.append(np.full(len(terms), a))
            item.append(shard.terms.take(pa.array(terms)))
            value.append(sums)
            part.append(np.ones(len(terms), bool))
        if not source:
            return pa.table({c: pa.array([], t) for c, t in zip(("lang", "source", "part", "item", "value"), [pa.string()] * 4 + [pa.int64()])})
        rows = shard.sources.take(pa.array(np.concatenate(source)))
        kind = pa.array(np.where(np.concatenate(part), "term", "pair"))
        items = pa.chunked_array(item, pa.string())
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "source": rows, "part": kind, "item": items, "value": pa.array(np.concatenate(value))})

    return run


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source): how each source's use of words differs.

    Terms are cut and counted in the tasks that read the documents; their counts
    are summed by (lang, source, term), and those in fewer than min_docs documents
    of the language go. The kept ones are dealt by a hash of the term to shards of a
    language, each of which meets all of the language's sources, with their totals,
    in one task and gives partial sums for each pair of sources, and its best terms.
    A shard has about `shard` counts: by default eight for each pair of sources of the
    largest language, from SHARD_LEAST to SHARD_MOST. No step gathers a language.

    A null text, lang or source is ''. Texts without terms, empty ones among them, still make their
    group occur; a language without kept terms has value 0 for all pairs, a language of one
    source has no pairs. Texts of any length are cut whole; repeated rows count each.
    Equal values rank by the item's UTF-8 bytes. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    word = Window.partitionBy("lang", "term")
    kept = counts(docs).withColumns({"held": F.sum("docs").over(word), "nth": F.row_number().over(word.orderBy("source"))})
    kept = common.stored(kept.filter(F.col("held") >= min_docs).select("lang", "source", "term", "n", (F.col("nth") == 1).alias("new")), "divergence-counts")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("new").cast("long")).alias("terms"), F.count("*").alias("entries"))
    groups = common.stored(named.join(own, ["lang", "source"], "left").na.fill(0), "divergence-groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("terms").alias("v"), F.sum("entries").alias("entries"), F.count("*").alias("sources"))
    width = F.lit(shard) if shard else F.least(F.greatest(8 * F.col("sources") * F.col("sources"), F.lit(SHARD_LEAST)), F.lit(SHARD_MOST))
    langs = common.stored(langs.withColumn("shards", F.greatest(F.ceil(F.col("entries") / width), F.lit(1)).cast("int")), "divergence-langs")

    spread = groups.join(langs.select("lang", "lang_n", "v", "shards"), "lang").select(
        "lang", "source", (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
    )
    dealt = kept.join(langs.select("lang", "shards"), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    partial = dealt.groupBy("lang", "shard").cogroup(spread.groupBy("lang", "shard")).applyInArrow(_measured(top), BLOCK)
    partial = common.stored(partial, "divergence-partial")

    pairs = partial.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    mirrored = pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(mirrored).unionByName(partial.filter("part = 'term'")).withColumn("rank", F.row_number().over(best))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(common.read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
whole AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
