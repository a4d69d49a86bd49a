"""How the tokens of two tokenizers line up over a corpus (operator 11)."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import byte_alphabet
from .token_files import OTHER_SPACE, PieceEncoder

#: Bounds the distinct pieces a worker remembers.
MEMO = 400_000
ENCODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, m array<int>"


class Aligned:
    """Strings cut by both tokenizers: by string the numbers of tokens, its groups as text and its links."""

    def __init__(self, good: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, texts: list[bytes], links: np.ndarray, bounds: np.ndarray):
        self.good, self.n_a, self.n_b, self.texts, self.links, self.bounds = good, n_a, n_b, texts, links, bounds


class Aligner:
    """Encodes texts with a byte-level BPE (A, a space before the text) and a sentencepiece BPE (B, which adds the space).

    Neither vocabulary has a token that holds a space after another character, so
    both may cut a text before each single space: a piece between spaces has the
    same tokens wherever it stands, both cut at its end, and its groups and links
    are worked out once. Texts with spaces in a row, at the end or between other
    white space are encoded as a whole, as are those with a piece that either
    tokenizer doesn't give back.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.encoder = PieceEncoder(a_path)
        self.encoder.tokenizer.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode("utf-8")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(map(self.pieces.id_to_piece, range(self.pieces.get_piece_size())))]
        if any(" " in (t := b.lstrip(b" ").decode("utf-8", "replace")) and t for b in self.b_bytes):
            raise ValueError("vocabulary B has a piece with a space inside: texts can't be cut at spaces")
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)
        self.a_length, self.b_length = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        ends = ((self.a_size, ","), (self.a_size, "|"), (self.b_size, ","), (self.b_size, ";"))
        self.shown = [f"{i}{end}".encode() for size, end in ends for i in range(size)]
        self.clear()

    def clear(self) -> None:
        self.encoder.clear()
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.links: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)

    def align(self, strings: list[str], a_ids: list[bytes], b_ids: list[list[int]]) -> Aligned:
        """Groups and links of strings with their A ids, packed in four bytes each, and B ids.

        Strings that their A or B bytes don't spell are not good and have no tokens.
        """
        n_a, n_b = np.array([len(x) // 4 for x in a_ids], np.int64), np.array([*map(len, b_ids)], np.int64)
        a = np.frombuffer(b"".join(a_ids), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, n_b.sum())
        raw = [s.encode("utf-8") for s in strings]
        good = np.ones(len(raw), bool)
        size = np.array([*map(len, raw)], np.int64)
        for ids, n, length, spelled in ((a, n_a, self.a_length, self.a_bytes), (b, n_b, self.b_length, self.b_bytes)):
            total = np.concatenate([[0], np.cumsum(length[ids])])
            stop = np.cumsum(n)
            own = total[stop] - total[stop - n]
            if not ((own == size).all() and b"".join(map(spelled.__getitem__, ids.tolist())) == b"".join(raw)):
                good &= [b"".join(map(spelled.__getitem__, ids[j - k : j].tolist())) == r for j, k, r in zip(stop.tolist(), n.tolist(), raw)]
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        at = np.searchsorted(b_end, a_end)
        hit = b_end[np.minimum(at, max(len(b_end) - 1, 0))] == a_end if len(b_end) else np.zeros(len(a), bool)
        i, j = np.flatnonzero(hit), at[hit]
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[i] = b_last[j] = 1
        codes = np.concatenate([a + self.a_size * a_last, 2 * self.a_size + b + self.b_size * b_last])
        group = np.concatenate([2 * (np.cumsum(a_last) - a_last), 2 * (np.cumsum(b_last) - b_last) + 1])
        shown = [*map(self.shown.__getitem__, codes[np.argsort(group, kind="stable")].tolist())]
        stop = np.cumsum(n_a + n_b)
        texts = [b"".join(shown[x:y]) for x, y in zip((stop - n_a - n_b).tolist(), stop.tolist())]
        bounds = np.searchsorted(i, np.concatenate([[0], np.cumsum(n_a)]))
        return Aligned(good, n_a, n_b, texts, b[j] * self.a_size + a[i], bounds)

    def learn(self, new: list[str]) -> None:
        found = self.align([f" {p}" for p in new], [self.encoder.rest[p] for p in new], self.pieces.encode(new, num_threads=1))
        self.known |= dict(zip(new, range(len(self.texts), len(self.texts) + len(new))))
        self.texts += found.texts
        packed = found.links.astype("<i8").tobytes()
        self.links += [packed[8 * x : 8 * y] for x, y in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist())]
        counts = np.stack([found.good, found.n_a, found.n_b, np.diff(found.bounds)], 1)
        self.counts = np.concatenate([self.counts, counts.astype(np.int64)])

    def whole(self, text: str) -> Aligned:
        ids = self.encoder.tokenizer.encode(f" {text}", add_special_tokens=False).ids
        return self.align([f" {text}"], [np.array(ids, "<u4").tobytes()], [self.pieces.encode(text, num_threads=1)])

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """By text: (number of A tokens, of B tokens, of links), the groups as text, the links as packed b * a_size + a."""
        if len(self.known) > MEMO:
            self.clear()
        cut: list[list[str] | None] = []
        for t in texts:
            plain = "  " not in t and " \n" not in t and not any(map(t.__contains__, OTHER_SPACE))
            odd = "  " in t or t[:1] == " " or t[-1:] == " " or not plain and self.encoder.unsafe.search(f" {t}")
            cut.append(None if odd else t.split(" ") if t else [])
        new = [*set().union(*(c for c in cut if c)).difference(self.known)]
        if new:
            self.learn(new)
        counts, shown, links = np.zeros((len(texts), 3), np.int64), [b""] * len(texts), [b""] * len(texts)
        get = self.known.__getitem__
        for k, (t, c) in enumerate(zip(texts, cut)):
            if c is not None:
                at = [*map(get, c)]
                own = self.counts[at]
                if own[:, 0].all():
                    counts[k] = own[:, 1:].sum(0)
                    shown[k] = b"".join(map(self.texts.__getitem__, at))
                    links[k] = b"".join(map(self.links.__getitem__, at))
                    continue
            found = self.whole(t)
            counts[k] = found.n_a[0], found.n_b[0], len(found.links)
            shown[k], links[k] = found.texts[0], found.links.astype("<i8").tobytes()
        return counts, [s.removesuffix(b";") for s in shown], links


@functools.cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One a worker process: later tasks of the worker find its memory of pieces."""
    return Aligner(a_path, b_path)


def _each(a_path: str, b_path: str, with_groups: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            offsets = common.text_buffers(batch.column("text"))[1]
            for i, j in common.row_chunks(offsets):
                part = batch.slice(i, j - i)
                counts, shown, links = aligner.documents(part.column("text").to_pylist())
                size = aligner.a_size * aligner.b_size
                own = np.repeat(np.arange(j - i), [len(x) // 8 for x in links])
                keys, times = np.unique(own * size + np.frombuffer(b"".join(links), "<i8"), return_counts=True)
                bounds = pa.array(np.searchsorted(keys, np.arange(j - i + 1) * size).astype(np.int32))
                pair = keys % size
                columns = [
                    part.column("doc_id"), *(pa.array(counts[:, k]) for k in (0, 1, 2, 2)), pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in shown], pa.string()),
                    *(pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (pair % aligner.a_size, pair // aligner.a_size, times)),
                ]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "m"]
                if with_groups:
                    columns, names = [*columns, pa.array([s.decode() for s in shown], pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """Each document by both tokenizers: numbers of tokens, groups and links, and its links (a, b, m) as arrays, a pair of ids once with its multiplicity m.

    Groups are cut where tokens of both end; with_groups adds them as text, `a1,a2|b1;a3|b2,b3`. Every
    group ends with a link, so n_links equals n_groups. Texts that are null, empty or that the
    tokens of A or of B don't spell, byte for byte with a space before, have no tokens. No shuffle.
    """
    return common.texts(docs).mapInArrow(_each(a_path, b_path, with_groups), ENCODED + (", groups string" if with_groups else ""))


def postings(encoded: DataFrame) -> DataFrame:
    """(row, b, a, m): how often each document links each pair of ids."""
    return encoded.select("row", F.inline(F.arrays_zip("b", "a", "m")))


def pair_counts(postings: DataFrame) -> DataFrame:
    """(b, a, n, best) of each pair of ids linked anywhere: its links over all documents, and whether no A id has more with that B id."""
    counts = common.stored(postings.groupBy("b", "a").agg(F.sum("m").alias("n")), "alignment-pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("b", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs(doc_id, text).

    Documents are encoded once and written with their pair multiplicities. These are summed to a count
    for each pair of ids and a maximum for each B id, before the shuffle as far as a task
    sees them; then multiplicities and counts meet by (B id, A id) in sorted streams, which spill and of
    which large keys can be split, and what each document gets is summed by document.
    No table is broadcast by force, and no task gathers the documents of an id.

    Each row has a result of its own, whatever its doc_id; a null id stays null, repeated
    rows repeat and count each. Texts without tokens have zeros and ''. Ties for the highest
    count are all best. Texts of any length are taken whole. No rows give no rows; other columns are ignored.
    """
    encoded = common.stored(encode(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "alignment-documents")
    links = postings(encoded)
    known = common.stored(pair_counts(links), "alignment-counts")
    met = links.join(known.hint("merge"), ["b", "a"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    rows = encoded.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
