"""BPE encoding by speculation and verification, and decoding (operator 10)."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Bounds the distinct pieces a worker remembers.
MEMO = 300_000
#: Later than every rank.
NONE = 1 << 60
#: Words of more bytes are merged one by one, with a heap.
LONG = 64


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [shown[b] for b in range(256)]


class SpeculativeBpe:
    """Encodes words of a BPE vocabulary whose words end in a suffix, merges ranked by order.

    1. Speculate: cut each word from the left into the longest tokens of the
       vocabulary (only tokens that BPE itself leaves whole).
    2. Verify: a cut is BPE's own result exactly when BPE would keep each pair of
       neighbours apart. All distinct pairs of a block of words are tested at
       once: the border between two tokens is crossed if, on undoing their
       merges latest first, some pair at the border has a merge that would have
       been made before the ones that hide it.
    3. Words with a failing pair, and only those, are merged rank by rank.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in (self.vocab | self.special).items():
            self.tokens[i] = t
        self.normalizer = Tokenizer.from_file(path).normalizer
        words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain, self.pattern = regex.compile(words), regex.compile(rf"\n|{words}")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(merges)}
        made = [self.vocab[a + b] for a, b in merges]
        self.merged_list, self.merged = made, np.array(made)
        # by token: the rank of the merge that makes it (-1: none), and that merge's sides
        size = len(self.tokens)
        self.made_by, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        for r, ((a, b), t) in enumerate(zip(self.rank, made)):
            if self.made_by[t] < 0:
                self.made_by[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        whole = self.made_by < 0
        merged = np.flatnonzero(~whole)
        for start in range(0, len(merged), 1 << 16):  # a token is whole if its own last border holds
            t = merged[start : start + (1 << 16)]
            whole[t] = self.joins(t)
        self.build_trie(np.flatnonzero(whole))
        self.chunks: dict[str, bytes] = {"": b""}
        self.tested = self.failed = 0

    def build_trie(self, tokens: np.ndarray) -> None:
        """A trie of the tokens over symbols: bytes, and 256 + byte for the last one of a word."""
        shown = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(shown)}
        self.base = np.array([self.vocab.get(c, -1) for c in shown] + [self.vocab.get(c + self.suffix, -1) for c in shown])
        children: dict[int, int] = {}
        accepts = [-1]
        for t in tokens.tolist():
            if (text := self.tokens[t]) in self.special:
                continue
            node, symbols = 0, [byte_of[c[0]] + 256 * (len(c) > 1) for c in self.letters(text)]
            for x in symbols:
                if (to := children.get(node * 512 + x)) is None:
                    to = children[node * 512 + x] = len(accepts)
                    accepts.append(-1)
                node = to
            accepts[node] = t
        keys = np.array([*children], np.int64)
        order = np.argsort(keys)
        self.edges, self.targets, self.accepts = keys[order], np.array([*children.values()])[order], np.array(accepts)

    def joins(self, tokens: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each token rank by rank gives that token alone."""
        return np.array([self.merge([self.vocab[c] for c in self.letters(self.tokens[t])]) == [t] for t in tokens])

    def letters(self, shown: str) -> list[str]:
        """The smallest tokens of a word: its characters, the last one with the suffix if the word ends there."""
        s = self.suffix
        if s and shown.endswith(s) and len(shown) > len(s):
            body = shown[: -len(s)]
            return [*body[:-1], body[-1] + s]
        return [*shown]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact BPE: repeatedly the pair of lowest rank, leftmost first."""
        get, none = self.rank.get, NONE
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            ids[i : i + 2] = [t := self.merged_list[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], t), none)
            if i < len(ranks):
                ranks[i] = get((t, ids[i + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in n log n steps."""
        import heapq

        n = len(ids)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        ids = [*ids]
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged_list[r], False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (ids[i], ids[after[j]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in self.rank:
                heapq.heappush(heap, (self.rank[p], before[i], *p))
        return [t for t, on in zip(ids, alive) if on]

    def propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy longest match in all words at once: by position the token that starts there, or -1."""
        out = np.full(len(symbols), -1)
        end, begin, at = ends.copy(), starts.copy(), starts.copy()
        node, best, best_end = np.zeros(len(starts), np.int64), np.full(len(starts), -1), starts.copy()
        while len(begin):
            key = node * 512 + symbols[np.minimum(at, end - 1)]
            k = np.searchsorted(self.edges, key)
            k[k == len(self.edges)] = 0
            step = (self.edges[k] == key) & (at < end)
            node = np.where(step, self.targets[k], 0)
            at = at + step
            token = np.where(step, self.accepts[node], -1)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, at, best_end)
            stop = ~step
            out[begin[stop]] = best[stop]
            begin, at = np.where(stop, best_end, begin), np.where(stop, best_end, at)
            if stop.any():
                going = begin < end
                end, begin, at, node, best, best_end = (x[going] for x in (end, begin, at, node, best, best_end))
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.tokens) + b
        k = np.searchsorted(self.pair_keys, key)
        k[k == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[k] == key) & (a >= 0) & (b >= 0), self.pair_ranks[k], NONE)

    def merge_block(self, rows: np.ndarray) -> np.ndarray:
        """Exact BPE of many words of about the same length: one merge in every unfinished row a round.

        rows: ids, filled up with -1 on the right; so is the result.
        """
        out, n, width = np.full_like(rows, -1), np.arange(len(rows)), rows.shape[1]
        ranks = self.pair_rank(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), width - 1)
        columns = np.arange(width)
        while len(n):
            i = ranks.argmin(1)
            low = ranks[np.arange(len(n)), i]
            done = low == NONE
            out[n[done]] = rows[done]
            n, rows, ranks, i, low = n[~done], rows[~done], ranks[~done], i[~done], low[~done]
            if not len(n):
                break
            r = np.arange(len(n))
            shift = np.minimum(columns + (columns > i[:, None]), width - 1)
            rows = np.take_along_axis(rows, shift, 1)
            rows[:, -1] = -1
            rows[r, i] = self.merged[low]
            ranks = np.take_along_axis(ranks, np.minimum(columns[:-1] + (columns[:-1] >= i[:, None]), width - 2), 1)
            ranks[:, -1] = NONE
            inner = i > 0
            ranks[r[inner], i[inner] - 1] = self.pair_rank(rows[r[inner], i[inner] - 1], rows[r[inner], i[inner]])
            inner = i < width - 1
            ranks[r[inner], i[inner]] = self.pair_rank(rows[r[inner], i[inner]], rows[r[inner], i[inner] + 1])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each a[i], b[i] apart; all pairs step at once."""
        a, b, size = a.copy(), b.copy(), len(self.tokens)
        good = np.ones(len(a), bool)
        # a merge at the border counts if it comes before limit: the rank of the
        # last merge undone; at equal rank only the one further left is made first
        limit = np.full(len(a), NONE)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            key = x * size + y
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            r = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)
            bad = r < limit[todo]
            good[todo[bad]] = False
            todo, x, y = todo[~bad], x[~bad], y[~bad]
            rx, ry = self.made_by[x], self.made_by[y]
            going = (rx >= 0) | (ry >= 0)
            todo, x, y, rx, ry = todo[going], x[going], y[going], rx[going], ry[going]
            # undo the later merge; of two equal ones the right one was made last
            undo_left = rx > ry
            a[todo] = np.where(undo_left, self.right[x], x)
            b[todo] = np.where(undo_left, y, self.left[y])
            # a border merge ties with an undone left merge only to its right (too late),
            # with an undone right merge to its left (in time)
            limit[todo] = np.where(undo_left, rx, ry + 1)
        return good

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        if self.suffix:
            symbols[ends - 1] += 256
        short = lengths <= LONG
        found = self.propose(symbols, starts[short], ends[short])
        places = np.flatnonzero(found >= 0)
        tokens = found[places]
        owner = np.searchsorted(ends, places, "right")
        same = np.flatnonzero(owner[1:] == owner[:-1])
        keys, which = np.unique(tokens[same] * len(self.tokens) + tokens[same + 1], return_inverse=True)
        good = self.compatible(keys // len(self.tokens), keys % len(self.tokens))
        wrong = np.zeros(len(words), bool)
        wrong[owner[same[~good[which]]]] = True
        self.tested += len(words)
        self.failed += int(wrong.sum())
        found[np.repeat(wrong, lengths)] = -1
        low = 1
        for high in (8, 12, 16, 24, 32, LONG):
            some = np.flatnonzero(wrong & (lengths > low) & (lengths <= high))
            low = high
            for k in range(0, len(some), 20_000):
                w = some[k : k + 20_000]
                cell = starts[w][:, None] + np.arange(high)
                used = cell < ends[w][:, None]
                rows = np.where(used, self.base[symbols[np.minimum(cell, len(symbols) - 1)]], -1)
                found[cell[used]] = self.merge_block(rows)[used]
        counts = np.add.reduceat(found >= 0, starts) if len(words) else np.zeros(0, np.int64)
        flat = found[found >= 0].astype("<u4").tobytes()
        stop = np.cumsum(counts) * 4
        out = [flat[a:b] for a, b in zip((stop - counts * 4).tolist(), stop.tolist())]
        for i in np.flatnonzero(~short):
            out[i] = np.array(self.merge_long(self.base[symbols[starts[i] : ends[i]]].tolist()), "<u4").tobytes()
        return out

    def cut(self, pieces: list[str]) -> list[list[str]]:
        """Words of each piece of text without special tokens. Line feeds part the pieces while they are normalised."""
        joined = "\x00".join(pieces)
        text = (self.normalizer.normalize_str(joined) if self.normalizer else joined).replace("\x00", "\n")
        rows: list[list[str]] = [[]]
        for w in self.pattern.findall(text):
            if w == "\n":
                rows.append([])
            else:
                rows[-1].append(w)
        return rows

    def learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if "\x00" not in p and not (self.specials and self.specials.search(p))]
        rows = self.cut(plain) if plain else []
        odd = [p for p in pieces if "\x00" in p or self.specials and self.specials.search(p)]
        parts = [[x for x in self.specials.split(p) if x] if self.specials else [p] for p in odd]
        for part in parts:
            rows.append([])
            for x in part:
                rows[-1] += [x] if x in self.special else self.plain.findall(self.normalizer.normalize_str(x) if self.normalizer else x)
        words = [*{w for r in rows for w in r if w not in self.special}]
        ids = dict(zip(words, self.encode_words(words))) if words else {}
        ids |= {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        for p, r in zip([*plain, *odd], rows):
            self.chunks[p] = ids[r[0]] if len(r) == 1 else b"".join([ids[w] for w in r])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Neither the normaliser nor the word pattern acts across a space or line
        feed, so each distinct piece between them is worked out once.
        """
        rows = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.chunks) > MEMO:
            self.chunks = {"": b""}
        new = [*set().union(*rows).difference(self.chunks)]
        if new:
            self.learn(new)
        get = self.chunks.__getitem__
        return [b"".join(map(get, r)) for r in rows]

    def decode(self, ids: bytes) -> str:
        """Token strings with a space between: the vocabulary has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def _coder(path: str) -> SpeculativeBpe:
    """One a worker process: later tasks of the worker find its memory of pieces."""
    return SpeculativeBpe(path)


def _each(path: str, columns: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            offsets = common.text_buffers(batch.column("text"))[1]
            for i, j in common.row_chunks(offsets):
                part = batch.slice(i, j - i)
                ids = coder.encode(part.column("text").to_pylist())
                bounds = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=bounds[1:])
                if columns != "digest":
                    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<u4").view(np.int32)))
                if columns != "ids":
                    sha = [hashlib.sha256(x).hexdigest() for x in ids]
                    decoded = [hashlib.sha256(coder.decode(x).encode("utf-8")).hexdigest() for x in ids]
                    arrays = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha), pa.array(decoded)]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if columns == "both":
                        arrays, names = [*arrays, lists], [*names, "ids"]
                else:
                    arrays = [part.column("doc_id"), lists, pa.array([coder.decode(x) for x in ids], pa.string())]
                    names = ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of docs(doc_id, text).

    No shuffle: each row depends on itself alone. A null text is an empty one
    and has no ids; a null doc_id stays null; repeated rows give repeated
    results; other columns are ignored.
    """
    return common.texts(docs).mapInArrow(_each(vocabulary, "ids"), "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): encode() by its hashes."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return common.texts(docs).mapInArrow(_each(vocabulary, "both" if with_ids else "digest"), schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
