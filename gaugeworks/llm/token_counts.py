"""Token counts of a unigram vocabulary by count-only Viterbi (operator 2)."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: The mark that stands for a space, before each word.
SPACE = "▁"
#: What an unknown character costs beyond the vocabulary's least score.
UNKNOWN = 10.0
#: Scores are multiples of this, so sums of them are exact in double precision.
UNIT = 2.0**-16
#: Bounds the distinct words a worker remembers.
MEMO = 400_000


@functools.cache
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces of a sentencepiece file with the scores of a unigram model over them.

    The file's own scores are ranks; by Zipf's law a piece of rank r gets -ln(r + 2), rounded to UNIT.
    Control pieces are left out; pieces that stand for single bytes are kept by that name.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            rank = -sp.get_score(i) if not sp.is_byte(i) else sp.get_piece_size()
            out.append((sp.id_to_piece(i), -round(math.log(rank + 2) / UNIT) * UNIT))
    return tuple(out)


class CountingViterbi:
    """Best score and number of pieces of a word's best segmentation.

    An Aho-Corasick automaton over the vocabulary names, at each place, the
    pieces that end there, the longest first. best[j] is the score of the best
    way to j and count[j] its pieces. The tokenizer goes from left to right and
    keeps the first of equal scores, which is the one whose last piece begins
    first: the longest piece, so a later one only wins with a strictly better
    score. A character that is no piece of its own may also be unknown, at UNKNOWN
    below the least score; it counts as its bytes where these are pieces, and
    otherwise a run of unknown characters counts as one.
    """

    def __init__(self, pieces: tuple[tuple[str, float], ...], byte_fallback: bool = True):
        import ahocorasick

        self.score = dict(pieces)
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.score for b in range(256))
        self.unknown = min(self.score.values()) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.memo: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """(pieces, score) of text, a word with its mark."""
        n = len(text)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        ends_unknown = [False] * (n + 1)
        best[0] = 0.0
        done = 0  # places before it have their final value

        def unknown(j: int) -> None:
            """Character j - 1 as an unknown one, after all pieces that end at j: its piece would be the shortest."""
            if text[j - 1] not in self.score and best[j - 1] + self.unknown > best[j]:
                more = len(text[j - 1].encode("utf-8")) if self.bytes else int(not ends_unknown[j - 1])
                best[j], count[j], ends_unknown[j] = best[j - 1] + self.unknown, count[j - 1] + more, True

        for end, (length, score) in self.automaton.iter(text):
            while done < end:
                done += 1
                unknown(done)
            j = end + 1
            if (total := best[j - length] + score) > best[j]:
                best[j], count[j], ends_unknown[j] = total, count[j - length] + 1, False
        while done < n:
            done += 1
            unknown(done)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text: each space begins a word, and so does the text."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE)
        words = (marked if marked[0] == SPACE else SPACE + marked).split(SPACE)[1:]
        if len(self.memo) > MEMO:
            self.memo = {}
        for w in set(words).difference(self.memo):
            self.memo[w] = self.word(SPACE + w)
        found = [*map(self.memo.__getitem__, words)]
        return sum(c for c, _ in found), math.fsum(s for _, s in found)


@functools.cache
def _counter(path: str) -> CountingViterbi:
    return CountingViterbi(vocabulary(path))


def _run(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            rows = [counter.count(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([c for c, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score) of docs(doc_id, text); no token is ever made, and nothing is shuffled.

    A null or empty text has no tokens and score 0; a null doc_id stays null;
    repeated rows have repeated results; other columns are ignored.
    """
    return common.texts(docs).mapInArrow(_run(path), "doc_id long, n_tokens long, score double")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
