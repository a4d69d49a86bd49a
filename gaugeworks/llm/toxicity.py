"""Toxicity by compression distance to two zstandard dictionaries (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learn

#: Labelled rows that training reads, at most.
TRAINING_ROWS = 12_000
#: Bytes of ordinary text in the dictionaries.
ORDINARY_BYTES = 8192
#: Typical words in the toxic dictionary, at most.
TYPICAL_WORDS = 1500
#: Documents that must hold a word, and how many times likelier it must be in toxic ones.
SUPPORT, RATIO = 4, 20
#: A window is a word written so often: the cost of a frame then hides no short word.
COPIES = 4
LEVEL = 13
#: Bounds the distinct words a worker remembers.
MEMO = 300_000

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window(word: str) -> bytes:
    return " ".join(["", *[word] * COPIES, ""]).encode("utf-8")


def compressor(content: bytes):
    """A compressor with a raw dictionary and frames without optional fields."""
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=32, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=held)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    coefficients: list[float]


class Distance:
    """Bytes that the toxic dictionary saves on a window, against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.a, self.b = compressor(ordinary), compressor(toxic)
        self.memo: dict[str, int] = {}

    def saved(self, text: str) -> np.ndarray:
        found = words(text)
        if len(self.memo) > MEMO:
            self.memo = {}
        for w in set(found).difference(self.memo):
            x = window(w)
            self.memo[w] = len(self.a.compress(x)) - len(self.b.compress(x))
        return np.fromiter(map(self.memo.__getitem__, found), np.int64, len(found))


def features(saved: np.ndarray, threshold: int) -> tuple[float, float, float]:
    hits = int((saved >= threshold).sum())
    return float(hits > 0), float(np.log1p(hits)), min(20.0, 100.0 * hits / len(saved)) if len(saved) else 0.0


def _fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def _document_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label, n): documents of each label that hold a word, by batch."""
    from collections import Counter

    for batch in batches:
        count: Counter[tuple[str, int]] = Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            count.update((w, label) for w in set(words(text)) if len(w) >= 3)
        found = [*count]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in found], pa.string()), pa.array([x for _, x in found], pa.int32()), pa.array([count[k] for k in found], pa.int64())],
            names=["word", "label", "n"],
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """Train on labels(doc_id, <label>) whose crc32(doc_id) mod 5 isn't 0, at most `rows` of them, chosen by a hash.

    Folds 1 to 3 give the dictionaries, fold 4 the threshold and the calibration.
    The ordinary dictionary is trained by zstandard on windows of ordinary text.
    The toxic one has the same content and the windows of words typical of toxic
    documents, so on ordinary text the two compress alike: words in at least SUPPORT
    toxic documents and RATIO times likelier there, ties broken by the word. Missing, null and
    other labels than 0 and 1 are left out, of an id's different labels the least counts, of its texts the least; with no example of either class the
    scores are the other's share.

    Dictionaries trained on running text of either class, and windows of running text,
    were tried and told the classes apart less well (see README).
    """
    import zstandard

    wanted = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (_fold() != 0))
    picked = wanted.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    known = common.texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    known = common.stored(known.withColumn("fold", _fold()), "labelled")  # a row for each id at most
    counted = known.filter("fold < 4").select("text", "label").mapInArrow(_document_words, "word string, label int, n long")
    size = {r["label"]: r["n"] for r in known.filter("fold < 4").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    by_word = counted.groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0")
    )
    ratio = ((F.col("n1") + 0.5) / n1) / ((F.col("n0") + 0.5) / n0)
    typical = by_word.filter((F.col("n1") >= SUPPORT) & (ratio >= RATIO)).orderBy(F.desc("n1"), "word").limit(TYPICAL_WORDS).collect()
    # least frequent first: what stands last is cheapest to refer to
    content = b"".join(window(r["word"]) for r in reversed(typical))
    some = known.filter("fold < 4 and label = 0").orderBy(F.xxhash64("doc_id", F.lit(1))).limit(500).select(F.lower("text").alias("text"))
    pieces = [t[i : i + 64].encode("utf-8") for (t,) in some.collect() for i in range(0, len(t), 64)]
    try:
        ordinary = zstandard.train_dictionary(ORDINARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        ordinary = b"".join(pieces)[:ORDINARY_BYTES] or b" the of and "
    toxic = ordinary + content
    schema = "label int, saved array<int>"

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(ordinary, toxic)
        for batch in batches:
            rows_ = [np.bincount(np.clip(distance.saved(t), 0, 15), minlength=16).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows_, pa.list_(pa.int32()))], names=["label", "saved"])

    rest = known.filter("fold = 4").select("text", "label").mapInArrow(measure, schema).collect()  # 16 counts an id, at most `rows` ids
    counts = np.array([r["saved"] for r in rest], np.int64).reshape(-1, 16)
    y = np.array([r["label"] for r in rest], np.float64)
    if len(set(y.tolist())) < 2:
        share = n1 / (n1 + n0) if size.get(1) and size.get(0) else float(bool(size.get(1)))
        share = min(0.99, max(0.01, share))
        return Model(ordinary, toxic, 3, [0.0, 0.0, 0.0, float(np.log(share / (1 - share)))])
    total = np.maximum(counts.sum(1), 1)
    best = max(range(2, 8), key=lambda t: (learn.auc(counts[:, t:].sum(1) / total, y), -t))
    hits = counts[:, best:].sum(1)
    x = np.column_stack([hits > 0, np.log1p(hits), np.minimum(20, 100 * hits / total)])
    return Model(ordinary, toxic, best, learn.logistic(x, y, ridge=0.1).tolist())


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of docs(doc_id, text); no shuffle.

    A null text counts as empty; texts without words have the score of a
    document without a hit. Null ids stay null and are never held out; repeated rows have repeated
    results; a text of any length is read as a whole; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, b = Distance(model.ordinary, model.toxic), np.array(model.coefficients)
        for batch in batches:
            x = np.array([features(distance.saved(t), model.threshold) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            p = learn.probability(x, b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, b = Distance(model.ordinary, model.toxic), np.array(model.coefficients)
        for batch in batches:
            x = np.array([features(distance.saved(t or ""), model.threshold) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield batch.filter(pa.array(learn.probability(x, b) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
