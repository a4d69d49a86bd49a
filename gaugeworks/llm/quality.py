"""Quality classification by co-training two views (operator 5)."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, learn

#: Labelled rows that training reads, and pseudo-labels that a view gives the other in a round for each class, at most.
TRAINING_ROWS, EXCHANGED = 10_000, 500
#: Rounds, and how sure a view must be of a pseudo-label.
ROUNDS, SURE = 3, 0.95
#: Weight of a pseudo-label in training, and groups in which the surest documents are ranked first.
PSEUDO_WEIGHT, SALTS = 0.3, 64
#: Buckets for hashed text pieces, for sources and for languages.
TEXT_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 48, 24, 8

SHAPE = [re.compile(p) for p in (r"[^\W\d_]", r"[A-ZÀ-Þ]", r"\d", r"[.,;:]", r"[!?]", r"[#$%&*|<>{}\\/=@^~_+]", r"\n")]


def text_view(text: str) -> np.ndarray:
    """Shape of the writing and hashed word beginnings, all of the text."""
    n = max(1, len(text))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    shape = [len(p.findall(text)) / n for p in SHAPE]
    shape += [
        math.log1p(len(words)) / 10, sum(map(len, words)) / max(1, len(words)) / 10, len(set(words)) / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)), min(1.0, n / max(1, len(lines)) / 500), float(not words),
    ]
    bag = np.zeros(TEXT_BUCKETS)
    for w in words:
        bag[zlib.crc32(w[-3:].encode("utf-8")) % TEXT_BUCKETS] += 1
    return np.concatenate([np.array(shape), np.sqrt(bag / max(1, len(words)))])


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language, source and stated size; nothing of the text."""
    out = np.zeros(LANG_BUCKETS + SOURCE_BUCKETS + 14)
    out[zlib.crc32((lang or "").encode("utf-8")) % LANG_BUCKETS] = 1
    out[LANG_BUCKETS + zlib.crc32((source or "").encode("utf-8")) % SOURCE_BUCKETS] = 1
    size = math.log2(1 + max(0, n_chars or 0))
    out[LANG_BUCKETS + SOURCE_BUCKETS + min(11, int(size / 1.5))] = 1
    out[-2], out[-1] = size / 20, float(n_chars is None)
    return out


def _views(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a = [text_view(t).astype(np.float32) for t in batch.column("text").to_pylist()]
        b = [metadata_view(*x).astype(np.float32) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.list_(pa.float32())), pa.array(b, pa.list_(pa.float32()))], names=["doc_id", "a", "b"])


def _fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def _surest(views: DataFrame, models: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[list[float], float]]]:
    """For each view (vector, pseudo-label) of the documents without a label that the other view is surest of.

    One pass scores every document. Each task keeps the EXCHANGED surest of each
    view and class with the vector that is passed on, so no join follows; ranks
    within salted groups and then over all of them pick the surest of the table.
    """
    schema = "taker int, label int, sure double, tie long, vector array<float>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(0)).view(np.uint64)
            tie = common.mix64(ids).view(np.int64)
            x = [_matrix(batch.column(c)) for c in "ab"]
            for giver in (0, 1):
                p = learn.probability(x[giver].astype(np.float64), models[giver])
                for label, sure in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(sure >= SURE)
                    found = sure[at], tie[at], x[1 - giver][at]
                    if (old := best.get((1 - giver, label))) is not None:
                        found = tuple(np.concatenate(both) for both in zip(old, found))
                    first = np.lexsort((found[1], -found[0]))[:EXCHANGED]
                    best[1 - giver, label] = tuple(f[first] for f in found)
        for (taker, label), (sure, tie, vectors) in best.items():
            n = len(sure)
            columns = [pa.array(np.full(n, taker, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(sure), pa.array(tie), pa.array([*vectors], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["taker", "label", "sure", "tie", "vector"])

    pool = views.filter("not labelled").select("doc_id", "a", "b").mapInArrow(run, schema)
    by = (F.desc("sure"), F.asc("tie"))
    salted = pool.withColumn("salt", F.pmod(F.col("tie"), F.lit(SALTS)))
    for group in (("taker", "label", "salt"), ("taker", "label")):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by, F.asc("vector")))).filter(F.col("rank") <= EXCHANGED)
    out: list[list[tuple[list[float], float]]] = [[], []]
    for r in salted.orderBy("taker", "label", "rank").collect():  # at most 4 * EXCHANGED rows
        out[r["taker"]].append((r["vector"], float(r["label"])))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _probability(column: pa.Array, model: np.ndarray) -> np.ndarray:
    return learn.probability(_matrix(column).astype(np.float64).reshape(-1, len(model) - 1), model)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, text_score, metadata_score, score, predicted) of docs(doc_id, text, lang, source, n_chars).

    Labels are learnt from labels(doc_id, <label>) whose crc32(doc_id) mod 5 isn't 0:
    folds 1 to 3 train, fold 4 calibrates, fold 0 is held out. At most
    TRAINING_ROWS of them are read, chosen by a hash. In each round both views
    score all documents without a label, and each passes its surest ones (at
    least SURE, at most EXCHANGED of each class) to the other's training set.
    At the end each view is calibrated on fold 4, and so is their combination,
    which scores every document.

    The views are written once, each vector with a mark whether its document has
    a label; a round is then one scan, without a join.

    Null texts count as empty, null languages and sources as '', a null size as
    unknown. Labels other than 0 and 1 are left out; of an id's different labels the
    least counts, of its different texts the least vector trains. Without labels of
    both classes all scores are 0.5. Null ids stay null and are never held out, repeated rows have repeated results; other columns are ignored.
    """
    rows = common.texts(docs, carry=("lang", "source", "n_chars"))
    keys = labels.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col(label).isin(0, 1), F.col(label)).cast("int").alias("label"))
    marks = keys.groupBy("doc_id").agg(F.min("label").alias("label"))
    wanted = marks.filter(F.col("label").isNotNull() & (_fold() != 0))
    picked = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)  # bounded, so it may be broadcast and collected
    vectors = rows.mapInArrow(_views, "doc_id long, a array<float>, b array<float>")
    joined = vectors.join(marks.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    views = common.stored(joined.withColumn("labelled", F.coalesce("labelled", F.lit(False))), "views")
    known = views.filter("labelled").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("x"), F.first("label").alias("label"))
    known = known.withColumn("fold", _fold()).select("x.a", "x.b", "label", "fold").orderBy("doc_id").collect()  # at most TRAINING_ROWS
    fold = np.array([r["fold"] for r in known])
    y = np.array([r["label"] for r in known], np.float64)
    x = [np.array([r[c] for r in known], np.float64) for c in "ab"]
    train, calibrate = fold != 4, fold == 4
    if len(known) == 0 or len(set(y[train])) < 2 or len(set(y[calibrate])) < 2:
        half = F.lit(0.5)
        return views.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), half.alias("text_score"), half.alias("metadata_score"), half.alias("score"), F.lit(1).alias("predicted"))
    sets = [(x[k][train], y[train], np.ones(int(train.sum()))) for k in (0, 1)]
    for _ in range(ROUNDS):
        models = tuple(learn.logistic(*s, ridge=1.0) for s in sets)
        for k, passed in enumerate(_surest(views, models)):
            if passed:
                more, y_new = np.array([v for v, _ in passed], np.float64), np.array([v for _, v in passed])
                # pseudo-labels of earlier rounds are replaced
                sets[k] = (np.concatenate([x[k][train], more]), np.concatenate([y[train], y_new]), np.concatenate([np.ones(int(train.sum())), np.full(len(more), PSEUDO_WEIGHT)]))
    models = tuple(learn.logistic(*s, ridge=1.0) for s in sets)
    z = [_logit(learn.probability(x[k][calibrate], models[k])) for k in (0, 1)]
    single = [learn.logistic(v[:, None], y[calibrate], ridge=0.1) for v in z]
    both = learn.logistic(np.column_stack(z), y[calibrate], ridge=0.1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [_logit(_probability(batch.column(c), m)) for c, m in zip("ab", models)]
            p = learn.probability(np.column_stack(z), both)
            columns = [batch.column("doc_id"), *(pa.array(learn.probability(v[:, None], m)) for v, m in zip(z, single)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_score", "metadata_score", "score", "predicted"])

    schema = "doc_id long, text_score double, metadata_score double, score double, predicted int"
    out = views.select("doc_id", "a", "b").mapInArrow(run, schema)
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "text_score", "metadata_score", "score", "predicted")


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
