"""Linear models over feature vectors: fitted by sums, scored in batches, stressed by changed parameters."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..status import q9, ratio
from .ordering import kept

#: Numbers that a model may have; it goes to every task.
LARGEST = 10_000_000


@dataclass(frozen=True)
class LinearModel:
    """Scores of classes, sorted by name: x . weights[class] + intercept[class]; the first class of the highest score is predicted."""

    text: str

    @classmethod
    def of(cls, classes: list[str], weights: np.ndarray, intercepts: np.ndarray) -> LinearModel:
        if weights.size > LARGEST:
            raise ValueError(f"a model of {weights.size} numbers is too large to send to every task")
        return cls(json.dumps({"classes": classes, "weights": weights.tolist(), "intercepts": intercepts.tolist()}))

    def parts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        return _loaded(self.text)


@functools.lru_cache(maxsize=8)
def _loaded(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Once a worker, not once a batch."""
    d = json.loads(text)
    return d["classes"], np.array(d["weights"], np.float64).reshape(len(d["classes"]), -1 if d["classes"] else 0), np.array(d["intercepts"], np.float64)


def usable(features: Column, width: int) -> Column:
    """Whether a vector has the width and finite numbers only."""
    bad = F.exists(features, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(features) == width) & ~bad, F.lit(False))


def parameters(df: DataFrame, features: str, label: str) -> DataFrame:
    """(class, i, w, n): the mean of each class's vectors, component by component; the classes' widths are those of their vectors."""
    each = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("class"), F.posexplode(features).alias("i", "v"))
    return each.groupBy("class", "i").agg(F.avg(F.col("v").cast("double")).alias("w"), F.count("*").alias("n"))


def model_of(parameters: DataFrame) -> LinearModel:
    """The nearest-mean classifier of parameters(class, i, w), as a linear model: weights are the means, intercepts minus half their squares. Bounded by LARGEST."""
    size = parameters.agg(F.count("*"), F.count_distinct("class"), F.max("i")).first()
    if size[0] > LARGEST:
        raise ValueError("the model is too large")
    if not size[0]:
        return LinearModel.of([], np.zeros((0, 0)), np.zeros(0))
    rows = parameters.select("class", "i", "w").collect()  # at most LARGEST numbers
    classes = sorted({r["class"] for r in rows})
    weights = np.zeros((len(classes), size[2] + 1))
    at = {c: k for k, c in enumerate(classes)}
    for r in rows:
        weights[at[r["class"]], r["i"]] = r["w"]
    return LinearModel.of(classes, weights, -(weights * weights).sum(1) / 2)


def _scored(model: LinearModel) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights, intercepts = model.parts()
        for batch in batches:
            column = batch.column("__x")
            x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, weights.shape[1])
            z = x @ weights.T + intercepts
            order = np.sort(z, axis=1)
            margin = order[:, -1] - order[:, -2] if len(classes) > 1 else np.full(len(z), np.nan)
            names = pa.array(classes).take(pa.array(z.argmax(1))) if len(z) else pa.array([], pa.string())
            keep = [c for c in batch.schema.names if c != "__x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), names, pa.array(z.max(1) if len(z) else np.zeros(0)), pa.array(margin, from_pandas=True)], names=[*keep, "y_pred", "score", "margin"])

    return run


def score(df: DataFrame, features: str, model: LinearModel) -> DataFrame:
    """df without features, with y_pred, score and margin (highest score less the next; null with one class).

    Batches of vectors are multiplied with the weights at once; a worker reads the model once. Vectors that are null, of another
    width or not finite have no prediction. No shuffle.
    """
    classes, weights, _ = model.parts()
    rest = [c for c in df.columns if c != features]
    kinds = dict(df.dtypes)
    fine = usable(F.col(features), weights.shape[1]) if classes else F.lit(False)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "y_pred string", "score double", "margin double"])
    good = df.filter(fine).select(*rest, F.col(features).alias("__x")).mapInArrow(_scored(model), schema)
    none = df.filter(~fine).select(*rest, F.lit(None).cast("string").alias("y_pred"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("margin"))
    return good.unionByName(none)


def perturbed(parameters: DataFrame, family: str, amount: float, seed: int = 0) -> DataFrame:
    """Parameters of a stress family: PARAMETER_SCALE multiplies them, PARAMETER_NOISE adds uniform noise of amount times a class's root mean square, PARAMETER_DROP sets a share of them to 0."""
    u = uniform(seed, F.col("class"), F.col("i"))
    if family == "PARAMETER_SCALE":
        return parameters.withColumn("w", F.col("w") * amount)
    if family == "PARAMETER_DROP":
        return parameters.withColumn("w", F.when(u < amount, 0.0).otherwise(F.col("w")))
    if family != "PARAMETER_NOISE":
        raise ValueError(f"unknown family {family}")
    rms = parameters.groupBy("class").agg(F.sqrt(F.avg(F.col("w") * F.col("w"))).alias("rms"))
    return parameters.join(rms, "class").withColumn("w", F.col("w") + amount * F.col("rms") * (2 * u - 1)).drop("rms")


def stress(df: DataFrame, key: str, features: str, label: str, parameters: DataFrame, families: list[tuple[str, float, int]]) -> DataFrame:
    """(family, amount, seed, n, accuracy, baseline, delta, changed, newly_wrong): the model scored anew with changed parameters, against itself.

    intercepts follow the changed weights. Rows without a prediction are left out. Each family is one pass over the vectors.
    """
    parameters = kept(parameters)
    rows = df.select(key, F.col(label).cast("string").alias("y_true"), features)
    base = kept(score(rows, features, model_of(parameters)).filter("y_pred is not null and y_true is not null").select(key, F.col("y_pred").alias("y0")))
    out = None
    for family, amount, seed in families:
        now = score(rows, features, model_of(perturbed(parameters, family, amount, seed))).select(key, "y_true", "y_pred").join(base, key)
        right, was = F.col("y_pred") == F.col("y_true"), F.col("y0") == F.col("y_true")
        a = now.agg(F.count("*").alias("n"), F.count_if(right).alias("k"), F.count_if(was).alias("k0"), F.count_if(F.col("y_pred") != F.col("y0")).alias("changed"), F.count_if(was & ~right).alias("newly_wrong"))
        row = a.select(F.lit(family).alias("family"), F.lit(float(amount)).alias("amount"), F.lit(seed).alias("seed"), "n", q9(ratio("k", "n")).alias("accuracy"), q9(ratio("k0", "n")).alias("baseline"), q9(ratio(F.col("k") - F.col("k0"), "n")).alias("delta"), "changed", "newly_wrong")
        out = row if out is None else out.unionByName(row)
    return out
