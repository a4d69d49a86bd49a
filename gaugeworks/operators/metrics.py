"""Evaluation metrics as aggregates over a prediction frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..status import q9, ratio
from .ordering import running
from .selection import beside, nearest_ranks, quantiles


def _long(df: DataFrame, values: dict[str, Column], n: str = "n") -> DataFrame:
    """One row a measure, with its status: (measure, value, n, status)."""
    rows = [F.struct(F.lit(k).alias("measure"), q9(v).alias("value")) for k, v in values.items()]
    out = df.select(n, F.explode(F.array(*rows)).alias("m")).select("m.measure", "m.value", F.col(n).alias("n"))
    return out.withColumn("status", F.when(F.col("value").isNull(), "UNDEFINED").otherwise("COMPUTED"))


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, correct, accuracy)."""
    right = F.count_if(F.col("y_true") == F.col("y_pred"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), right.alias("correct")).withColumn("accuracy", q9(ratio("correct", "n")))


def confusion(df: DataFrame) -> DataFrame:
    """(y_true, y_pred, n, row_share, column_share), each pair that occurs."""
    cells = df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    row, column = Window.partitionBy("y_true"), Window.partitionBy("y_pred")
    return cells.select(
        "y_true", "y_pred", "n", q9(ratio("n", F.sum("n").over(row))).alias("row_share"), q9(ratio("n", F.sum("n").over(column))).alias("column_share")
    )


def per_class(df: DataFrame) -> DataFrame:
    """(label, support, predicted, tp, precision, recall, f1) of each class that is true or predicted somewhere."""
    both = df.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")),
    )).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("tp"))
    return sums.select(
        "label", "support", "predicted", "tp", q9(ratio("tp", "predicted")).alias("precision"), q9(ratio("tp", "support")).alias("recall"),
        q9(ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"),
    )


def macro(df: DataFrame) -> DataFrame:
    """Macro precision, recall and F1 (undefined classes count as 0) and balanced accuracy (over classes with support)."""
    c = per_class(df)
    agg = c.agg(
        F.count("*").alias("n"), F.avg(F.coalesce("precision", F.lit(0.0))).alias("p"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("r"),
        F.avg(F.coalesce("f1", F.lit(0.0))).alias("f"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("b"),
    )
    return _long(agg, {"precision_macro": F.col("p"), "recall_macro": F.col("r"), "f1_macro": F.col("f"), "balanced_accuracy": F.col("b")})


def ranked_counts(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, pos, neg): counts at each distinct score. Ties are settled here, before any window."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def roc_auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_pos, n_neg, auc): P(positive scores higher) + half the ties; null without both classes."""
    counts = running(ranked_counts(df, score, positive, by), ["score"], {"below": F.col("neg")}, by)
    won = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    agg = counts.withColumn("won", won).groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
    return agg.select(*by, "n_pos", "n_neg", q9(ratio("won", F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(n_pos, ap): precision at each distinct score from the top, weighted by the recall gained there."""
    counts = running(ranked_counts(df, score, positive), [F.desc("score")], {"tp": F.col("pos"), "seen": F.col("pos") + F.col("neg")})
    cum = counts.select("pos", (F.col("tp") + F.col("pos")).alias("tp"), (F.col("seen") + F.col("pos") + F.col("neg")).alias("seen"))
    agg = cum.agg(F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("gain"))
    return agg.select("n_pos", q9(ratio("gain", "n_pos")).alias("ap"))


def precision_recall_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(score, tp, fp, precision, recall) running from the highest score."""
    counts = running(ranked_counts(df, score, positive), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})
    total = counts.agg(F.sum("pos").alias("total"))
    cum = counts.select("score", (F.col("tp") + F.col("pos")).alias("tp"), (F.col("fp") + F.col("neg")).alias("fp"))
    return cum.crossJoin(F.broadcast(total)).select(  # the other side is one row
        q9("score").alias("score"), "tp", "fp", q9(ratio("tp", F.col("tp") + F.col("fp"))).alias("precision"), q9(ratio("tp", "total")).alias("recall")
    )


def log_loss(df: DataFrame, p_true: Column) -> DataFrame:
    """(n, log_loss, status): mean of -ln p of the true class, p clipped at 1e-15; INVALID if a p lies outside 0 to 1."""
    clipped = F.greatest(F.least(p_true, F.lit(1.0)), F.lit(1e-15))
    agg = df.agg(F.count("*").alias("n"), F.avg(-F.log(clipped)).alias("v"), F.count_if((p_true < 0) | (p_true > 1)).alias("bad"))
    return agg.select("n", F.when(F.col("bad") == 0, q9("v")).alias("log_loss"), F.when(F.col("bad") > 0, "INVALID").when(F.col("n") == 0, "UNDEFINED").otherwise("COMPUTED").alias("status"))


def regression(df: DataFrame) -> DataFrame:
    """MAE, MSE, RMSE, R2 and median absolute error as (measure, value, n, status)."""
    r = F.col("y_pred") - F.col("y_true")
    agg = df.agg(
        F.count("*").alias("n"), F.avg(F.abs(r)).alias("mae"), F.avg(r * r).alias("mse"),
        F.sum(r * r).alias("sse"), F.var_pop("y_true").alias("var"),
    )
    agg = beside(agg, quantiles(df.select(F.abs(r).alias("r")), "r", {"medae": 0.5}).drop("n"))
    r2 = 1 - F.try_divide(F.col("mse"), F.col("var"))
    # large sums: rounded to six significant decimals of a thousand
    return _rounded(_long_raw(agg, {"mae": F.col("mae"), "mse": F.col("mse"), "rmse": F.sqrt("mse"), "r2": r2, "median_absolute_error": F.col("medae")}))


def _long_raw(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()]
    return df.select("n", F.explode(F.array(*rows)).alias("m")).select("m.measure", "m.value", "n")


def _rounded(df: DataFrame) -> DataFrame:
    """Four decimals: values of a million keep within double precision."""
    value = F.floor(F.col("value") * 1e4 + 0.5) / F.lit(1e4)
    return df.select("measure", value.alias("value"), "n", F.when(F.col("value").isNull(), "UNDEFINED").otherwise("COMPUTED").alias("status"))


def classification_errors(df: DataFrame, sure: float = 0.9, unsure: float = 0.6) -> DataFrame:
    """(kind, n): false positives and negatives, sure but wrong, unsure but right."""
    kinds = F.array_compact(F.array(
        F.when((F.col("y_true") == 0) & (F.col("y_pred") == 1), "FALSE_POSITIVE"), F.when((F.col("y_true") == 1) & (F.col("y_pred") == 0), "FALSE_NEGATIVE"),
        F.when((F.col("y_true") != F.col("y_pred")) & (F.col("confidence") >= sure), "HIGH_CONFIDENCE_INCORRECT"),
        F.when((F.col("y_true") == F.col("y_pred")) & (F.col("confidence") < unsure), "LOW_CONFIDENCE_CORRECT"),
    ))
    return df.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def regression_errors(df: DataFrame) -> DataFrame:
    """(n, mean_signed, mean_absolute, max_absolute, residual_std, target_std), deviations of the population."""
    r = F.col("y_pred") - F.col("y_true")
    four = lambda c: F.floor(c * 1e4 + 0.5) / F.lit(1e4)
    return df.agg(
        F.count("*").alias("n"), four(F.avg(r)).alias("mean_signed"), four(F.avg(F.abs(r))).alias("mean_absolute"), four(F.max(F.abs(r))).alias("max_absolute"),
        four(F.stddev_pop(r)).alias("residual_std"), four(F.stddev_pop("y_true")).alias("target_std"),
    )


def top_residuals(df: DataFrame, k: int = 10) -> DataFrame:
    """The k largest absolute residuals, ties by id: (sample_id, residual)."""
    r = F.col("y_pred") - F.col("y_true")
    top = df.select("sample_id", r.alias("residual")).orderBy(F.abs(F.col("residual")).desc(), "sample_id").limit(k)
    return top.select("sample_id", (F.floor(F.col("residual") * 1e4 + 0.5) / F.lit(1e4)).alias("residual"))


def class_balance(df: DataFrame) -> DataFrame:
    """(label, n, share, is_majority, is_minority), ties by label."""
    c = df.groupBy(F.col("y_true").alias("label")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    most = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "label"))
    least = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("n", "label"))
    return c.select("label", "n", q9(ratio("n", F.sum("n").over(everything))).alias("share"), (most == 1).alias("is_majority"), (least == 1).alias("is_minority"))


def confidence_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, correct, mean_confidence_correct, mean_confidence_incorrect) by min(int(confidence * bins), bins - 1)."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    right = F.col("y_true") == F.col("y_pred")
    return df.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(right).alias("correct"),
        q9(F.avg(F.when(right, F.col("confidence")))).alias("mean_confidence_correct"), q9(F.avg(F.when(~right, F.col("confidence")))).alias("mean_confidence_incorrect"),
    )


def calibration_errors(df: DataFrame, bins: int = 10) -> DataFrame:
    """ECE, MCE and Brier score of the top label with equal-width bins, as (measure, value, n, status)."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    per = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(right) - F.avg("confidence")).alias("gap"), F.sum(F.pow(F.col("confidence") - right, 2)).alias("sq"))
    agg = per.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("gap")).alias("e"), F.max("gap").alias("mce"), F.sum("sq").alias("sq"))
    return _long(agg, {"ece": ratio("e", "n"), "mce": F.col("mce"), "brier": ratio("sq", "n")})


def latency(df: DataFrame, value: str) -> DataFrame:
    """(n, total, mean, median, p95, max, throughput); p95 is the nearest rank."""
    agg = df.agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.max(value).alias("max"),
    )
    agg = beside(beside(agg, quantiles(df, value, {"median": 0.5}).drop("n")), nearest_ranks(df, value, {"p95": 0.95}).drop("n"))
    six = lambda c: F.floor(c * 1e6 + 0.5) / F.lit(1e6)
    return agg.select(
        "n", six(F.col("total")).alias("total"), six(ratio("total", "n")).alias("mean"), six(F.col("median")).alias("median"),
        six(F.col("p95")).alias("p95"), six(F.col("max")).alias("max"), six(ratio("n", "total")).alias("throughput"),
    )


def metric_status(df: DataFrame, by: str, minimum: int = 5) -> DataFrame:
    """Accuracy and recall of class 1 in each slice and overall (slice null), with COMPUTED, UNDEFINED or INSUFFICIENT status."""
    right = F.count_if(F.col("y_true") == F.col("y_pred"))
    agg = df.groupingSets([(by,), ()], by).agg(
        F.count("*").alias("n"), right.alias("right"), F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if((F.col("y_true") == 1) & (F.col("y_pred") == 1)).alias("tp")
    )
    rows = F.array(
        F.struct(F.lit("accuracy").alias("measure"), q9(ratio("right", "n")).alias("value"), F.col("n").alias("n")),
        F.struct(F.lit("recall_1").alias("measure"), q9(ratio("tp", "pos")).alias("value"), F.col("pos").alias("n")),
    )
    out = agg.select(F.coalesce(by, F.lit("(all)")).alias("slice"), F.explode(rows).alias("m")).select("slice", "m.*")
    return out.withColumn("status", F.when(F.col("value").isNull(), "UNDEFINED").when(F.col("n") < minimum, "INSUFFICIENT_EVIDENCE").otherwise("COMPUTED"))


