"""The four cells of a two-treatment design, sample by sample: alignment, contrasts, failure modes and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..status import q9, ratio, wilson

CELLS = ("CONTROL", "A", "B", "AB")


def aligned(df: DataFrame, key: str, truth: str, fields: Sequence[str]) -> DataFrame:
    """(key, truth (null where runs differ in it), mask, alignment, a mean for each field and cell as <field>_<cell>) of df(cell, trial, key, truth, fields...), a row a sample.

    A sample's rows are brought together once; a bit for each cell says where it was seen. alignment is the first that
    applies of DOUBLED (a trial holds the sample twice), DIFFERENT_TRUTH, MISSING_RUNS (a trial of the design lacks it) and
    ALIGNED. Means are over the trials that have a value. Rows without a key or of other cells are left out.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col("cell").isin(*CELLS))
    runs = rows.select("cell", "trial").distinct().agg(F.count("*").alias("runs"))
    shown = F.to_json(F.struct(F.col(truth).alias("t")), {"ignoreNullFields": "false"})
    sums = [s for f in fields for s in (F.sum(F.col(f).cast("double")).alias(f"s_{f}"), F.count(f).alias(f"n_{f}"))]
    per_run = rows.groupBy(key, "cell", "trial").agg(F.count("*").alias("rows"), F.min(shown).alias("low"), F.max(shown).alias("high"), F.first(truth).alias(truth), *sums)
    bit = sum((F.when(F.col("cell") == c, 1 << k).otherwise(0) for k, c in enumerate(CELLS)), F.lit(0))
    of = lambda f, c, p: F.sum(F.when(F.col("cell") == c, F.col(f"{p}_{f}")))
    means = [F.try_divide(of(f, c, "s"), of(f, c, "n")).alias(f"{f}_{c}") for f in fields for c in CELLS]
    each = per_run.groupBy(key).agg(
        F.first(truth).alias(truth), F.bit_or(bit).alias("mask"), F.max("rows").alias("most"), F.count("*").alias("seen"), F.min("low").alias("low"), F.max("high").alias("high"), *means,
    )
    state = F.when(F.col("most") > 1, "DOUBLED").when(F.col("low") != F.col("high"), "DIFFERENT_TRUTH").when(F.col("seen") < F.col("runs"), "MISSING_RUNS").otherwise("ALIGNED")
    placed = each.crossJoin(F.broadcast(runs))  # one row
    return placed.select(key, F.when(F.col("low") == F.col("high"), F.col(truth)).alias(truth), "mask", state.alias("alignment"), *[f"{f}_{c}" for f in fields for c in CELLS])


def alignment(samples: DataFrame) -> DataFrame:
    """(alignment, samples, status): how many samples are in each state; REFUSED is what must not be compared at all, as truths differ or trials hold a sample twice."""
    refused = F.col("alignment").isin("DOUBLED", "DIFFERENT_TRUTH")
    return samples.groupBy("alignment").agg(F.count("*").alias("samples")).withColumn("status", F.when(refused, "REFUSED").when(F.col("alignment") == "ALIGNED", "COMPUTED").otherwise("INCOMPLETE"))


def sample_contrasts(samples: DataFrame, key: str, truth: str, fields: Sequence[str]) -> DataFrame:
    """(key, truth, field, y0, ya, yb, yab, effect_a, effect_b, combined, contrast, status, reason) of aligned() samples.

    A sample that isn't aligned is REFUSED with its state as reason; a field that a cell lacks is UNDEFINED, with the cells as reason.
    """
    cells = [F.struct(F.lit(f).alias("field"), *[F.col(f"{f}_{c}").alias(n) for c, n in zip(CELLS, ("y0", "ya", "yb", "yab"))]) for f in fields]
    rows = samples.select(key, truth, "alignment", F.inline(F.array(*cells)))
    fine = F.col("alignment") == "ALIGNED"
    gone = F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), c) for c, n in zip(CELLS, ("y0", "ya", "yb", "yab"))])), ",")
    whole = fine & (gone == "")
    show = lambda c: q9(F.when(whole, c))
    y0, ya, yb, yab = (F.col(c) for c in ("y0", "ya", "yb", "yab"))
    return rows.select(
        key, truth, "field", show(y0).alias("y0"), show(ya).alias("ya"), show(yb).alias("yb"), show(yab).alias("yab"), show(ya - y0).alias("effect_a"), show(yb - y0).alias("effect_b"), show(yab - y0).alias("combined"),
        show(yab - ya - yb + y0).alias("contrast"), F.when(~fine, "REFUSED").when(whole, "VALID").otherwise("UNDEFINED").alias("status"), F.when(~fine, F.col("alignment")).when(~whole, gone).alias("reason"),
    )


def contrast_summary(contrasts: DataFrame, truth: str) -> DataFrame:
    """(field, class, n, mean_contrast, positive, negative, zero) over valid samples, for each class and all (class null)."""
    valid = contrasts.filter("status = 'VALID'").withColumn("class", F.col(truth).cast("string"))
    a = valid.groupingSets([("field", "class"), ("field",)], "field", "class").agg(
        F.count("*").alias("n"), F.avg("contrast").alias("m"), F.count_if(F.col("contrast") > 0).alias("positive"), F.count_if(F.col("contrast") < 0).alias("negative"), F.count_if(F.col("contrast") == 0).alias("zero")
    )
    return a.select("field", "class", "n", q9("m").alias("mean_contrast"), "positive", "negative", "zero")


def slice_contrasts(members: DataFrame, value: str, minimum: int = 2) -> DataFrame:
    """(slice, trials, dropped, control, a, b, ab, contrast, status) of members(slice, cell, trial, <value>): the interaction of the cells' means within each slice.

    Trials that some cell lacks in a slice are dropped and counted; none left is UNDEFINED, fewer than `minimum` INSUFFICIENT_EVIDENCE.
    """
    each = members.filter(F.col("cell").isin(*CELLS)).groupBy("slice", "trial").agg(*[F.avg(F.when(F.col("cell") == c, F.col(value).cast("double"))).alias(c) for c in CELLS])
    whole = F.lit(True)
    for c in CELLS:
        whole = whole & F.col(c).isNotNull()
    mean = lambda c: F.avg(F.when(whole, F.col(c))).alias(c)
    a = each.groupBy("slice").agg(F.count_if(whole).alias("trials"), F.count_if(~whole).alias("dropped"), *[mean(c) for c in CELLS])
    status = F.when(F.col("trials") == 0, "UNDEFINED").when(F.col("trials") < minimum, "INSUFFICIENT_EVIDENCE").otherwise("COMPUTED")
    return a.select("slice", "trials", "dropped", *[q9(c).alias(n) for c, n in zip(CELLS, ("control", "a", "b", "ab"))], q9(F.col("AB") - F.col("A") - F.col("B") + F.col("CONTROL")).alias("contrast"), status.alias("status"))


def modes_across_cells(signals: DataFrame, runs: DataFrame, delta: float = 0.1, least_runs: int = 2) -> DataFrame:
    """(mode, confirmed, prevalence_a, prevalence_b, prevalence_ab, states, low_cells) of signals(mode, run, confirmed) and runs(run, cell): how often the runs of each treated cell show a mode.

    states, joined with '+': INSUFFICIENT_EVIDENCE for a mode that isn't confirmed; OBSERVED_UNDER_COMPOUND_TREATMENT, and with it
    NEWLY_OBSERVED where neither single treatment shows it, else INCREASED_PREVALENCE, REDUCED_PREVALENCE or PERSISTING as the compound's share differs from
    the larger single one by delta; REDUCED_PREVALENCE where only single ones show it. Modes that no treated run shows are left out. low_cells have fewer than least_runs runs.
    """
    cells = CELLS[1:]
    treated = runs.filter(F.col("cell").isin(*cells)).select("run", "cell").distinct()
    size = treated.agg(*[F.count_if(F.col("cell") == c).alias(f"n_{c}") for c in cells])
    seen = signals.select("mode", "run", "confirmed").join(treated, "run").groupBy("mode", "cell", "run").agg(F.max("confirmed").alias("confirmed"))
    a = seen.groupBy("mode").agg(F.max("confirmed").alias("confirmed"), *[F.count_if(F.col("cell") == c).alias(f"k_{c}") for c in cells]).crossJoin(F.broadcast(size))  # size is one row
    share = {c: F.coalesce(ratio(f"k_{c}", f"n_{c}"), F.lit(0.0)) for c in cells}
    p = F.round(share["AB"], 12)
    base = F.round(F.greatest(share["A"], share["B"]), 12)
    moved = F.round(p - base, 12)
    against = F.when(base == 0, "NEWLY_OBSERVED").when(moved >= delta, "INCREASED_PREVALENCE").when(-moved >= delta, "REDUCED_PREVALENCE").otherwise("PERSISTING")
    states = F.array_compact(F.array(F.when(~F.col("confirmed"), "INSUFFICIENT_EVIDENCE"), F.when(p > 0, "OBSERVED_UNDER_COMPOUND_TREATMENT"), F.when(p > 0, against).when(base > 0, "REDUCED_PREVALENCE")))
    low = F.array_compact(F.array(*[F.when(F.col(f"n_{c}") < least_runs, c) for c in cells]))
    return a.select("mode", "confirmed", *[q9(share[c]).alias(f"prevalence_{c.lower()}") for c in cells], F.array_join(states, "+").alias("states"), F.array_join(low, ",").alias("low_cells"))


def failures_by_slice(touched: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(mode, slice, affected, samples, share, lower, upper, outside_affected, outside_samples, outside_share, outside_lower, outside_upper, present) of touched(mode, key) and
    members(slice, key), where slice '(all)' holds the population: distinct samples that a mode's signals touch, within each slice and outside it, with Wilson intervals.

    Samples outside the population don't count.
    """
    inside = members.select("slice", key).distinct()
    size = inside.groupBy("slice").agg(F.count("*").alias("samples"))
    hit = touched.select("mode", key).distinct().join(inside, key).groupBy("mode", "slice").agg(F.count("*").alias("affected"))
    modes = hit.filter("slice = '(all)'").select("mode", F.col("affected").alias("all_affected"))
    total = size.filter("slice = '(all)'").select(F.col("samples").alias("all_samples"))
    rows = modes.join(size.filter("slice != '(all)'").crossJoin(F.broadcast(total)), F.lit(True)).join(hit, ["mode", "slice"], "left").withColumn("affected", F.coalesce("affected", F.lit(0)))  # modes x slices is the result
    rows = rows.withColumns({"o_k": F.col("all_affected") - F.col("affected"), "o_n": F.col("all_samples") - F.col("samples")})
    (low, high), (o_low, o_high) = wilson("affected", "samples"), wilson("o_k", "o_n")
    return rows.select(
        "mode", "slice", "affected", "samples", q9(ratio("affected", "samples")).alias("share"), q9(low).alias("lower"), q9(high).alias("upper"), F.col("o_k").alias("outside_affected"), F.col("o_n").alias("outside_samples"),
        q9(ratio("o_k", "o_n")).alias("outside_share"), q9(o_low).alias("outside_lower"), q9(o_high).alias("outside_upper"), (F.col("affected") > 0).alias("present"),
    )
