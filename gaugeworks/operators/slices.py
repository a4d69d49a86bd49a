"""Slices: a closed predicate language, membership with three-valued logic, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..status import finite, q9, ratio

MAX_DEPTH, MAX_ARGUMENTS = 16, 64
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def compile_predicate(condition: Mapping, types: Mapping[str, str], depth: int = 0) -> Column:
    """A condition as a Column that is true, false or null (unknown).

    {"op": "eq", "field", "value"}, {"op": "in", "field", "values"}, {"op": "range", "field", "low", "high"} (half-open),
    {"op": "is_true", "field"}, {"op": "and" | "or", "args"}, {"op": "not", "arg"}. Kinds aren't mixed: a value of
    another kind than the field's is unknown, and so are missing and non-finite numbers. Unknown keys are refused.
    """
    if depth > MAX_DEPTH:
        raise ValueError("condition too deep")
    keys = {"eq": {"field", "value"}, "in": {"field", "values"}, "range": {"field", "low", "high"}, "is_true": {"field"}, "and": {"args"}, "or": {"args"}, "not": {"arg"}}
    op = condition.get("op")
    if op not in keys or set(condition) - {"op"} != keys[op]:
        raise ValueError(f"not a condition: {dict(condition)}")
    if op in ("and", "or"):
        if not 1 <= len(condition["args"]) <= MAX_ARGUMENTS:
            raise ValueError("number of arguments")
        parts = [compile_predicate(a, types, depth + 1) for a in condition["args"]]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if op == "and" else (out | p)
        return out
    if op == "not":
        return ~compile_predicate(condition["arg"], types, depth + 1)
    field = condition["field"]
    unknown = F.lit(None).cast("boolean")
    if field not in types:
        return unknown
    kind = "bool" if types[field] == "boolean" else "num" if types[field] in NUMBERS else "str" if types[field] == "string" else "other"
    value = finite(field) if types[field] in ("float", "double") else F.col(field)

    def same_kind(v) -> bool:
        return {"bool": isinstance(v, bool), "num": isinstance(v, (int, float)) and not isinstance(v, bool), "str": isinstance(v, str)}.get(kind, False)

    if op == "is_true":
        return F.col(field) if kind == "bool" else unknown
    if op == "range":
        return (value >= condition["low"]) & (value < condition["high"]) if kind == "num" else unknown
    wanted = [condition["value"]] if op == "eq" else list(condition["values"])
    fit = [v for v in wanted if same_kind(v)]
    hit = value.isin(*fit) if fit else F.when(value.isNotNull(), F.lit(False))
    return F.when(hit, True).otherwise(unknown) if len(fit) < len(wanted) else hit


def membership(df: DataFrame, slices: Mapping[str, Mapping]) -> DataFrame:
    """(slice, members, unknown, n, prevalence, status) of all slices in one pass over df."""
    types = dict(df.dtypes)
    columns = {name: compile_predicate(c, types) for name, c in slices.items()}
    aggs = [F.struct(F.lit(n).alias("slice"), F.count_if(c).alias("members"), F.count_if(c.isNull()).alias("unknown")) for n, c in columns.items()]
    a = df.agg(F.count("*").alias("n"), F.array(*aggs).alias("a")).select("n", F.explode("a").alias("x")).select("x.*", "n")
    absent = [n for n, c in slices.items() if not _fields(c) <= set(types)]
    status = F.when(F.col("n") == 0, "NO_SAMPLES").when(F.col("slice").isin(*absent) if absent else F.lit(False), "MISSING_FIELD").when(F.col("members") == 0, "EMPTY").otherwise("COMPUTED")
    return a.select("slice", "members", "unknown", "n", q9(ratio("members", "n")).alias("prevalence"), status.alias("status"))


def _fields(c: Mapping) -> set[str]:
    if "field" in c:
        return {c["field"]}
    return set().union(*(_fields(a) for a in (c.get("args") or [c["arg"]])))


def in_slices(df: DataFrame, slices: Mapping[str, Mapping]) -> DataFrame:
    """df once for each slice that a row is a member of, with the slice's name; and once as (all)."""
    types = dict(df.dtypes)
    names = F.array(F.lit("(all)"), *[F.when(compile_predicate(c, types), F.lit(n)) for n, c in slices.items()])
    return df.withColumn("slice", F.explode(F.array_compact(names)))


def compare_to_rest(df: DataFrame, slices: Mapping[str, Mapping]) -> DataFrame:
    """(slice, n, n_rest, accuracy, rest_accuracy, difference, relative): members against those that aren't; unknown rows are neither."""
    types = dict(df.dtypes)
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    aggs = []
    for name, c in slices.items():
        p = compile_predicate(c, types)
        aggs.append(F.struct(F.lit(name).alias("slice"), F.count_if(p).alias("n"), F.count_if(~p).alias("n_rest"), F.avg(F.when(p, right)).alias("a"), F.avg(F.when(~p, right)).alias("r")))
    a = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    d = F.col("a") - F.col("r")
    return a.select("slice", "n", "n_rest", q9("a").alias("accuracy"), q9("r").alias("rest_accuracy"), q9(d).alias("difference"), q9(F.try_divide(d, "r")).alias("relative"))


def overlap(df: DataFrame, slices: Mapping[str, Mapping], key: str) -> DataFrame:
    """(a, b, both, either, jaccard) of each pair of slices; one pass, two empty slices count as equal."""
    types = dict(df.dtypes)
    c = {n: F.coalesce(compile_predicate(x, types), F.lit(False)) for n, x in slices.items()}
    pairs = [(a, b) for a in c for b in c if a < b]
    agg = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(c[a] & c[b]).alias("both"), F.count_if(c[a] | c[b]).alias("either")) for a, b in pairs]).alias("x"))
    out = agg.select(F.explode("x").alias("x")).select("x.*")
    return out.withColumn("jaccard", q9(F.when(F.col("either") == 0, 1.0).otherwise(ratio("both", "either"))))


def unseen(df: DataFrame, field: str, literals: Sequence[str]) -> DataFrame:
    """(value): literals of a condition that the field never has."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in literals], "value string")
    return wanted.join(df.select(F.col(field).alias("value")).distinct(), "value", "left_anti")


def restricted(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in a stored member list, however often it stands there."""
    return df.join(members.select(key).distinct(), key, "left_semi")
