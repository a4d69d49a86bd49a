"""Keys, digests and labels that tell values of different kinds apart."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_key(c: Column, kind: str) -> Column:
    """JSON spelling, so that the number 2 and the text "2" are different labels."""
    return F.to_json(F.struct(c.alias("v"))) if kind == "struct" else F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), c, F.lit('"')) if kind == "string" else c.cast("string"))


def framed(*fields: Column) -> Column:
    """Fields joined so that no two different lists look alike: each with its length before it, null as '-'."""
    text = [f.cast("string") for f in fields]
    return F.concat(*[F.when(t.isNull(), F.lit("-;")).otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t, F.lit(";"))) for t in text])


def entity_id(prefix: str, kind: str, *fields: Column) -> Column:
    """prefix_ and 32 hex digits of the kind and the identifying fields."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(framed(F.lit(kind), *fields), 256), 1, 32))


def derived_seed(seed: int, *names: Column) -> Column:
    """A seed of 60 bits for a named part of a seeded job: different names, or lists of names, give independent ones."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), framed(*names)), 256), 1, 15), 16, 10).cast("long")


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, fingerprint): independent of row order and partitioning; 16 + 16 hex digits of each row's md5 are summed as decimals."""
    h = F.md5(framed(*[F.col(c) for c in columns]))
    part = lambda a: F.sum(F.conv(F.substring(h, a, 8), 16, 10).cast("decimal(20,0)"))
    a = df.agg(F.count("*").alias("rows"), *[part(k).alias(f"s{k}") for k in (1, 9, 17, 25)])
    return a.select("rows", F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("string") for k in (1, 9, 17, 25)])).alias("fingerprint"))


def severity_band(value: Column, edges: list[float]) -> Column:
    """How many edges are at or below value."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:]), F.when(value >= edges[0], 1).otherwise(0))


def close(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def flattened(document: Mapping, prefix: str = "") -> dict[str, object]:
    """A nested mapping by JSON pointers."""
    out: dict[str, object] = {}
    for k, v in document.items():
        path = f"{prefix}/{str(k).replace('~', '~0').replace('/', '~1')}"
        out |= flattened(v, path) if isinstance(v, Mapping) else {path: v}
    return out
