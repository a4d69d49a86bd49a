"""Numbers in [0, 1) from md5 of a seed and a key: the same for every engine, partitioning and retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by the polar form of Box and Muller's pair of uniforms."""
    u = F.greatest(uniform(seed, *keys, F.lit("a")), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit("b")))
