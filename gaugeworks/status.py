"""Values that carry a status: guarded arithmetic, and rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal quantile of 0.975.
Z95 = 1.959963984540054


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q9(c: Column | str) -> Column:
    """To nine decimals, halves up; sums in another order then give the same value."""
    return F.floor(col(c).cast("double") * 1e9 + 0.5) / F.lit(1e9)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(c: Column | str) -> Column:
    """NaN and infinities as null."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def defined(value: Column, reason: str) -> tuple[Column, Column]:
    """Status and reason of a value: DERIVED, or UNDEFINED with the reason."""
    return (
        F.when(value.isNull(), F.lit("UNDEFINED")).otherwise(F.lit("DERIVED")).alias("status"),
        F.when(value.isNull(), F.lit(reason)).alias("reason"),
    )


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n; exact 0 and 1 at the ends; null for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = F.try_divide(k, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    mid = F.try_divide(p + F.try_divide(F.lit(z * z), 2 * n), scale)
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)), scale)
    low = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), mid + half))
    return F.when(n > 0, low), F.when(n > 0, high)
