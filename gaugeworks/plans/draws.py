"""SQL of the draws in operators/replicates.py."""

from __future__ import annotations

from ..operators import replicates as R


def md5_number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def x(seed: int, *keys: str) -> str:
    """A row's number."""
    joined = " || ':' || ".join(keys)
    return f"{md5_number(f"'{seed}:' || {joined}")} % {R.PRIME}"


def reps(name: str, seed: int, n: int) -> str:
    """CTE name(replicate, a, b)."""
    return f"{name} AS (SELECT CAST(rep AS INTEGER) AS replicate, 1 + {md5_number(f"'{seed}:a:' || rep")} % {R.PRIME - 1} AS a, {md5_number(f"'{seed}:b:' || rep")} % {R.PRIME} AS b FROM range(1, {n + 1}) t(rep))"


#: A row's draw in a replicate, and how often it is drawn.
U = f"((x * a + b) % {R.PRIME})"
W = " + ".join(f"CAST({U} >= {t} AS INTEGER)" for t in R.poisson_steps())


def weighted(rows: str, name: str, seed: int, n: int) -> str:
    """CTEs name(columns of rows, replicate, w): counts drawn, replicate 0 with 1 for each row."""
    return f"{reps(f'{name}_r', seed, n)}, {name} AS (SELECT {rows}.*, replicate, {W} AS w FROM {rows}, {name}_r UNION ALL SELECT {rows}.*, 0, 1 FROM {rows})"
