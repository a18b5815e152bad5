"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column | str, k: int = 4) -> Column:
    """Round as ``round(x * 10^k) / 10^k``.

    Written this way in both Spark and the oracle SQL so decimal ties round the
    same way in both engines (``round(x, k)`` differs between them on ties).
    """
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** k)
    return F.round(c * F.lit(s)) / F.lit(s)


def sql_rnd(expr: str, k: int = 4) -> str:
    s = f"1e{k}"
    return f"(round(({expr}) * {s}) / {s})"
