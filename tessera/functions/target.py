"""target log transform, its inverse, and original-target recovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A shift is applied when the minimum is below -1; the shift is
# |min| + 1.
SHIFT_BELOW = -1.0


def log_shift_for_min(min_value: float | None) -> float:
    if min_value is not None and min_value < SHIFT_BELOW:
        return abs(min_value) + 1.0
    return 0.0


def log_target(c: Column | str, shift: float = 0.0) -> Column:
    """``log1p(y + shift)``; out-of-domain and null inputs give null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.log1p(c + F.lit(float(shift)))


def inverse_log_target(c: Column | str, shift: float = 0.0) -> Column:
    """``expm1(y) - shift`` (the shift stored at fit time is used both ways)."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.expm1(c)
    return out - F.lit(float(shift)) if shift > 0 else out


def is_finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def year_month_key(year: Column | str, month: Column | str) -> Column:
    """months since year 0, the temporal ordering key."""
    y = F.col(year) if isinstance(year, str) else year
    m = F.col(month) if isinstance(month, str) else month
    return y.cast("long") * 12 + m.cast("long")


def original_target(df_columns: list[str], target: str) -> Column:
    """the original-scale target — the ``_original`` column when present,
    else ``expm1`` when the target name says it is a log, else the target."""
    orig = target.replace("_log", "_original")
    if orig in df_columns:
        return F.col(orig)
    if "_log" in target:
        return F.expm1(F.col(target))
    return F.col(target)
