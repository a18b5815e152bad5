"""text → number parsing as guarded casts.

``try_cast`` alone is too permissive for the reference's semantics (Spark
accepts ``'1d'``, ``'1f'`` and hex floats), so a pattern guard decides what is
a number first: optional surrounding whitespace, sign, decimal digits with an
optional fraction and exponent, or an infinity word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a numeric string looks like.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def parse_number(c: Column | str) -> Column:
    """Double value of a numeric string, null for anything else (never raises)."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))


def is_number(c: Column | str) -> Column:
    return parse_number(c).isNotNull()
