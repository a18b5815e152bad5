"""floor-string features as native column expressions (no Python UDF).

A floor description such as ``"P1-3"``, ``"S1-T-2"`` or ``"PT-ST-1"`` becomes the
sorted set of floor numbers it mentions; eight doubles are derived from that
set.  The literal rules of the reference are kept on purpose (FIXTURES §4.1):
an isolated ``-1`` reads as floor 1, ``S3``/``P13``/``T1`` read as nothing, and
the ``S`` inside ``ST``/``SEMI`` also adds -1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor codes and their floor numbers.
#   P1..P12 → 1..12; S, S1, SEMI → -1; S2 → -2; T, PT → 0; ST → -0.5; RIAL → 0.5
# Isolated numbers count as floors when 1 <= n <= 12; otherwise the whole string
# is read as one number and kept when -5 <= x <= 15.  Missing markers: null,
# 'NULL', ''.  Weighted mean uses weight floor + 3.
MISSING_MARKERS = ["NULL", ""]
P_LEVEL = r"^(1[0-2]|[1-9])$"
ISOLATED_MIN, ISOLATED_MAX = 1, 12
FALLBACK_MIN, FALLBACK_MAX = -5.0, 15.0
WEIGHT_SHIFT = 3.0

OUTPUT_NAMES = ["min_floor", "max_floor", "n_floors", "has_basement", "has_ground",
                "has_upper", "floor_span", "floor_numeric_weighted"]

# Whitespace removed by Python's str.strip(), as a Java character class.
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A Python float literal (digits may be grouped with single underscores).
_PY_FLOAT = r"^[+-]?(\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)(E[+-]?\d(_?\d)*)?$"


def _codes(s: Column) -> Column:
    """Floor numbers named by codes (P<n>, S<n>, PT, T, ST, SEMI, RIAL)."""
    p = F.transform(F.filter(F.regexp_extract_all(s, F.lit(r"P(\d+)"), 1),
                             lambda d: d.rlike(P_LEVEL)),
                    lambda d: d.cast("double"))
    sn = F.transform(F.filter(F.regexp_extract_all(s, F.lit(r"S(\d*)"), 1),
                              lambda d: d.isin("", "1", "2")),
                     lambda d: F.when(d == "2", F.lit(-2.0)).otherwise(F.lit(-1.0)))
    words = F.array_compact(F.array(
        F.when(s.contains("PT"), F.lit(0.0)),
        F.when(s.rlike(r"T(?![0-9])"), F.lit(0.0)),
        F.when(s.contains("ST"), F.lit(-0.5)),
        F.when(s.contains("SEMI"), F.lit(-1.0)),
        F.when(s.contains("RIAL"), F.lit(0.5)),
    ))
    return F.concat(p, sn, words)


def _isolated(s: Column) -> Column:
    """Stand-alone integers 1..12 (leading zeros allowed, e.g. '01')."""
    return F.transform(
        F.filter(F.regexp_extract_all(s, F.lit(r"\b(\d+)\b"), 1),
                 lambda d: F.regexp_replace(d, r"^0+", "").rlike(P_LEVEL)),
        lambda d: d.cast("double"))


def floor_levels(raw: Column | str) -> Column:
    """Sorted distinct floor numbers of a floor string (empty array if none)."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    s = F.upper(F.regexp_replace(raw, rf"^{_WS}+|{_WS}+$", ""))
    found = F.array_sort(F.array_distinct(F.concat(_codes(s), _isolated(s))))
    as_number = F.regexp_replace(s, "_", "").try_cast("double")
    fallback = F.when(s.rlike(_PY_FLOAT) & as_number.between(FALLBACK_MIN, FALLBACK_MAX),
                      F.array(as_number)).otherwise(F.array().cast("array<double>"))
    missing = raw.isNull() | raw.isin(*MISSING_MARKERS)
    return (F.when(missing, F.array().cast("array<double>"))
             .when(F.size(found) > 0, found)
             .otherwise(fallback))


def floor_features_from_levels(levels: Column) -> dict[str, Column]:
    """The eight features of a floor-number array (expressions, not yet aliased)."""
    lo, hi = F.array_min(levels), F.array_max(levels)

    def flag(pred):
        return F.when(F.exists(levels, pred), F.lit(1.0)).otherwise(F.lit(0.0))

    num = F.aggregate(levels, F.lit(0.0), lambda acc, f: acc + f * (f + WEIGHT_SHIFT))
    den = F.aggregate(levels, F.lit(0.0), lambda acc, f: acc + (f + WEIGHT_SHIFT))
    return {
        "min_floor": lo,
        "max_floor": hi,
        "n_floors": F.size(levels).cast("double"),
        "has_basement": flag(lambda f: f < 0),
        "has_ground": flag(lambda f: (f >= -0.5) & (f <= 0.5)),
        "has_upper": flag(lambda f: f >= 1),
        "floor_span": F.coalesce(hi - lo, F.lit(0.0)),
        "floor_numeric_weighted": F.when(F.size(levels) > 0, F.try_divide(num, den)),
    }


def with_floor_features(df, col: str, prefix: str = "floor_"):
    """Add ``{prefix}{feature}`` columns for the floor string column ``col``.

    The level array is materialised once as a helper column; Catalyst does not
    inline a non-cheap expression used several times, so the regexes run once
    per row.
    """
    tmp = f"__{col}_levels"
    out = df.withColumn(tmp, floor_levels(col))
    feats = floor_features_from_levels(F.col(tmp))
    return out.withColumns({prefix + k: v for k, v in feats.items()}).drop(tmp)
