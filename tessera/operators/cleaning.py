"""Column and row cleaning: P4-P7, D1, D2, C1-C5.

Data-dependent schema changes follow *fit (one aggregation job → a small
column list on the driver) → transform (a lazy ``select``/``drop``)*.  The
fitted state is a handful of column names and numbers, never data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import parse_number
from . import profile as P


# --------------------------------------------------------------------------- P4
def empty_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """'' → null in every string column (or the listed ones)."""
    cols = set(cols) if cols is not None else set(P.string_columns(df))
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# --------------------------------------------------------------------------- P5
def drop_listed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict]:
    """Drop the listed columns that exist; report requested / existing / missing."""
    existing = [c for c in columns if c in df.columns]
    missing = [c for c in columns if c not in df.columns]
    info = {"requested": list(columns), "removed": existing, "missing": missing}
    return df.drop(*existing), info


# --------------------------------------------------------------------------- P6
def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target]) if target in df.columns else df


# --------------------------------------------------------------------------- P7
def empty_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Fit: columns with no non-null value (NaN counts as null)."""
    cols = list(cols or df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}

    def present(c):
        if isinstance(fields[c], (T.FloatType, T.DoubleType)):
            return F.count(F.when(~F.isnan(c), F.col(c)))
        return F.count(c)
    res = P._chunked_agg(df, [present(c).alias(f"c{i}") for i, c in enumerate(cols)])
    return [c for i, c in enumerate(cols) if res[f"c{i}"] == 0]


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    empty = empty_columns(df)
    return df.drop(*empty), empty


# --------------------------------------------------------------------------- D1
def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop fully duplicated rows (nulls equal).  The aggregate dedupes map-side
    first, so a row repeated a billion times costs one row per task in the shuffle."""
    return df.dropDuplicates()


# --------------------------------------------------------------------------- D2
def duplicate_columns(df: DataFrame) -> list[str]:
    """Columns whose whole content equals an earlier column (nulls equal, same type).

    Pass 1 computes an order-free signature per column — (type, non-null count,
    ``bit_xor`` of value hashes) — that equal columns always share.  Pass 2
    checks only same-signature pairs, row by row, with a null-safe equality
    ``bool_and(a <=> b)``.  Both passes are single aggregation jobs.
    """
    cols = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sig_exprs = []
    for i, c in enumerate(cols):
        sig_exprs.append(F.count(c).alias(f"n{i}"))
        sig_exprs.append(F.bit_xor(F.xxhash64(F.col(c))).alias(f"h{i}"))
    sig = P._chunked_agg(df, sig_exprs)
    groups: dict = {}
    for i, c in enumerate(cols):
        groups.setdefault((types[c], sig[f"n{i}"], sig[f"h{i}"]), []).append(i)
    pairs = [(a, b) for idx in groups.values() if len(idx) > 1
             for k, a in enumerate(idx) for b in idx[k + 1:]]
    if not pairs:
        return []
    checks = [F.bool_and(F.col(cols[a]).eqNullSafe(F.col(cols[b]))).alias(f"e{a}_{b}")
              for a, b in pairs]
    eq = P._chunked_agg(df, checks)
    drop = set()
    for a, b in pairs:
        if cols[b] not in drop and eq[f"e{a}_{b}"] is not False:
            drop.add(cols[b])
    return [c for c in cols if c in drop]


def drop_duplicate_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    dup = duplicate_columns(df)
    return df.drop(*dup), dup


# --------------------------------------------------------------------------- C2
@dataclass
class ConstantColumnsModel:
    threshold: float
    constant: list[str]
    stats: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.constant)


class ConstantColumns:
    """Drop columns whose most frequent value (nulls included) covers ≥ threshold."""

    def __init__(self, threshold: float = 0.95):
        self.threshold = threshold

    def fit(self, df: DataFrame, exclude: Sequence[str] = ()) -> ConstantColumnsModel:
        cols = [c for c in df.columns if c not in exclude]
        rows = [r.asDict() for r in P.frequent_values(df, cols, self.threshold).collect()] if cols else []
        const = [r["column"] for r in rows]
        return ConstantColumnsModel(self.threshold, [c for c in cols if c in const], rows)


# --------------------------------------------------------------------------- C4
@dataclass
class NumericConversionModel:
    threshold: float
    converted: list[str]
    skipped: list[str]
    rates: dict

    def transform(self, df: DataFrame) -> DataFrame:
        conv = set(self.converted)
        return df.select(*[parse_number(c).alias(c) if c in conv else F.col(c) for c in df.columns])


class NumericConversion:
    """Convert text columns to double when ≥ threshold of their non-null values parse.

    ``coerce_all=True`` converts every text column regardless (literal Q1 path).
    """

    def __init__(self, threshold: float = 0.8, coerce_all: bool = False):
        self.threshold = threshold
        self.coerce_all = coerce_all

    def fit(self, df: DataFrame, exclude: Sequence[str] = ()) -> NumericConversionModel:
        cols = P.string_columns(df, exclude)
        if not cols:
            return NumericConversionModel(self.threshold, [], [], {})
        if self.coerce_all:
            return NumericConversionModel(self.threshold, cols, [], {})
        rates = {r["column"]: r.asDict() for r in P.conversion_rates(df, cols).collect()}
        conv = [c for c in cols if rates[c]["n_non_null"] > 0
                and rates[c]["rate"] is not None and rates[c]["rate"] >= self.threshold]
        skipped = [c for c in cols if c not in conv and rates[c]["n_non_null"] > 0]
        return NumericConversionModel(self.threshold, conv, skipped, rates)


# --------------------------------------------------------------------------- C5
@dataclass
class CorrelationPruningModel:
    threshold: float
    dropped: list[str]
    pairs: list

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)

    def dropped_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c,) for c in self.dropped], "column string")


class CorrelationPruning:
    """Drop numeric columns with |r| > threshold to an earlier column (one pass, Q13)."""

    def __init__(self, threshold: float = 0.95):
        self.threshold = threshold

    def fit(self, df: DataFrame, cols: Sequence[str] | None = None,
            exclude: Sequence[str] = ()) -> CorrelationPruningModel:
        cols = list(cols) if cols is not None else P.numeric_columns(df, exclude)
        pairs = P.pearson_pairs(df, cols) if len(cols) > 1 else []
        return CorrelationPruningModel(self.threshold,
                                       P.pearson_drop_list(pairs, cols, self.threshold), pairs)


# --------------------------------------------------------------------------- C3 / C3b
@dataclass
class AssociationPruningModel:
    threshold: float
    dropped: list[str]
    high_pairs: list
    n_unique: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


class AssociationPruning:
    """Cramér's V analysis of text columns; drop one column per associated pair.

    Pairs need threshold < V < 1 unless ``include_perfect`` (Q11); the column
    with fewer distinct values is dropped (Q12, one per pair).
    """

    def __init__(self, threshold: float = 0.95, include_perfect: bool = False):
        self.threshold = threshold
        self.include_perfect = include_perfect

    def fit(self, df: DataFrame, exclude: Sequence[str] = ()) -> AssociationPruningModel:
        cols = P.string_columns(df, exclude)
        if not cols:
            return AssociationPruningModel(self.threshold, [], [], {})
        from .encoding import cardinality
        n_unique = cardinality(df, cols)
        cols = [c for c in cols if n_unique[c] > 1]
        if len(cols) < 2:
            return AssociationPruningModel(self.threshold, [], [], n_unique)
        pairs = [(r["c1"], r["c2"], r["cramers_v"])
                 for r in P.cramers_v_pairs(df, cols).collect()]
        high = [p for p in pairs if p[2] is not None and p[2] > self.threshold
                and (self.include_perfect or p[2] < 1.0)]
        drop = P.recommended_removals(pairs, n_unique, self.threshold, self.include_perfect)
        return AssociationPruningModel(self.threshold, drop, high, n_unique)


# --------------------------------------------------------------------------- C1
def clean(df: DataFrame, target: str, columns_to_remove: Sequence[str] = (),
          constant_threshold: float = 0.95, remove_listed: bool = True,
          remove_constant: bool = True) -> tuple[DataFrame, dict]:
    """Cleaning chain in the reference's order: '' → null, drop listed, drop
    quasi-constant (target excluded; runs before null-target removal), drop
    null-target rows, drop empty columns, drop duplicate rows."""
    info: dict = {"original_columns": len(df.columns)}
    out = empty_to_null(df)
    if remove_listed and columns_to_remove:
        out, info["specific_columns_removal"] = drop_listed(out, columns_to_remove)
    if remove_constant:
        model = ConstantColumns(constant_threshold).fit(out, exclude=[target])
        out = model.transform(out)
        info["constant_columns"] = model.constant
    out = drop_null_target(out, target)
    out, info["empty_columns"] = drop_empty_columns(out)
    out = dedupe_rows(out)
    info["final_columns"] = len(out.columns)
    return out, info
