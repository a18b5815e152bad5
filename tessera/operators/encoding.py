"""Categorical encoding (C6, C6a, C6b, C7) and imputation.

Routing by cardinality: fewer than ``low`` distinct values → one-hot with the
first sorted level dropped; ``low``..``high``-1 → target encoding; ``high`` or
more → label encoding.  The routing bounds the size of every small table we
broadcast: one-hot levels (< low) and target-encoding statistics (< high
categories).  Label encoding has no bound, so its level table is numbered
distributed (global sort, numbers within and offsets of partitions) and joined
normally.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import profile as P
from .numbering import number_rows
from .quantiles import grouped_quantiles

LOW_CARD, HIGH_CARD = 10, 100
BROADCAST_MAX_ROWS = 200_000


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast-hint a small table only after checking its row count.

    The count runs on an already-aggregated table (cheap); above the bound the
    join stays a shuffle join (AQE may still pick broadcast from real sizes).
    """
    return F.broadcast(df) if df.count() <= max_rows else df


# --------------------------------------------------------------------------- C6
def cardinality(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact distinct non-null count per column.

    Several ``count(DISTINCT c)`` in one aggregate make Spark copy every row
    once per column (Expand); instead the cells are unpivoted, deduplicated
    map-side and counted per column — one shuffle of distinct cells.
    """
    cols = list(cols)
    if not cols:
        return {}
    cells = P._unpivot(df, cols, "string").where(F.col("value").isNotNull()).distinct()
    got = {r["column"]: r["n"] for r in
           cells.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: got.get(c, 0) for c in cols}


def route(n_unique: int, low: int = LOW_CARD, high: int = HIGH_CARD) -> str:
    if n_unique < low:
        return "one_hot"
    if n_unique < high:
        return "target"
    return "label"


def cardinality_routing(df: DataFrame, cols: Sequence[str] | None = None,
                        low: int = LOW_CARD, high: int = HIGH_CARD) -> DataFrame:
    """``(column, n_unique, method)`` for every text column."""
    cols = list(cols) if cols is not None else P.string_columns(df)
    nu = cardinality(df, cols)
    return df.sparkSession.createDataFrame(
        [(c, nu[c], route(nu[c], low, high)) for c in cols],
        "column string, n_unique long, method string")


def cardinality_classes(df: DataFrame, cols: Sequence[str] | None = None, low: int = LOW_CARD,
                        high: int = HIGH_CARD, columns_per_job: int = 60) -> dict:
    """The route of every text column, without a shuffle of cells.

    One pass counts the distinct values of all columns by sketch (HyperLogLog, 2 %).
    Columns that are clearly above ``high`` are settled; for the others, which have
    few values, a second pass collects the values themselves and counts them exactly.
    """
    cols = list(cols) if cols is not None else P.string_columns(df)

    def job(make, names):
        out = {}
        for k in range(0, len(names), columns_per_job):
            mine = names[k:k + columns_per_job]
            row = df.agg(*[make(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(mine)]).first()
            out |= {c: row[f"c{i}"] for i, c in enumerate(mine)}
        return out
    about = job(lambda c: F.approx_count_distinct(c, 0.02), cols)
    exact = job(lambda c: F.size(F.collect_set(c)), [c for c in cols if about[c] <= 1.25 * high])
    return {c: route(exact.get(c, about[c]), low, high) for c in cols}


# --------------------------------------------------------------------------- C6a
@dataclass
class OneHotModel:
    levels: dict  # column -> sorted levels kept (first dropped)

    def transform(self, df: DataFrame) -> DataFrame:
        """``{col}_{level}`` booleans; null → all false; the source column is replaced."""
        out_cols = [F.col(f"`{c}`") for c in df.columns if c not in self.levels]
        for c, levels in self.levels.items():
            out_cols += [F.coalesce(F.col(f"`{c}`") == F.lit(lv), F.lit(False)).alias(f"{c}_{lv}")
                         for lv in levels]
        return df.select(*out_cols)


class OneHot:
    """Levels of all columns from one job; any number of levels (the routing keeps them few)."""

    def __init__(self, drop_first: bool = True):
        self.drop_first = drop_first

    def fit(self, df: DataFrame, cols: Sequence[str]) -> OneHotModel:
        cells = P._unpivot(df, list(cols), "string").where(F.col("value").isNotNull()).distinct().collect()
        levels = {c: sorted(r["value"] for r in cells if r["column"] == c) for c in cols}
        return OneHotModel({c: lv[1:] if self.drop_first else lv for c, lv in levels.items()})


# --------------------------------------------------------------------------- C6b
@dataclass
class LabelModel:
    tables: dict  # column -> DataFrame(value string, code long)
    unseen: int | None = None

    def transform(self, df: DataFrame, missing_token: str = "nan") -> DataFrame:
        """Codes of the text form (nulls as ``missing_token``); unseen values → ``unseen`` (null by default)."""
        out = df
        for c, tab in self.tables.items():
            key = f"__{c}_key"
            out = (out.withColumn(key, F.coalesce(F.col(c).cast("string"), F.lit(missing_token)))
                      .join(tab.withColumnRenamed("value", key).withColumnRenamed("code", f"__{c}_code"),
                            on=key, how="left")
                      .withColumn(c, F.coalesce(F.col(f"__{c}_code"), F.lit(self.unseen).cast("long")))
                      .drop(key, f"__{c}_code"))
        return out.select(*df.columns)


class LabelEncoding:
    """Sorted distinct text values → 0..n-1, nulls encoded as the text 'nan'.

    The distinct cells of all columns are sorted and numbered once across the
    cluster; a value's code is its number less its column's first.
    """

    def __init__(self, missing_token: str = "nan", unseen: int | None = None):
        self.missing_token, self.unseen = missing_token, unseen

    def fit(self, df: DataFrame, cols: Sequence[str]) -> LabelModel:
        cells = P._unpivot(df, list(cols), "string").select(
            "column", F.coalesce("value", F.lit(self.missing_token)).alias("value")).distinct()
        placed = number_rows(cells, ["column", "value"], "place")
        first = {r["column"]: r["m"] for r in placed.groupBy("column").agg(F.min("place").alias("m")).collect()}
        return LabelModel({c: placed.where(F.col("column") == c).select(
            "value", (F.col("place") - F.lit(first.get(c, 0))).alias("code")) for c in cols}, self.unseen)


# --------------------------------------------------------------------------- C7
@dataclass
class TargetEncodingModel:
    column: str
    stats: DataFrame       # (category, n, mean, var) over all training rows
    global_mean: float
    global_var: float

    def transform(self, df: DataFrame, out_col: str | None = None) -> DataFrame:
        """Full-train encoding (validation / test rows); unseen categories → train mean."""
        out_col = out_col or self.column
        enc = _shrunk(F.col("__n"), F.col("__mean"), F.col("__var"),
                      F.lit(self.global_mean), F.lit(self.global_var))
        st = sized_broadcast(self.stats.select(
            F.col("category").alias("__cat"), F.col("n").alias("__n"),
            F.col("mean").alias("__mean"), F.col("var").alias("__var")))
        joined = df.join(st, _null_safe_key(df, self.column, "__cat"), "left")
        return (joined.withColumn(out_col, F.coalesce(enc, F.lit(self.global_mean)))
                      .drop("__cat", "__n", "__mean", "__var"))


def _null_safe_key(df: DataFrame, col: str, other: str):
    return F.col(col).cast("string").eqNullSafe(F.col(other))


def _shrunk(n, mean, var, gmean, gvar):
    """Empirical-Bayes shrinkage: λ = σ²n / (σ²n + s²); λ·mean + (1−λ)·global."""
    lam = F.coalesce(F.try_divide(gvar * n, gvar * n + var), F.lit(1.0))
    return F.when(n > 0, lam * mean + (F.lit(1.0) - lam) * gmean)


def _moments(df: DataFrame, keys: list, y: str, center: float) -> DataFrame:
    """Count, and sums of centred y and y² per key (additive, so folds subtract)."""
    yc = F.col(y).cast("double") - F.lit(center)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(yc).alias("s"),
                                 F.sum(yc * yc).alias("ss"))


def _mean_var(n, s, ss, center):
    mean_c = F.try_divide(s, n.cast("double"))
    var = F.greatest(F.try_divide(ss, n.cast("double")) - mean_c * mean_c, F.lit(0.0))
    return mean_c + F.lit(center), var


class TargetEncoding:
    """Shrinkage target encoder (Micci-Barreca 2001), null category = own level.

    ``fit`` gives the full-train model; ``fit_transform_crossfit`` encodes the
    training rows out-of-fold: a row in fold f is encoded with statistics of
    the other folds only (category and global moments), which is what keeps
    the encoding leak-free.  Sums are additive, so leave-fold-out statistics
    are totals minus the fold's own sums — one aggregation, no per-fold refit.
    """

    def fit(self, df: DataFrame, column: str, target: str) -> TargetEncodingModel:
        g = df.agg(F.count(target).alias("n"), F.avg(target).alias("m"),
                   F.var_pop(target).alias("v")).first()
        center = float(g["m"] or 0.0)
        d = df.where(F.col(target).isNotNull()).withColumn("category", F.col(column).cast("string"))
        mom = _moments(d, ["category"], target, center)
        mean, var = _mean_var(F.col("n"), F.col("s"), F.col("ss"), center)
        stats = mom.select("category", "n", mean.alias("mean"), var.alias("var"))
        return TargetEncodingModel(column, stats, center, float(g["v"] or 0.0))

    def fit_transform_crossfit(self, df: DataFrame, column: str, target: str, fold_col: str,
                               out_col: str | None = None) -> DataFrame:
        out_col = out_col or column
        center = float(df.agg(F.avg(target)).first()[0] or 0.0)
        d = df.withColumn("__cat", F.col(column).cast("string"))
        valid = d.where(F.col(target).isNotNull())
        per_cf = _moments(valid, ["__cat", fold_col], target, center)
        per_c = per_cf.groupBy("__cat").agg(*[F.sum(x).alias(f"t_{x}") for x in ("n", "s", "ss")])
        per_f = _moments(valid, [fold_col], target, center)
        tot = valid.agg(F.count(F.lit(1)).alias("N"), F.sum(F.col(target) - F.lit(center)).alias("S"),
                        F.sum((F.col(target) - F.lit(center)) ** 2).alias("SS")).first()
        per_c = per_c.withColumnRenamed("__cat", "__all")
        loo = (per_cf.join(per_c, F.col("__cat").eqNullSafe(F.col("__all")))
                     .select("__cat", fold_col,
                             (F.col("t_n") - F.col("n")).alias("__n"),
                             (F.col("t_s") - F.col("s")).alias("__s"),
                             (F.col("t_ss") - F.col("ss")).alias("__ss")))
        gl = per_f.select(fold_col, (F.lit(tot["N"]) - F.col("n")).alias("__gn"),
                          (F.lit(tot["S"] or 0.0) - F.col("s")).alias("__gs"),
                          (F.lit(tot["SS"] or 0.0) - F.col("ss")).alias("__gss"))
        cmean, cvar = _mean_var(F.col("__n"), F.col("__s"), F.col("__ss"), center)
        gmean, gvar = _mean_var(F.col("__gn"), F.col("__gs"), F.col("__gss"), center)
        enc = F.coalesce(_shrunk(F.col("__n"), cmean, cvar, gmean, gvar), gmean)
        loo = loo.withColumnRenamed("__cat", "__lcat").withColumnRenamed(fold_col, "__lfold")
        # gl has one row per fold; loo has categories x folds rows and is
        # broadcast only below a checked size.
        out = (d.join(sized_broadcast(loo), on=[F.col("__cat").eqNullSafe(F.col("__lcat")),
                                                F.col(fold_col) == F.col("__lfold")], how="left")
                .drop("__lcat", "__lfold")
                .join(F.broadcast(gl), on=fold_col, how="left")
                .withColumn(out_col, enc))
        return out.drop("__cat", "__n", "__s", "__ss", "__gn", "__gs", "__gss")


    def encode_split(self, df: DataFrame, columns: Sequence[str], target: str, fold_col: str) -> DataFrame:
        """Encode several columns of a split table at once.

        Rows with a fold (training) get the statistics of the other folds, rows
        without (validation, test) those of all training rows, unseen categories
        the global mean.  One aggregation serves all columns; the codes are worked
        out once per category and fold, and each column then costs one join with
        its categories (one row each, codes by fold as a map).
        """
        columns = list(columns)
        train = df.where(F.col(fold_col).isNotNull() & F.col(target).isNotNull())
        center = float(train.agg(F.avg(target)).first()[0] or 0.0)
        per_f = {r[fold_col]: r for r in _moments(train, [fold_col], target, center).collect()}
        total = [sum(r[x] for r in per_f.values()) for x in ("n", "s", "ss")]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns])
        cut = _moments(train.select(fold_col, target, F.inline(cells)), ["column", "category", fold_col], target, center)
        stats = cut.groupBy("column", "category").agg(
            F.sum("n").alias("__n"), F.sum("s").alias("__s"), F.sum("ss").alias("__ss"),
            F.map_from_entries(F.collect_list(F.struct(fold_col, F.struct("n", "s", "ss")))).alias("__own"))
        folds = [F.lit(f).cast(df.schema[fold_col].dataType) for f in [*sorted(per_f), None]]
        stats = stats.withColumn(fold_col, F.explode(F.array(*folds)))

        def less(all_: Column, own: Column) -> Column:
            return all_ - F.coalesce(own, F.lit(0))
        own = F.element_at("__own", F.col(fold_col))
        own_global = F.element_at(F.create_map(*[x for f, r in per_f.items() for x in (
            F.lit(f), F.struct(F.lit(r["n"]).alias("n"), F.lit(r["s"]).alias("s"), F.lit(r["ss"]).alias("ss")))]),
            F.col(fold_col)) if per_f else F.lit(None).cast("struct<n:long,s:double,ss:double>")
        gmean, gvar = _mean_var(*[less(F.lit(t), own_global[x]) for t, x in zip(total, ("n", "s", "ss"))], center)
        mean, var = _mean_var(*[less(F.col(f"__{x}"), own[x]) for x in ("n", "s", "ss")], center)
        enc = F.coalesce(_shrunk(less(F.col("__n"), own["n"]), mean, var, gmean, gvar), gmean, F.lit(center))
        codes = cut_lineage(stats.withColumn("__code", enc).groupBy("column", "category").agg(
            F.map_from_entries(F.collect_list(F.when(F.col(fold_col).isNotNull(), F.struct(fold_col, "__code")))).alias("__by"),
            F.max(F.when(F.col(fold_col).isNull(), F.col("__code"))).alias("__all")))

        def mean_less(n, s) -> float:
            return (total[1] - s) / float(total[0] - n) + center if total[0] > n else center
        unseen = F.lit(mean_less(0, 0))
        for f, r in per_f.items():
            unseen = F.when(F.col(fold_col) == F.lit(f), F.lit(mean_less(r["n"], r["s"]))).otherwise(unseen)
        for c in columns:
            mine = codes.where(F.col("column") == c).select(F.col("category").alias("__cat"), "__by", "__all")
            df = (df.join(sized_broadcast(mine), _null_safe_key(df, c, "__cat"), "left")
                  .withColumn(c, F.coalesce(F.element_at("__by", F.col(fold_col)), F.col("__all"), unseen))
                  .drop("__cat", "__by", "__all"))
        return df


# --------------------------------------------------------------------------- C8
def column_modes(df: DataFrame, cols: Sequence[str], as_type: str) -> dict:
    """Most frequent non-null value per column (ties → smallest), one shuffle."""
    if not cols:
        return {}
    cells = P._unpivot(df, cols, as_type).where(F.col("value").isNotNull())
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return {r["column"]: r["mode"] for r in modes.collect()}


@dataclass
class ImputerModel:
    fills: dict
    dropped: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Null and NaN become the column's fill."""
        out = P.nan_to_null(df.drop(*self.dropped))
        return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fills.items()
                                if c in out.columns})


class Imputer:
    """Numeric: median / mean / most_frequent; text: constant ('MISSING') or
    most_frequent.  All-null numeric columns are dropped.  Only columns with
    missing values get a fill, or with ``every`` all columns (for rows that the
    fit has not seen).  NaN is missing.  Medians are exact (``grouped_quantiles``)."""

    def __init__(self, numeric: str = "median", categorical: str = "constant",
                 fill_value: str = "MISSING", every: bool = False):
        self.numeric, self.categorical, self.fill_value, self.every = numeric, categorical, fill_value, every

    def fit(self, df: DataFrame, target: str | None = None) -> ImputerModel:
        df = P.nan_to_null(df)
        num = P.numeric_columns(df, [target] if target else [])
        cat = P.string_columns(df)
        census = {r["column"]: r for r in P.null_census(df, num + cat).collect()}
        num_m = [c for c in num if self.every or census[c]["n_missing"] > 0]
        cat_m = [c for c in cat if self.every or census[c]["n_missing"] > 0]
        dropped = [c for c in num_m if census[c]["n_missing"] == census[c]["n_rows"]]
        num_m = [c for c in num_m if c not in dropped]
        fills = {}
        if num_m:
            if self.numeric == "mean":
                row = df.agg(*[F.avg(c).alias(c) for c in num_m]).first()
                fills.update({c: float(row[c]) for c in num_m})
            elif self.numeric == "median":
                long = P._unpivot(df, num_m, "double")
                med = grouped_quantiles(long, ["column"], "value", [0.5]).collect()
                fills.update({r["column"]: float(r["q_0"]) for r in med})
            elif self.numeric == "most_frequent":
                fills.update(column_modes(df, num_m, "double"))
            else:
                raise ValueError(self.numeric)
        if cat_m:
            if self.categorical == "constant":
                fills.update({c: self.fill_value for c in cat_m})
            elif self.categorical == "most_frequent":
                fills.update(column_modes(df, cat_m, "string"))
            else:
                raise ValueError(self.categorical)
        return ImputerModel(fills, dropped)
