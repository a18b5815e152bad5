"""Outlier detection: z-score (O1), IQR (O2), votes (O4), per category (O5),
global fallback (O6) and the per-category report (A7).

Global statistics are a few numbers (one aggregation) used as literals; per
category statistics are one aggregation row per category, joined back after
a size check.  Quantiles are exact and bounded (``grouped_quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import sized_broadcast
from .forest import isolation_flags
from .quantiles import grouped_quantiles, quantiles


def _z_flag(y: Column, mean: Column, std: Column, t: float) -> Column:
    """|y − mean| / std_pop > t; a zero std flags nothing (pandas gives NaN)."""
    return F.coalesce(F.abs(F.try_divide(y - mean, std)) > F.lit(t), F.lit(False))


def _iqr_flag(y: Column, q1: Column, q3: Column, m: float) -> Column:
    iqr = q3 - q1
    return F.coalesce((y < q1 - F.lit(m) * iqr) | (y > q3 + F.lit(m) * iqr), F.lit(False))


def _stats(df: DataFrame, group: list, y: str) -> DataFrame:
    """n, mean, population std, Q1, Q3 of y per group (one row per group)."""
    mom = df.groupBy(*group).agg(F.count(y).alias("__cnt"), F.avg(y).alias("__mean"),
                                 F.stddev_pop(y).alias("__std"))
    q = grouped_quantiles(df, group, y, [0.25, 0.75]).select(
        *group, F.col("q_0").alias("__q1"), F.col("q_1").alias("__q3"))
    return mom.join(q, on=group, how="left") if group else mom.withColumn("__one", F.lit(1)).join(
        q.withColumn("__one", F.lit(1)), "__one").drop("__one")


def detect_outliers(df: DataFrame, y: str, key_cols: Sequence[str],
                    features: Sequence[str] | None = None, z_threshold: float = 3.0,
                    iqr_multiplier: float = 1.5, contamination: float = 0.1,
                    min_methods: int = 2, n_trees: int = 100, seed: int = 42) -> DataFrame:
    """O4 (global): per-method flags and the vote.

    Adds ``z_out``, ``iqr_out``, (``iso_out`` when ``features``), ``votes`` and
    ``is_outlier`` (votes ≥ min_methods).  Without features it is O6.
    """
    st = _stats(df, [], y).first()
    yc = F.col(y).cast("double")
    out = df.withColumn("z_out", _z_flag(yc, F.lit(st["__mean"]), F.lit(st["__std"]), z_threshold))
    out = out.withColumn("iqr_out", _iqr_flag(yc, F.lit(st["__q1"]), F.lit(st["__q3"]), iqr_multiplier))
    votes = F.col("z_out").cast("int") + F.col("iqr_out").cast("int")
    if features:
        iso = isolation_flags(df, features, key_cols, contamination, None, n_trees, 256, seed)
        out = out.join(iso.select(*key_cols, F.col("is_outlier").alias("iso_out")), on=list(key_cols),
                       how="left").withColumn("iso_out", F.coalesce("iso_out", F.lit(False)))
        votes = votes + F.col("iso_out").cast("int")
    return out.withColumn("votes", votes).withColumn("is_outlier", F.col("votes") >= min_methods)


def outlier_statistics(flagged: DataFrame, y: str, iqr_multiplier: float = 1.5) -> DataFrame:
    """O4 report: one row of numbers about a table that ``detect_outliers`` has flagged.

    n_rows, one ``n_<method>`` for each method used, total_outliers, outlier_percentage,
    and of the target: min, max, mean, sample std, q1, q3, iqr and the two bounds.
    Missing targets count as rows only; an empty table gives zeros and nulls.
    """
    v = F.col(y).cast("double")
    v = F.when(~F.isnan(v), v)
    methods = [c for c in ("z_out", "iqr_out", "iso_out") if c in flagged.columns]
    out = flagged.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(m).alias(f"n_{m.removesuffix('_out')}") for m in methods],
                      F.count_if("is_outlier").alias("total_outliers"), F.min(v).alias("target_min"), F.max(v).alias("target_max"),
                      F.avg(v).alias("target_mean"), F.stddev_samp(v).alias("target_std"))
    q1, q3 = (F.lit(q).cast("double") for q in quantiles(flagged.where(v.isNotNull()), y, [0.25, 0.75]))
    share = F.try_divide(F.col("total_outliers").cast("double"), F.col("n_rows")) * 100
    return out.select("*", share.alias("outlier_percentage"), q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
                      (q1 - (q3 - q1) * iqr_multiplier).alias("lower_bound"), (q3 + (q3 - q1) * iqr_multiplier).alias("upper_bound"))


def detect_outliers_by_category(df: DataFrame, y: str, category: str, key_cols: Sequence[str],
                                features: Sequence[str] | None = None, z_threshold: float = 2.5,
                                iqr_multiplier: float = 1.5, contamination: float = 0.05,
                                min_methods: int = 2, min_samples: int = 30,
                                forest_min_samples: int = 50, log_target: bool = True,
                                n_trees: int = 100, seed: int = 42) -> DataFrame:
    """The same vote inside each category, on log1p(y) by default.

    Categories with fewer than ``min_samples`` rows are skipped (never
    flagged), the forest runs only for categories with ≥ ``forest_min_samples``
    rows, and a null category is never flagged.  Adds ``y_log`` (if
    ``log_target``), ``z_out``, ``iqr_out``, ``iso_out``, ``votes``, ``is_outlier``.
    """
    ycol = "y_log" if log_target else y
    base = df.withColumn("y_log", F.log1p(F.col(y).cast("double"))) if log_target else df
    known = base.where(F.col(category).isNotNull())
    st = _stats(known, [category], ycol)
    cat_rows = known.groupBy(category).agg(F.count(F.lit(1)).alias("__rows"))
    st = st.join(cat_rows, category)
    out = base.join(sized_broadcast(st), on=category, how="left")
    active = F.coalesce(F.col("__rows") >= min_samples, F.lit(False))
    yv = F.col(ycol)
    out = (out.withColumn("z_out", active & _z_flag(yv, F.col("__mean"), F.col("__std"), z_threshold))
              .withColumn("iqr_out", active & _iqr_flag(yv, F.col("__q1"), F.col("__q3"), iqr_multiplier)))
    votes = F.col("z_out").cast("int") + F.col("iqr_out").cast("int")
    if features:
        big = known.join(cat_rows.where(F.col("__rows") >= forest_min_samples).select(category),
                         category, "left_semi")
        iso = isolation_flags(big, features, key_cols, contamination, category, n_trees, 256, seed)
        out = (out.join(iso.select(*key_cols, F.col("is_outlier").alias("iso_out")), on=list(key_cols),
                        how="left")
                  .withColumn("iso_out", F.coalesce("iso_out", F.lit(False)) & active))
        votes = votes + F.col("iso_out").cast("int")
    out = out.withColumn("votes", votes).withColumn("is_outlier", F.col("votes") >= min_methods)
    return out.drop("__cnt", "__mean", "__std", "__q1", "__q3", "__rows")


def category_report(df: DataFrame, y: str, category: str, flag: str = "is_outlier") -> DataFrame:
    """Per category — rows, outliers, share (%), target mean/sample std for
    all and for clean rows, min, max (sorted by share when presented)."""
    clean = F.when(~F.col(flag), F.col(y))
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(flag)).alias("n_outliers"),
        (F.count_if(F.col(flag)) * 100.0 / F.count(F.lit(1))).alias("pct_outliers"),
        F.avg(y).alias("mean_all"), F.avg(clean).alias("mean_clean"),
        F.stddev_samp(y).alias("std_all"), F.stddev_samp(clean).alias("std_clean"),
        F.min(y).alias("min"), F.max(y).alias("max"))
