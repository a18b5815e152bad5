"""Quality checks: target leakage (V2), category drift (A8/V3), roll-up (V4).

V1 (temporal gaps) and V5 (allclose) live with the splits they check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import profile as P

SPLITS = ["train", "val", "test"]


def target_leakage(df: DataFrame, target: str, features: Sequence[str] | None = None,
                   max_correlation: float = 0.95) -> DataFrame:
    """V2: ``(feature, correlation, reason, suspicious)`` per numeric feature.

    A feature is suspicious when its name contains the target's name
    (case-insensitive) or when |r(feature with nulls as 0, target)| exceeds
    ``max_correlation``.  Correlations come from one aggregation (A14).
    """
    feats = list(features) if features is not None else P.numeric_columns(df, [target])
    corr = P.target_correlations(df, feats, target)
    by_name = F.lower(F.col("feature")).contains(target.lower())
    by_corr = F.coalesce(F.abs(F.col("r")) > F.lit(max_correlation), F.lit(False))
    return corr.select(
        "feature", F.col("r").alias("correlation"),
        F.when(by_name, F.lit("name contains target"))
         .when(by_corr, F.lit("high correlation")).alias("reason"),
        (by_name | by_corr).alias("suspicious"))


def category_shares(df: DataFrame, cols: Sequence[str], split_col: str = "split") -> DataFrame:
    """Share of each category within each split, categories unioned across
    splits with 0 for absent ones: ``(column, value, train, val, test)``.

    One unpivot + ``groupBy(column, value).pivot(split)`` — a single shuffle of
    distinct cells whatever the number of columns.
    """
    cells = df.select(F.col(split_col).alias("__split"),
                      F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.col(c).cast("string").alias("value"))
                                         for c in cols])))
    cells = cells.where(F.col("value").isNotNull())
    counts = cells.groupBy("column", "value").pivot("__split", SPLITS).agg(F.count(F.lit(1)))
    counts = counts.fillna(0, subset=SPLITS)
    totals = cells.groupBy("column").pivot("__split", SPLITS).agg(F.count(F.lit(1)))
    totals = totals.select("column", *[F.col(s).alias(f"__t_{s}") for s in SPLITS])
    shares = counts.join(totals, "column")
    return shares.select("column", "value", *[
        F.coalesce(F.try_divide(F.col(s).cast("double"), F.col(f"__t_{s}").cast("double")), F.lit(0.0)).alias(s)
        for s in SPLITS])


def category_drift(df: DataFrame, cols: Sequence[str], split_col: str = "split",
                   max_drift: float = 0.05) -> DataFrame:
    """V3: per column the largest share difference for each pair of splits,
    their maximum, and whether it exceeds ``max_drift``."""
    sh = category_shares(df, cols, split_col)
    d = sh.groupBy("column").agg(
        F.max(F.abs(F.col("train") - F.col("val"))).alias("train_val_drift"),
        F.max(F.abs(F.col("train") - F.col("test"))).alias("train_test_drift"),
        F.max(F.abs(F.col("val") - F.col("test"))).alias("val_test_drift"))
    mx = F.greatest("train_val_drift", "train_test_drift", "val_test_drift")
    return d.withColumn("max_drift", mx).withColumn("drifted", mx > F.lit(max_drift))


def quality_rollup(spark, checks: dict) -> DataFrame:
    """V4: one row of check verdicts plus ``all_valid`` / ``leakage_detected``.

    ``checks`` maps a check name to a small verdict DataFrame already computed
    (temporal validity row, leakage table, drift table).
    """
    temporal = checks.get("temporal")
    leakage = checks.get("leakage")
    drift = checks.get("drift")
    t_valid = bool(temporal.first()["valid"]) if temporal is not None else True
    leak = bool(leakage.agg(F.bool_or("suspicious")).first()[0]) if leakage is not None else False
    d_valid = not bool(drift.agg(F.bool_or("drifted")).first()[0]) if drift is not None else True
    return spark.createDataFrame(
        [(t_valid, leak, d_valid, t_valid and d_valid and not leak)],
        "temporal_valid boolean, leakage_detected boolean, drift_valid boolean, all_valid boolean")
