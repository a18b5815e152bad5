"""Regression metrics, rankings and summaries over long prediction tables.

Predictions are kept long — ``(row_id, model, split, label, prediction)`` —
so every metric is one ``groupBy(model, split)`` aggregation and never a
driver loop over models (A15-A19, W5-W7, M10).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16  # float64 machine epsilon (MAPE denominator floor)
FAMILIES = ["Baseline", "Optimized", "Ensemble"]


def regression_metrics(pred: DataFrame, group_cols: Sequence[str], label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """N, RMSE, R² (1 − SSres/SStot), MAE, MAPE % per group.

    SStot = n · var_pop(label) (numerically stable); R² is null when the label
    is constant in the group.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = y - p
    n = F.count(F.lit(1))
    ss_res = F.sum(err * err)
    ss_tot = F.var_pop(y) * n
    return pred.groupBy(*group_cols).agg(
        n.alias("n"),
        F.sqrt(ss_res / n).alias("rmse"),
        (F.lit(1.0) - F.try_divide(ss_res, ss_tot)).alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(EPS))) * 100.0).alias("mape"))


def validation_table(pred: DataFrame, model_col: str = "model", split_col: str = "split",
                     label: str = "label", prediction: str = "prediction",
                     times: DataFrame | None = None) -> DataFrame:
    """Train/val metrics side by side per model and the overfit ratio val/train RMSE."""
    m = regression_metrics(pred.where(F.col(split_col).isin("train", "val")), [model_col, split_col],
                           label, prediction)
    wide = m.groupBy(model_col).pivot(split_col, ["train", "val"]).agg(
        F.first("rmse").alias("rmse"), F.first("r2").alias("r2"),
        F.first("mae").alias("mae"), F.first("mape").alias("mape"))
    out = wide.select(
        model_col,
        *[F.col(f"{s}_{m_}").alias(f"{s.capitalize()}_{m_.upper() if m_ != 'r2' else 'R2'}")
          for s in ("train", "val") for m_ in ("rmse", "r2", "mae", "mape")])
    out = out.withColumn("Overfit_Ratio", F.when(F.col("Train_RMSE") > 0,
                                                 F.col("Val_RMSE") / F.col("Train_RMSE"))
                         .otherwise(F.lit(float("inf"))))
    if times is not None:
        out = out.join(times, on=model_col, how="left")
    return out


def average_rank(order: Column, partition: Sequence[str] = (), descending: bool = True) -> Column:
    """Rank with ties sharing the mean of their positions (pandas 'average')."""
    o = order.desc() if descending else order.asc()
    w = Window.partitionBy(*partition).orderBy(o) if partition else Window.orderBy(o)
    wt = (Window.partitionBy(*partition, order) if partition else Window.partitionBy(order))
    r = F.rank().over(w)
    ties = F.count(F.lit(1)).over(wt)
    return r.cast("double") + (ties - 1).cast("double") / 2.0


def rank_models(results: DataFrame, metric: str = "Val_RMSE", ascending: bool = True,
                model_col: str = "model") -> DataFrame:
    """Ranking table (one row per model; the results table is small by nature)."""
    w = Window.orderBy(F.col(metric).asc() if ascending else F.col(metric).desc(), F.col(model_col))
    return results.withColumn("rank", F.row_number().over(w))


def best_models(results: DataFrame, metric: str = "Val_RMSE", ascending: bool = True,
                model_col: str = "model", max_overfit: float = 1.2) -> DataFrame:
    """Best overall, best per family (name contains Baseline / Optimized /
    Ensemble) and best with overfit ratio ≤ ``max_overfit`` → (selection, model, metric)."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    fam = F.coalesce(*[F.when(F.col(model_col).contains(f), F.lit(f"best_{f.lower()}")) for f in FAMILIES])
    rows = results.select(model_col, metric, "Overfit_Ratio", fam.alias("__fam"))
    tagged = rows.withColumn("__sel", F.explode(F.array_compact(F.array(
        F.lit("best_overall"), F.col("__fam"),
        F.when(F.col("Overfit_Ratio") <= max_overfit, F.lit("best_balanced"))))))
    w = Window.partitionBy("__sel").orderBy(order, F.col(model_col))
    return (tagged.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
                  .select(F.col("__sel").alias("selection"), model_col, metric))


def run_summary(results: DataFrame, time_col: str = "Training_Time") -> DataFrame:
    """Model count, mean / sample-std val RMSE, mean val R², mean training
    time, mean val/train RMSE ratio and its status band (good in [1.05, 1.2])."""
    ratio = F.avg(F.col("Val_RMSE") / F.col("Train_RMSE"))
    agg = results.agg(
        F.count(F.lit(1)).alias("total_models"), F.avg("Val_RMSE").alias("avg_rmse"),
        F.stddev_samp("Val_RMSE").alias("std_rmse"), F.avg("Val_R2").alias("avg_r2"),
        F.avg(time_col).alias("avg_training_time"), ratio.alias("avg_overfit_ratio"))
    return agg.withColumn("overfit_status", F.when(
        (F.col("avg_overfit_ratio") >= 1.05) & (F.col("avg_overfit_ratio") <= 1.2), F.lit("good"))
        .otherwise(F.lit("warning")))


def cv_scores(fold_scores: DataFrame, model_col: str = "model", score_col: str = "score") -> DataFrame:
    """Mean and population std of per-fold scores per model."""
    return fold_scores.groupBy(model_col).agg(F.avg(score_col).alias("cv_score_mean"),
                                              F.stddev_pop(score_col).alias("cv_score_std"),
                                              F.count(F.lit(1)).alias("n_folds"))


def fold_metrics(pred: DataFrame, model_col: str = "model", fold_col: str = "fold",
                 label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per (model, fold) negative RMSE — the CV score of the reference's metric."""
    m = regression_metrics(pred, [model_col, fold_col], label, prediction)
    return m.select(model_col, fold_col, (-F.col("rmse")).alias("score"))


def scale_diagnostics(df: DataFrame, cols: Sequence[str], split_col: str = "split") -> DataFrame:
    """Per split and column — non-finite count, population std, range and
    the std/range warnings (std > 1e4, range > 1e6)."""
    rows = df.select(split_col, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])))
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != F.lit(float("inf")))
    out = rows.groupBy(split_col, "column").agg(
        F.count_if(~finite).alias("n_non_finite"),
        F.stddev_pop(F.when(finite, F.col("v"))).alias("std"),
        (F.max(F.when(finite, F.col("v"))) - F.min(F.when(finite, F.col("v")))).alias("range"),
        F.avg(F.when(finite, F.col("v"))).alias("mean"))
    return (out.withColumn("large_std", F.col("std") > 1e4)
               .withColumn("large_range", F.col("range") > 1e6))


def train_val_shift(diag: DataFrame, split_col: str = "split") -> DataFrame:
    """Relative std and mean differences train vs val per column, flagged
    above 0.5 and 0.3 (denominators floored at 1e-10)."""
    w = diag.groupBy("column").pivot(split_col, ["train", "val"]).agg(
        F.first("std").alias("std"), F.first("mean").alias("mean"))
    sd = F.abs(F.col("train_std") - F.col("val_std")) / F.greatest(F.col("train_std"), F.lit(1e-10))
    md = F.abs(F.col("train_mean") - F.col("val_mean")) / F.greatest(F.abs(F.col("train_mean")), F.lit(1e-10))
    return w.select("column", sd.alias("std_diff"), md.alias("mean_diff"),
                    (sd > 0.5).alias("std_shift"), (md > 0.3).alias("mean_shift"))


def mean_importance(importance: DataFrame, feature_col: str = "feature",
                    value_col: str = "importance") -> DataFrame:
    """Average importance per feature across models."""
    return importance.groupBy(feature_col).agg(F.avg(value_col).alias("mean_importance"))


def test_evaluation(pred: DataFrame, model_col: str = "model", label_log: str = "label",
                    prediction_log: str = "prediction", label_orig: str = "label_orig",
                    shift: float = 0.0) -> DataFrame:
    """Test metrics on the model (log) scale and on the original scale
    (prediction mapped back with expm1 − shift; the shift is the fitted one)."""
    pred = pred.withColumn("__pred_orig", F.expm1(F.col(prediction_log)) - F.lit(shift))
    a = regression_metrics(pred, [model_col], label_log, prediction_log)
    b = regression_metrics(pred, [model_col], label_orig, "__pred_orig")
    return a.select(model_col, *[F.col(c).alias(f"{c}_log") for c in ("rmse", "r2", "mae", "mape")]).join(
        b.select(model_col, *[F.col(c).alias(f"{c}_orig") for c in ("rmse", "r2", "mae", "mape")]),
        on=model_col)


def top_k(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in the given order (ties broken
    by the later order columns).  The window's groups are the caller's small
    result groups (models, features, components), not raw data keys; without
    groups Spark's top-k keeps k rows per task."""
    if not group_cols:
        df = df.orderBy(*order).limit(k)
    w = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
