"""Registered queries for metrics, ranking and selection.

The prediction table is a stand-in for model outputs: for each order (label
= log1p of ``o_totalprice``, temporal split) five named "models" predict the
label plus a fixed key-dependent error.  The expressions below are plain SQL,
used verbatim by Spark (``F.expr``) and by the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .common import rnd, sql_rnd
from .queries_splits import _TEMPORAL_SQL, _temporal
from .registry import query

# Stand-in model outputs as SQL over (label, o_orderkey, split).
MODELS = {
    "Baseline_Linear": "label + ((o_orderkey % 7) - 3) * 0.01",
    "Baseline_Ridge": "label * 0.98 + 0.2 + (o_orderkey % 5) * 0.005",
    "Optimized_RandomForest": "label + ((o_orderkey % 11) - 5) * 0.004 + CASE WHEN split = 'train' THEN 0.0 ELSE 0.003 END",
    "Optimized_GBT": "label + (((o_orderkey * 7) % 13) - 6) * 0.003",
    "Ensemble_Voting": "label + ((o_orderkey % 3) - 1) * 0.002",
}
TIMES = {"Baseline_Linear": 0.5, "Baseline_Ridge": 0.6, "Optimized_RandomForest": 12.0,
         "Optimized_GBT": 20.0, "Ensemble_Voting": 30.0}


def predictions(spark, d):
    base = (_temporal(spark, d)
            .select("o_orderkey", "split", F.log1p("o_totalprice").alias("label"),
                    F.col("o_totalprice").alias("label_orig")))
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("prediction"))
                    for m, e in MODELS.items()])
    return base.select("o_orderkey", "split", "label", "label_orig", F.inline(arr))


def _times(spark):
    return spark.createDataFrame(list(TIMES.items()), "model string, Training_Time double")


_PRED_SQL = _TEMPORAL_SQL + """
, b AS (SELECT o_orderkey, split, ln(1 + o_totalprice) AS label, o_totalprice AS label_orig FROM sp),
pr AS (""" + " UNION ALL ".join(
    f"SELECT o_orderkey, split, label, label_orig, '{m}' AS model, {e} AS prediction FROM b"
    for m, e in MODELS.items()) + """),
tm AS (SELECT * FROM (VALUES """ + ", ".join(f"('{m}', {t})" for m, t in TIMES.items()) + """) v(model, Training_Time)),
mt AS (SELECT model, split, count(*) AS n, sqrt(sum(power(label - prediction, 2)) / count(*)) AS rmse,
              1 - sum(power(label - prediction, 2)) / NULLIF(var_pop(label) * count(*), 0) AS r2,
              avg(abs(label - prediction)) AS mae,
              avg(abs(label - prediction) / greatest(abs(label), 2.220446049250313e-16)) * 100 AS mape
       FROM pr GROUP BY model, split),
vt AS (SELECT t.model, t.rmse AS Train_RMSE, v.rmse AS Val_RMSE, t.r2 AS Train_R2, v.r2 AS Val_R2,
              t.mae AS Train_MAE, v.mae AS Val_MAE, t.mape AS Train_MAPE, v.mape AS Val_MAPE,
              v.rmse / t.rmse AS Overfit_Ratio, tm.Training_Time
       FROM mt t JOIN mt v ON t.model = v.model AND t.split = 'train' AND v.split = 'val' JOIN tm ON tm.model = t.model)
"""

_VT_COLS = ["Train_RMSE", "Val_RMSE", "Train_R2", "Val_R2", "Train_MAE", "Val_MAE", "Train_MAPE",
            "Val_MAPE", "Overfit_Ratio"]


@query("regression_metrics", "A15", oracle=_PRED_SQL + f"""
SELECT model, split, n, {sql_rnd('rmse', 6)} AS rmse, {sql_rnd('r2', 6)} AS r2, {sql_rnd('mae', 6)} AS mae,
       {sql_rnd('mape', 6)} AS mape FROM mt""")
def q_regression_metrics(spark, d):
    m = M.regression_metrics(predictions(spark, d), ["model", "split"])
    return m.select("model", "split", "n", *[rnd(c, 6).alias(c) for c in ("rmse", "r2", "mae", "mape")])


def _validation(spark, d):
    return M.validation_table(predictions(spark, d), times=_times(spark))


@query("model_ranking", "W5,A15", oracle=_PRED_SQL + """
SELECT model, """ + ", ".join(f"{sql_rnd(c, 6)} AS {c}" for c in _VT_COLS) + """, Training_Time,
       CAST(row_number() OVER (ORDER BY Val_RMSE, model) AS INTEGER) AS rank,
       rank() OVER (ORDER BY Training_Time DESC) + (count(*) OVER (PARTITION BY Training_Time) - 1) / 2.0 AS time_rank
FROM vt""")
def q_model_ranking(spark, d):
    v = _validation(spark, d)
    ranked = M.rank_models(v, "Val_RMSE", True).withColumn(
        "time_rank", M.average_rank(F.col("Training_Time"), descending=True))
    return ranked.select("model", *[rnd(c, 6).alias(c) for c in _VT_COLS], "Training_Time", "rank",
                         "time_rank")


@query("best_models", "W7,M11", oracle=_PRED_SQL + f"""
, tg AS (SELECT model, Val_RMSE, 'best_overall' AS sel FROM vt
         UNION ALL SELECT model, Val_RMSE, 'best_' || lower(CASE WHEN contains(model, 'Baseline') THEN 'Baseline'
              WHEN contains(model, 'Optimized') THEN 'Optimized' WHEN contains(model, 'Ensemble') THEN 'Ensemble' END)
              FROM vt WHERE contains(model, 'Baseline') OR contains(model, 'Optimized') OR contains(model, 'Ensemble')
         UNION ALL SELECT model, Val_RMSE, 'best_balanced' FROM vt WHERE Overfit_Ratio <= 1.2),
rk AS (SELECT *, row_number() OVER (PARTITION BY sel ORDER BY Val_RMSE, model) AS rn FROM tg)
SELECT sel AS selection, model, {sql_rnd('Val_RMSE', 6)} AS Val_RMSE FROM rk WHERE rn = 1""")
def q_best_models(spark, d):
    b = M.best_models(_validation(spark, d))
    return b.withColumn("Val_RMSE", rnd("Val_RMSE", 6))


@query("run_summary", "A17", oracle=_PRED_SQL + f"""
SELECT count(*) AS total_models, {sql_rnd('avg(Val_RMSE)', 6)} AS avg_rmse, {sql_rnd('stddev_samp(Val_RMSE)', 6)} AS std_rmse,
       {sql_rnd('avg(Val_R2)', 6)} AS avg_r2, {sql_rnd('avg(Training_Time)', 6)} AS avg_training_time,
       {sql_rnd('avg(Val_RMSE / Train_RMSE)', 6)} AS avg_overfit_ratio,
       CASE WHEN avg(Val_RMSE / Train_RMSE) BETWEEN 1.05 AND 1.2 THEN 'good' ELSE 'warning' END AS overfit_status
FROM vt""")
def q_run_summary(spark, d):
    s = M.run_summary(_validation(spark, d))
    return s.select("total_models", *[rnd(c, 6).alias(c) for c in
                                      ("avg_rmse", "std_rmse", "avg_r2", "avg_training_time",
                                       "avg_overfit_ratio")], "overfit_status")


@query("cv_scores", "A16,W4", oracle=_PRED_SQL + f"""
, fs AS (SELECT model, o_orderkey % 5 AS fold, -sqrt(sum(power(label - prediction, 2)) / count(*)) AS score
         FROM pr WHERE split = 'train' GROUP BY model, fold)
SELECT model, {sql_rnd('avg(score)', 6)} AS cv_score_mean, {sql_rnd('stddev_pop(score)', 6)} AS cv_score_std,
       count(*) AS n_folds FROM fs GROUP BY model""")
def q_cv_scores(spark, d):
    p = predictions(spark, d).where(F.col("split") == "train").withColumn("fold", F.col("o_orderkey") % 5)
    s = M.cv_scores(M.fold_metrics(p))
    return s.select("model", rnd("cv_score_mean", 6).alias("cv_score_mean"),
                    rnd("cv_score_std", 6).alias("cv_score_std"), "n_folds")


@query("test_evaluation", "M10,F5", oracle=_PRED_SQL + """
, te AS (SELECT *, exp(prediction) - 1 AS pred_orig FROM pr WHERE split = 'test')
SELECT model, """ + ", ".join(
    f"{sql_rnd(e, 4)} AS {n}" for n, e in [
        ("rmse_log", "sqrt(avg(power(label - prediction, 2)))"),
        ("r2_log", "1 - sum(power(label - prediction, 2)) / NULLIF(var_pop(label) * count(*), 0)"),
        ("mae_log", "avg(abs(label - prediction))"),
        ("rmse_orig", "sqrt(avg(power(label_orig - pred_orig, 2)))"),
        ("r2_orig", "1 - sum(power(label_orig - pred_orig, 2)) / NULLIF(var_pop(label_orig) * count(*), 0)"),
        ("mae_orig", "avg(abs(label_orig - pred_orig))")]) + """
FROM te GROUP BY model""")
def q_test_evaluation(spark, d):
    p = predictions(spark, d).where(F.col("split") == "test")
    t = M.test_evaluation(p, "model", "label", "prediction", "label_orig", 0.0)
    return t.select("model", *[rnd(c, 4).alias(c) for c in
                               ("rmse_log", "r2_log", "mae_log", "rmse_orig", "r2_orig", "mae_orig")])


@query("scale_diagnostics", "A18", oracle=_PRED_SQL + """
, cells AS (SELECT split, 'label' AS col, label AS v FROM b UNION ALL SELECT split, 'label_orig', label_orig FROM b)
SELECT split, col AS "column", 0::BIGINT AS n_non_finite, """ + sql_rnd("stddev_pop(v)", 4) + """ AS std,
       """ + sql_rnd("max(v) - min(v)", 4) + """ AS range, """ + sql_rnd("avg(v)", 4) + """ AS mean,
       stddev_pop(v) > 1e4 AS large_std, max(v) - min(v) > 1e6 AS large_range
FROM cells GROUP BY split, col""")
def q_scale_diagnostics(spark, d):
    base = _temporal(spark, d).select("split", F.log1p("o_totalprice").alias("label"),
                                      F.col("o_totalprice").alias("label_orig"))
    out = M.scale_diagnostics(base, ["label", "label_orig"])
    return out.select("split", "column", "n_non_finite", rnd("std", 4).alias("std"),
                      rnd("range", 4).alias("range"), rnd("mean", 4).alias("mean"), "large_std", "large_range")


@query("top_k_per_group", "W6", oracle="""
WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 3""")
def q_top_k_per_group(spark, d):
    from ..session import load
    counts = load(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return M.top_k(counts, ["p_type"], [F.col("n").desc(), F.col("p_brand")], 3)
