"""Training and evaluation flows over a prepared table.

Baseline CV → random search per tree family → refit with the best
parameters (seed kept, Q20) → voting and stacking ensembles → long
predictions on every split → validation table, ranking, best models, run
summary, test metrics on both scales and importance.  Each step is a set of
distributed Spark ML fits or ``groupBy`` aggregations over the predictions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import importance as I
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import splits as S
from ..session import kept


@dataclass
class TrainConfig:
    features: list
    label: str = "target"
    label_original: str | None = None
    row_id: str = "row_id"
    cv_folds: int = 5
    n_trials: int = 10
    families: list = field(default_factory=lambda: ["RandomForest", "GradientBoosting"])
    spaces: dict = field(default_factory=dict)
    seed: int = 42
    ensemble_size: int = 5
    log_shift: float = 0.0
    baseline_cv: bool = True


def train_and_evaluate(prepared: DataFrame, cfg: TrainConfig) -> dict:
    spark = prepared.sparkSession
    data = ML.spread(ML.assemble(prepared, cfg.features))
    train = kept(S.kfold(data.where(F.col("split") == "train"), cfg.row_id, cfg.cv_folds, cfg.seed))
    folds = list(range(cfg.cv_folds))
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(cfg.label).alias("s")).first()
    baselines = ML.baseline_estimators(st["n"], st["s"] or 0.0, cfg.label, cfg.seed)
    # M7: baseline CV scores
    cv = None
    if cfg.baseline_cv:
        rows = [(name, f, sc) for name, est in baselines.items()
                for f, sc in enumerate(ML.cv_score(est, train, cfg.label, "fold", folds))]
        cv = M.cv_scores(spark.createDataFrame(rows, "model string, fold int, score double"))
    # M6: search, then rebuild with the best parameters
    searches, optimized = {}, {}
    for fam in cfg.families:
        res = ML.random_search(fam, train, cfg.label, "fold", folds, cfg.n_trials, cfg.seed,
                               space=cfg.spaces.get(fam))
        searches[fam] = res
        optimized[f"Optimized_{fam}"] = ML.make_estimator(fam, res.best_params, cfg.label, cfg.seed)
    # Q18: ensemble members are the best optimized models by CV score
    ranked = sorted(optimized, key=lambda k: -searches[k.split("_", 1)[1]].best_score)
    members = {k: optimized[k] for k in ranked[:cfg.ensemble_size]}
    fitted = ML.fit_all({**baselines, **optimized}, train)
    pred = kept(ML.predict_long(fitted, data, cfg.row_id, cfg.label))
    if len(members) >= 2:
        pred = pred.unionByName(ML.voting(pred, list(members), row_id=cfg.row_id))
        pred = pred.unionByName(ML.stacking(members, data.join(train.select(cfg.row_id, "fold"),
                                                               cfg.row_id, "left"),
                                            cfg.row_id, cfg.label, "fold", folds,
                                            fitted={k: fitted[k] for k in members})
                                .select(*pred.columns))
    validation = M.validation_table(pred)
    out = {
        "cv_scores": cv,
        "search": {k: v.trials for k, v in searches.items()},
        "predictions": pred,
        "validation": validation,
        "ranking": M.rank_models(validation),
        "best": M.best_models(validation),
        "summary": M.run_summary(validation.withColumn("Training_Time", F.lit(None).cast("double"))),
    }
    if cfg.label_original:
        test = pred.where(F.col("split") == "test").join(
            prepared.select(cfg.row_id, F.col(cfg.label_original).alias("label_orig")), cfg.row_id)
        out["test"] = M.test_evaluation(test, shift=cfg.log_shift)
    imp = None
    for name, model in fitted.items():
        if hasattr(model, "featureImportances") or hasattr(model, "coefficients"):
            part = I.basic_importance(model, cfg.features, name, spark)
            imp = part if imp is None else imp.unionByName(part)
    if imp is not None:
        if len(members) >= 2:  # E2: the voting ensemble's importance = mean of its members
            ens = I.ensemble_importance(imp.where(F.col("model").isin(*members))
                                           .select("model", "feature", "importance"), "Ensemble_Voting")
            imp = imp.select("model", "feature", "importance").unionByName(
                ens.select("model", "feature", "importance"))
        out["importance"] = imp
        out["global_importance"] = I.global_importance(imp)
    return out
