"""Registered queries for models, k-NN and importance.

Training table: per order, aggregates of its lines (a Spark aggregation over
the whole ``lineitem``) joined to ``orders``; label = log1p(o_totalprice);
temporal split by order month.  Iterative fits have no SQL equivalent and
are checked rows-only here and against brute force / closed forms in tests;
OLS on one feature and k-NN have SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import importance as I
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import splits as S
from ..operators.knn import knn_regress
from ..session import kept, load
from .common import rnd, sql_rnd
from .registry import query

FEATS = ["n_lines", "total_qty", "avg_disc", "avg_tax", "gross_k", "mo"]
LINEAR = ["Baseline_LinearRegression", "Baseline_Ridge", "Baseline_Lasso", "Baseline_ElasticNet"]


def training_table(spark, d):
    li = load(spark, d, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("total_qty"),
        F.avg("l_discount").alias("avg_disc"), F.avg("l_tax").alias("avg_tax"),
        (F.sum("l_extendedprice") / 1000.0).alias("gross_k"))
    o = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.log1p("o_totalprice").alias("label"),
        F.year("o_orderdate").alias("yr"), F.month("o_orderdate").cast("double").alias("mo"))
    # The split looks at the rows several times before they are read for the fits.
    t = o.join(per_order, o.row_id == per_order.l_orderkey).drop("l_orderkey")
    return S.temporal_split(kept(t), "yr", "mo", "row_id", 0.1, 0.22)


def _data(spark, d):
    # Several fits read it: cache once instead of replaying the join and split.
    return ML.spread(ML.assemble(training_table(spark, d), FEATS))


def _fit_baselines(spark, d, data=None):
    data = data if data is not None else _data(spark, d)
    train = data.where(F.col("split") == "train")
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    est = ML.baseline_estimators(st["n"], st["s"] or 0.0, "label")
    return data, ML.fit_all(est, train)


def _metrics(pred):
    m = M.regression_metrics(pred, ["model", "split"])
    return m.select("model", "split", "n", *[rnd(c, 6).alias(c) for c in ("rmse", "r2", "mae", "mape")])


_TRAIN_SQL = """
WITH lo AS (SELECT l_orderkey, sum(l_quantity) AS total_qty FROM lineitem GROUP BY l_orderkey),
t AS (SELECT o.o_orderkey, ln(1 + o.o_totalprice) AS label, year(o.o_orderdate) * 12 + month(o.o_orderdate) AS k,
             lo.total_qty FROM orders o JOIN lo ON lo.l_orderkey = o.o_orderkey),
p AS (SELECT *, row_number() OVER (ORDER BY k, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM t),
s AS (SELECT *, CAST(trunc(CAST(trunc(n * (1 - CAST(0.1 AS DOUBLE))) AS BIGINT) * (1 - CAST(0.22 AS DOUBLE))) AS BIGINT) AS val_idx FROM p)
"""


@query("ols_coefficients", "M1", oracle=_TRAIN_SQL + f"""
SELECT {sql_rnd('regr_slope(label, total_qty)', 6)} AS slope, {sql_rnd('regr_intercept(label, total_qty)', 6)} AS intercept
FROM s WHERE pos < val_idx""")
def q_ols_coefficients(spark, d):
    from pyspark.ml.regression import LinearRegression
    data = ML.assemble(training_table(spark, d), ["total_qty"])
    m = LinearRegression(featuresCol=ML.FEATURES, labelCol="label", regParam=0.0,
                         standardization=False, solver="normal").fit(data.where(F.col("split") == "train"))
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))],
                                 "slope double, intercept double").select(
        rnd("slope", 6).alias("slope"), rnd("intercept", 6).alias("intercept"))


@query("linear_models", "M1,M8,A15")
def q_linear_models(spark, d):
    """OLS, Ridge, Lasso and ElasticNet fitted on train; metrics per split."""
    data, fitted = _fit_baselines(spark, d)
    lin = {k: v for k, v in fitted.items() if k in LINEAR}
    return _metrics(ML.predict_long(lin, data, "row_id", "label"))


@query("tree_models", "M2,M4,M8")
def q_tree_models(spark, d):
    """Decision tree (depth 12) and a 30-tree random forest; metrics per split."""
    data = _data(spark, d)
    train = data.where(F.col("split") == "train")
    est = {"Baseline_DecisionTree": ML.make_estimator("DecisionTree", {"maxDepth": 12}, "label"),
           "Optimized_RandomForest": ML.make_estimator(
               "RandomForest", {"numTrees": 30, "maxDepth": 10, "featureSubsetStrategy": "sqrt"}, "label")}
    return _metrics(ML.predict_long(ML.fit_all(est, train), data, "row_id", "label"))


@query("boosted_trees", "M5,M8")
def q_boosted_trees(spark, d):
    """Gradient-boosted trees (30 rounds, depth 5, step 0.1, subsample 0.8); metrics per split."""
    data = _data(spark, d)
    est = {"Optimized_GradientBoosting": ML.make_estimator(
        "GradientBoosting", {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8}, "label")}
    return _metrics(ML.predict_long(ML.fit_all(est, data.where(F.col("split") == "train")),
                                    data, "row_id", "label"))


# Search space of the registered search (bounded for a quick check; the
# library default is the full space in ``SEARCH_SPACES``).
_SMALL_RF = {"numTrees": ("int", 10, 40, 10), "maxDepth": ("int", 4, 8, 1),
             "minInstancesPerNode": ("int", 1, 10, 1),
             "featureSubsetStrategy": ("choice", ["sqrt", "log2", "all"])}


@query("hyperparameter_search", "M6,W4,A16")
def q_hyperparameter_search(spark, d):
    """Seeded random search (3 trials) with 3-fold CV on the training rows."""
    data = _data(spark, d).where(F.col("split") == "train")
    data = S.kfold(data, "row_id", 3, seed=42).cache()
    res = ML.random_search("RandomForest", data, "label", "fold", [0, 1, 2], n_trials=3,
                           space=_SMALL_RF)
    rows = [(i, str(sorted(p.items())), m, s) for i, (p, m, s) in enumerate(res.trials)]
    return spark.createDataFrame(rows, "trial int, params string, cv_score_mean double, cv_score_std double")


@query("baseline_cv", "M7,A16,W4")
def q_baseline_cv(spark, d):
    """Baseline models, 5-fold CV (negative RMSE) on the training rows."""
    data = _data(spark, d).where(F.col("split") == "train")
    data = S.kfold(data, "row_id", 5, seed=42).cache()
    st = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    rows = []
    for name, est in ML.baseline_estimators(st["n"], st["s"] or 0.0, "label").items():
        for f, sc in enumerate(ML.cv_score(est, data, "label", "fold", range(5))):
            rows.append((name, f, sc))
    scores = spark.createDataFrame(rows, "model string, fold int, score double")
    return M.cv_scores(scores)


@query("ensembles", "M9,M8")
def q_ensembles(spark, d):
    """Voting (mean of OLS, tree, GBT) and stacking (5-fold OOF → ridge); metrics per split."""
    data = _data(spark, d)
    train = data.where(F.col("split") == "train")
    est = {"Baseline_LinearRegression": ML.baseline_estimators(1, 0.0, "label")["Baseline_LinearRegression"],
           "Baseline_DecisionTree": ML.make_estimator("DecisionTree", {"maxDepth": 8}, "label"),
           "Optimized_GradientBoosting": ML.make_estimator("GradientBoosting", {"maxIter": 15, "maxDepth": 4},
                                                           "label")}
    fitted = ML.fit_all(est, train)
    members = ML.predict_long(fitted, data, "row_id", "label")
    vote = ML.voting(members, list(est))
    folded = data.withColumn("fold", F.pmod(F.xxhash64("row_id"), F.lit(5)))
    stack = ML.stacking(est, folded, "row_id", "label", "fold", list(range(5)))
    return _metrics(vote.unionByName(stack).select("row_id", "split", "label", "prediction", "model"))


@query("knn_regress", "J9,M3", oracle="""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS DOUBLE) AS y,
                  (vec_id * 48271 + 42) % 2147483647 AS r FROM embeddings),
p AS (SELECT *, row_number() OVER (ORDER BY r, vec_id) - 1 AS pos, count(*) OVER () AS n FROM e),
s AS (SELECT *, pos < CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS is_test FROM p),
d AS (SELECT q.vec_id, t.y, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rn
      FROM s q JOIN s t ON q.is_test AND NOT t.is_test)
SELECT vec_id, avg(y) AS prediction, count(*) AS k_found FROM d WHERE rn <= 5 GROUP BY vec_id""")
def q_knn_regress(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding", "label")
    order = F.pmod(F.col("vec_id") * 48271 + 42, F.lit(2147483647))
    sp = S.random_split(e, "vec_id", 42, 0.2, 0.0, order=order)
    train, test = sp.where(F.col("split") != "test"), sp.where(F.col("split") == "test")
    return knn_regress(train, test, "vec_id", "embedding", "label", k=5)


def _ols_model(spark, d):
    data = _data(spark, d)
    return data, ML.baseline_estimators(1, 0.0, "label")["Baseline_LinearRegression"].fit(
        data.where(F.col("split") == "train"))


@query("feature_importance", "E1,W5")
def q_feature_importance(spark, d):
    """Normalised |coefficients| (OLS) and tree importances (decision tree) with ranks."""
    data, ols = _ols_model(spark, d)
    tree = ML.make_estimator("DecisionTree", {"maxDepth": 8}, "label").fit(data.where(F.col("split") == "train"))
    return I.basic_importance(ols, FEATS, "Baseline_LinearRegression", spark).unionByName(
        I.basic_importance(tree, FEATS, "Baseline_DecisionTree", spark))


@query("permutation_importance", "E3")
def q_permutation_importance(spark, d):
    """MSE increase when each feature is shuffled (10 seeded repeats) on the test rows."""
    data, ols = _ols_model(spark, d)
    test = data.where(F.col("split") == "test")
    return I.permutation_importance(ols, test, FEATS, "row_id", "label", n_repeats=10,
                                    name="Baseline_LinearRegression")


@query("linear_shap", "E4")
def q_linear_shap(spark, d):
    """Exact linear Shapley importance of the OLS model over the test rows (train means)."""
    data, ols = _ols_model(spark, d)
    return I.linear_shap(ols, data.where(F.col("split") == "test"), FEATS, "Baseline_LinearRegression",
                         background=data.where(F.col("split") == "train"))


@query("importance_compare", "E5,W5")
def q_importance_compare(spark, d):
    """Basic + linear SHAP + permutation importance of OLS joined, averaged and ranked."""
    data, ols = _ols_model(spark, d)
    test = data.where(F.col("split") == "test")
    basic = I.basic_importance(ols, FEATS, "ols", spark)
    shap = I.linear_shap(ols, test, FEATS, "ols", background=data.where(F.col("split") == "train"))
    perm = I.permutation_importance(ols, test, FEATS, "row_id", "label", name="ols")
    return I.compare_methods(basic, shap, perm)


@query("global_importance", "D4,A19,E2")
def q_global_importance(spark, d):
    """Importance of OLS and a tree, their voting ensemble (mean of members),
    side by side (0 for missing) and the mean per feature."""
    data, ols = _ols_model(spark, d)
    tree = ML.make_estimator("DecisionTree", {"maxDepth": 8}, "label").fit(data.where(F.col("split") == "train"))
    members = I.basic_importance(ols, FEATS, "ols", spark).unionByName(
        I.basic_importance(tree, FEATS, "tree", spark))
    voting = I.ensemble_importance(members.select("model", "feature", "importance"), "voting")
    per = members.select("model", "feature", "importance").unionByName(
        voting.select("model", "feature", "importance"))
    return I.global_importance(per)


@query("sampled_shap", "E4")
def q_sampled_shap(spark, d):
    """Monte-Carlo Shapley importance of a depth-8 decision tree over all test
    rows, against a background of 100 of them, 20 permutations."""
    data = _data(spark, d)
    tree = ML.make_estimator("DecisionTree", {"maxDepth": 8}, "label").fit(data.where(F.col("split") == "train"))
    return I.sampled_shap(tree, data.where(F.col("split") == "test"), FEATS, "row_id",
                          "Baseline_DecisionTree", n_background=100, n_samples=20)


@query("timeseries_cv", "W4,M7,A16")
def q_timeseries_cv(spark, d):
    """Expanding-window CV (5 folds, month order) of all baselines on the
    training rows: fold i trains on all blocks before its test block."""
    data = _data(spark, d).where(F.col("split") == "train").withColumn(
        "k", S.temporal_key("yr", "mo"))
    blocks = S.timeseries_blocks(data, ["k", "row_id"], 5).cache()
    st = blocks.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    est = ML.baseline_estimators(st["n"], st["s"] or 0.0, "label")
    tb = {i: (F.col("block") <= i, F.col("block") == i + 1) for i in range(5)}
    rows = [(name, f, sc) for name, e in est.items()
            for f, sc in enumerate(ML.cv_score(e, blocks, "label", "block", range(5), tb))]
    return M.cv_scores(spark.createDataFrame(rows, "model string, fold int, score double"))
