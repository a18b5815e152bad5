"""Registered end-to-end flows: preparation (C11) and training.

Input: one row per order with line aggregates (Spark aggregation of the whole
``lineitem``), customer segment (5 levels → one-hot), nation as text
(25 → target encoding), customer key as text (label encoding), a text
number column (numeric conversion), blanks and a constant column for the
cleaning steps.  Target: ``o_totalprice``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from .preprocessing import PrepConfig, prepare
from .registry import query
from .training import TrainConfig, train_and_evaluate


def raw_dataset(spark, d):
    li = load(spark, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("total_qty"),
        F.avg("l_discount").alias("avg_disc"), F.sum("l_extendedprice").alias("gross"))
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    o = load(spark, d, "orders")
    return (o.join(lines, o.o_orderkey == lines.l_orderkey).join(c, o.o_custkey == c.c_custkey)
             .select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("yr"),
                     F.month("o_orderdate").alias("mo"), "n_lines", "total_qty", "avg_disc", "gross",
                     "c_acctbal", "c_mktsegment", "o_orderpriority",
                     F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"),
                     F.col("o_custkey").cast("string").alias("cust_code"),
                     F.when(F.col("o_orderkey") % 10 == 0, F.lit(""))
                      .otherwise(F.col("n_lines").cast("string")).alias("lines_txt"),
                     F.lit("const").alias("constant_col"),
                     (F.col("gross") * 2.0).alias("gross_twice")))


def _config():
    return PrepConfig(target="o_totalprice", row_id="o_orderkey", year_col="yr", month_col="mo",
                      columns_to_remove=["gross_twice_missing"], test_size=0.1, val_size=0.22)


@query("prepared_dataset", "C11,C1,C4,C6,C7,C8,C5,W2,F4,O4,C9")
def q_prepared_dataset(spark, d):
    """The whole preparation flow on the order table; one table with a split column."""
    out, _ = prepare(raw_dataset(spark, d), _config())
    return out


@query("training_report", "M12,M6,M7,M8,M9,M10,W7,A17,E1")
def q_training_report(spark, d):
    """Preparation then training: validation table of the baselines, searched
    random forest / boosted trees (1 trial each, 2 folds, small space) and voting /
    stacking ensembles, ranked.  Baseline cross-validation is skipped here; it
    has its own query (``baseline_cv``)."""
    prepared, info = prepare(raw_dataset(spark, d), _config())
    feats = [c for c, t in prepared.dtypes if t in ("double", "int", "bigint", "boolean")
             and c not in ("o_orderkey", "o_totalprice", "o_totalprice_original")]
    prepared = prepared.select("o_orderkey", "split", "o_totalprice", "o_totalprice_original",
                               *[F.col(c).cast("double").alias(c) for c in feats])
    small = {"RandomForest": {"numTrees": ("int", 10, 30, 10), "maxDepth": ("int", 4, 8, 1)},
             "GradientBoosting": {"maxIter": ("int", 5, 15, 5), "maxDepth": ("int", 3, 5, 1)}}
    cfg = TrainConfig(features=feats, label="o_totalprice", label_original="o_totalprice_original",
                      row_id="o_orderkey", cv_folds=2, n_trials=1, spaces=small, baseline_cv=False,
                      log_shift=info.get("log_target", {}).get("shift", 0.0))
    res = train_and_evaluate(prepared, cfg)
    return res["validation"].join(res["ranking"].select("model", "rank"), "model")
