"""Registered queries for splits and folds (W1-W4, A9, V1, V5) on ``orders``:
month key = year*12 + month of ``o_orderdate``, tie-break ``o_orderkey``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from ..session import load
from .common import rnd, sql_rnd
from .registry import query

TEST, VAL, K = 0.1, 0.22, 5


def _orders(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("yr"),
                    F.month("o_orderdate").alias("mo"))


def _order_expr():
    # A portable seeded permutation of the key (same arithmetic in the oracle).
    return F.pmod(F.col("o_orderkey") * 48271 + 42, F.lit(2147483647))


_TEMPORAL_SQL = f"""
WITH t AS (SELECT o_orderkey, o_totalprice, year(o_orderdate) AS yr, month(o_orderdate) AS mo,
                  year(o_orderdate) * 12 + month(o_orderdate) AS k FROM orders),
p AS (SELECT *, row_number() OVER (ORDER BY k, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM t),
s AS (SELECT *, CAST(trunc(n * (1 - CAST({TEST} AS DOUBLE))) AS BIGINT) AS test_idx FROM p),
s2 AS (SELECT *, CAST(trunc(test_idx * (1 - CAST({VAL} AS DOUBLE))) AS BIGINT) AS val_idx FROM s),
sp AS (SELECT *, CASE WHEN pos < val_idx THEN 'train' WHEN pos < test_idx THEN 'val' ELSE 'test' END AS split FROM s2)
"""


def _temporal(spark, d):
    return S.temporal_split(_orders(spark, d), "yr", "mo", "o_orderkey", TEST, VAL)


@query("temporal_split", "W1,W2", oracle=_TEMPORAL_SQL + "SELECT o_orderkey, split FROM sp")
def q_temporal_split(spark, d):
    return _temporal(spark, d).select("o_orderkey", "split")


_RANDOM_SQL = """
WITH t AS (SELECT o_orderkey, (o_orderkey * 48271 + 42) % 2147483647 AS r FROM orders),
p AS (SELECT *, row_number() OVER (ORDER BY r, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM t),
s AS (SELECT *, CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) AS n_test FROM p),
s2 AS (SELECT *, CAST(ceil(CAST(0.2 AS DOUBLE) / (1 - CAST(0.1 AS DOUBLE)) * (n - n_test)) AS BIGINT) AS n_val FROM s)
"""


@query("random_split", "W3", oracle=_RANDOM_SQL + """
SELECT o_orderkey, CASE WHEN pos < n_test THEN 'test' WHEN pos < n_test + n_val THEN 'val' ELSE 'train' END AS split
FROM s2""")
def q_random_split(spark, d):
    out = S.random_split(_orders(spark, d), "o_orderkey", 42, 0.1, 0.2, order=_order_expr())
    return out.select("o_orderkey", "split")


@query("kfold_assignment", "W4", oracle=f"""
WITH t AS (SELECT o_orderkey, (o_orderkey * 48271 + 42) % 2147483647 AS r FROM orders),
p AS (SELECT *, row_number() OVER (ORDER BY r, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM t),
q AS (SELECT *, n // {K} AS base, n % {K} AS extra FROM p)
SELECT o_orderkey, CAST(CASE WHEN pos < (base + 1) * extra THEN pos // (base + 1)
                             ELSE extra + (pos - (base + 1) * extra) // base END AS INTEGER) AS fold
FROM q""")
def q_kfold(spark, d):
    return S.kfold(_orders(spark, d), "o_orderkey", K, order=_order_expr()).select("o_orderkey", "fold")


@query("timeseries_folds", "W4", oracle=_TEMPORAL_SQL + f"""
, b AS (SELECT *, n // {K + 1} AS step FROM p)
SELECT o_orderkey, CAST(""" + " + ".join(
    f"CASE WHEN pos >= n - {K - i} * step THEN 1 ELSE 0 END" for i in range(K)) + """ AS INTEGER) AS block
FROM b""")
def q_timeseries_folds(spark, d):
    o = _orders(spark, d).withColumn("k", S.temporal_key("yr", "mo"))
    return S.timeseries_blocks(o, ["k", "o_orderkey"], K).select("o_orderkey", "block")


@query("split_moments", "A9", oracle=_TEMPORAL_SQL + f"""
SELECT split, count(o_totalprice) AS n, {sql_rnd('avg(o_totalprice)', 4)} AS mean,
       {sql_rnd('stddev_samp(o_totalprice)', 4)} AS std, min(o_totalprice) AS min, max(o_totalprice) AS max
FROM sp GROUP BY split""")
def q_split_moments(spark, d):
    m = S.split_moments(_temporal(spark, d), "o_totalprice")
    return m.withColumn("mean", rnd("mean", 4)).withColumn("std", rnd("std", 4))


@query("split_drift", "A9", oracle=_TEMPORAL_SQL + f"""
, m AS (SELECT avg(o_totalprice) FILTER (WHERE split = 'train') AS tr,
               avg(o_totalprice) FILTER (WHERE split = 'val') AS va,
               avg(o_totalprice) FILTER (WHERE split = 'test') AS te FROM sp)
SELECT {sql_rnd('tr', 4)} AS mean_train, {sql_rnd('va', 4)} AS mean_val, {sql_rnd('te', 4)} AS mean_test,
       {sql_rnd('greatest(abs(va - tr), abs(te - tr)) / tr', 6)} AS drift FROM m""")
def q_split_drift(spark, d):
    out = S.drift_df(_temporal(spark, d), "o_totalprice")
    return out.select(*[rnd(c, 4).alias(c) for c in ["mean_train", "mean_val", "mean_test"]],
                      rnd("drift", 6).alias("drift"))


@query("temporal_validity", "V1", oracle=_TEMPORAL_SQL + """
, g AS (SELECT min(k) FILTER (WHERE split = 'val') - max(k) FILTER (WHERE split = 'train') AS gv,
               min(k) FILTER (WHERE split = 'test') - max(k) FILTER (WHERE split = 'val') AS gt FROM sp)
SELECT gv AS gap_train_val, gt AS gap_val_test, (gv >= 1 AND gt >= 1) AS valid FROM g""")
def q_temporal_validity(spark, d):
    key = F.col("yr").cast("long") * 12 + F.col("mo").cast("long")
    return S.temporal_validity_df(_temporal(spark, d), key, 1)


@query("target_agreement", "V5,F7", oracle="""
SELECT count(*) FILTER (WHERE abs(o_totalprice - (exp(ln(1 + o_totalprice)) - 1))
                         > 1e-8 + 1e-5 * abs(exp(ln(1 + o_totalprice)) - 1)) = 0 AS all_close
FROM orders""")
def q_target_agreement(spark, d):
    o = load(spark, d, "orders").select(
        "o_totalprice", F.log1p("o_totalprice").alias("price_log"))
    from ..functions.target import original_target
    rec = o.withColumn("recovered", original_target(o.columns, "price_log"))
    return rec.agg(S.allclose(rec, "o_totalprice", "recovered").alias("all_close"))
