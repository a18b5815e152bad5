"""Registered queries for quality checks (V2, V3/A8, V4) on ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import splits as S
from ..session import load
from .common import rnd, sql_rnd
from .queries_splits import _TEMPORAL_SQL, _temporal
from .registry import query

_LEAK_FEATS = ["o_custkey", "yr", "mo", "o_totalprice_prev", "scaled_price"]


def _leak_input(spark, d):
    o = load(spark, d, "orders")
    return o.select(
        "o_totalprice", "o_custkey", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"),
        F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.col("o_custkey") * 3.0).alias("o_totalprice_prev"),
        (F.col("o_totalprice") / 1000.0 + (F.col("o_orderkey") % 3).cast("double")).alias("scaled_price"))


_LEAK_SQL = """
WITH t AS (SELECT o_totalprice, o_custkey, year(o_orderdate) AS yr, month(o_orderdate) AS mo,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey * 3.0 END AS o_totalprice_prev,
  o_totalprice / 1000.0 + CAST(o_orderkey % 3 AS DOUBLE) AS scaled_price FROM orders),
c AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, covar_pop(coalesce({c}, 0), o_totalprice) / "
    f"NULLIF(stddev_pop(coalesce({c}, 0)) * stddev_pop(o_totalprice), 0) AS r FROM t"
    for c in _LEAK_FEATS) + ")"


@query("target_leakage", "V2,A14", oracle=_LEAK_SQL + f"""
SELECT feature, {sql_rnd('r', 6)} AS correlation,
  CASE WHEN contains(lower(feature), 'o_totalprice') THEN 'name contains target'
       WHEN abs(r) > 0.95 THEN 'high correlation' END AS reason,
  contains(lower(feature), 'o_totalprice') OR coalesce(abs(r) > 0.95, false) AS suspicious FROM c""")
def q_target_leakage(spark, d):
    out = Q.target_leakage(_leak_input(spark, d), "o_totalprice", _LEAK_FEATS, 0.95)
    return out.withColumn("correlation", rnd("correlation", 6))


_DRIFT_COLS = ["o_orderpriority", "o_orderstatus"]
_DRIFT_SQL = _TEMPORAL_SQL + """
, sp2 AS (SELECT sp.*, o.o_orderpriority, o.o_orderstatus FROM sp JOIN orders o USING (o_orderkey)),
cells AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS value, split FROM sp2" for c in _DRIFT_COLS) + """),
cnt AS (SELECT col, value, split, count(*) AS n FROM cells GROUP BY ALL),
tot AS (SELECT col, split, count(*) AS t FROM cells GROUP BY ALL),
cats AS (SELECT DISTINCT col, value FROM cells),
sh AS (SELECT cats.col, cats.value,
         coalesce((SELECT n FROM cnt WHERE cnt.col = cats.col AND cnt.value = cats.value AND split = 'train') /
                  (SELECT t FROM tot WHERE tot.col = cats.col AND split = 'train'), 0) AS tr,
         coalesce((SELECT n FROM cnt WHERE cnt.col = cats.col AND cnt.value = cats.value AND split = 'val') /
                  (SELECT t FROM tot WHERE tot.col = cats.col AND split = 'val'), 0) AS va,
         coalesce((SELECT n FROM cnt WHERE cnt.col = cats.col AND cnt.value = cats.value AND split = 'test') /
                  (SELECT t FROM tot WHERE tot.col = cats.col AND split = 'test'), 0) AS te FROM cats),
dr AS (SELECT col, max(abs(tr - va)) AS tv, max(abs(tr - te)) AS tt, max(abs(va - te)) AS vt FROM sh GROUP BY col)
"""


def _drift_input(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return _temporal(spark, d).join(o, "o_orderkey")


@query("category_drift", "V3,A8,D3", oracle=_DRIFT_SQL + f"""
SELECT col AS "column", {sql_rnd('tv', 6)} AS train_val_drift, {sql_rnd('tt', 6)} AS train_test_drift,
       {sql_rnd('vt', 6)} AS val_test_drift, {sql_rnd('greatest(tv, tt, vt)', 6)} AS max_drift,
       greatest(tv, tt, vt) > 0.05 AS drifted FROM dr""")
def q_category_drift(spark, d):
    out = Q.category_drift(_drift_input(spark, d), _DRIFT_COLS)
    return out.select("column", *[rnd(c, 6).alias(c) for c in
                                  ["train_val_drift", "train_test_drift", "val_test_drift", "max_drift"]],
                      "drifted")


@query("category_shares", "A8,D3", oracle=_DRIFT_SQL + f"""
SELECT col AS "column", value, {sql_rnd('tr', 6)} AS train, {sql_rnd('va', 6)} AS val, {sql_rnd('te', 6)} AS test FROM sh""")
def q_category_shares(spark, d):
    out = Q.category_shares(_drift_input(spark, d), _DRIFT_COLS)
    return out.select("column", "value", *[rnd(c, 6).alias(c) for c in ["train", "val", "test"]])


@query("quality_rollup", "V4,V1,V2,V3", oracle=_DRIFT_SQL + """
, g AS (SELECT min(k) FILTER (WHERE split = 'val') - max(k) FILTER (WHERE split = 'train') AS gv,
               min(k) FILTER (WHERE split = 'test') - max(k) FILTER (WHERE split = 'val') AS gt FROM sp)
""" + _LEAK_SQL.replace("WITH t AS", ", lt AS").replace("FROM t", "FROM lt").replace("\nc AS (", "\nlc AS (") + """
, lk AS (SELECT bool_or(contains(lower(feature), 'o_totalprice') OR coalesce(abs(r) > 0.95, false)) AS leak FROM lc),
dv AS (SELECT NOT bool_or(greatest(tv, tt, vt) > 0.05) AS ok FROM dr)
SELECT (gv >= 1 AND gt >= 1) AS temporal_valid, lk.leak AS leakage_detected, dv.ok AS drift_valid,
       (gv >= 1 AND gt >= 1) AND dv.ok AND NOT lk.leak AS all_valid FROM g, lk, dv""")
def q_quality_rollup(spark, d):
    split = _drift_input(spark, d)
    key = F.col("yr").cast("long") * 12 + F.col("mo").cast("long")
    checks = {
        "temporal": S.temporal_validity_df(split, key, 1),
        "leakage": Q.target_leakage(_leak_input(spark, d), "o_totalprice", _LEAK_FEATS, 0.95),
        "drift": Q.category_drift(split, _DRIFT_COLS),
    }
    return Q.quality_rollup(spark, checks)
