"""Registered queries for sources and the combined retrieval (S1, S2, S4, S8,
J8, W8, F3)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import relational as R
from ..session import ensure_checkpoint_dir, load, table_path
from ..sources.io import cached_step, sample_rows, step_state
from .common import rnd, sql_rnd
from .queries_columns import _TEXT_SQL, floor_input, floor_oracle, _sql_parse, _text_table
from .registry import query


@query("coerce_all_numeric", "F3,Q1", oracle=_TEXT_SQL + f"""
SELECT p_partkey, {_sql_parse('t_name')} AS t_name, {_sql_parse('t_size')} AS t_size,
       {_sql_parse('t_mixed')} AS t_mixed, {_sql_parse('t_padded')} AS t_padded FROM t""")
def q_coerce_all_numeric(spark, d):
    t = _text_table(spark, d)
    return C.NumericConversion(coerce_all=True).fit(t, exclude=["p_partkey"]).transform(t)


@query("sample_rows", "S8,W8", oracle="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10""")
def q_sample_rows(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sample_rows(o, 10, order_by=["o_orderkey"])


@query("cached_floor_features", "S1,S2,S4", oracle=floor_oracle())
def q_cached_floor_features(spark, d):
    """Floor features built once as a step output (parquet under the shared
    checkpoint directory, committed with ``_SUCCESS``) and read back."""
    from ..functions.floors import with_floor_features
    from .common import rnd
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "tessera-steps", os.path.basename(d.rstrip("/")), "floor_features.parquet")

    def build():
        out = with_floor_features(floor_input(spark, d), "floor_str")
        return out.withColumn("floor_floor_numeric_weighted", rnd("floor_floor_numeric_weighted", 6))
    return cached_step(spark, path, build, force=True)


@query("cached_step_acts", "S4", oracle="""
SELECT a.act, a.state, count(*) AS n_rows, """ + sql_rnd("sum(l_tax)", 4) + """ AS tax
FROM lineitem, (SELECT 1 AS act, 'build' AS state, 10 AS least UNION ALL SELECT 2, 'skip', 10 UNION ALL SELECT 3, 'rebuild', 20
                UNION ALL SELECT 4, 'skip', 20) AS a
WHERE l_quantity >= a.least GROUP BY a.act, a.state""")
def q_cached_step_acts(spark, d):
    """A step built, skipped, rebuilt for another setting and skipped again: its state before each act, and what it holds then."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tessera-steps", uuid.uuid4().hex)
    source, rows = table_path(d, "lineitem"), None
    for act, least in enumerate((10, 10, 20, 20), 1):
        settings = {"least": least}
        state = step_state(spark, path, [source], settings)
        held = cached_step(spark, path, lambda: spark.read.parquet(source).where(F.col("l_quantity") >= least).select("l_tax"),
                           inputs=[source], settings=settings)
        # One row of numbers for each act, taken before the next act replaces the files.
        r = held.agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_tax"), 4).alias("tax")).first()
        new = spark.createDataFrame([(act, state, r.n, r.tax)], "act int, state string, n_rows long, tax double")
        rows = new if rows is None else rows.unionByName(new)
    return rows


_RETRIEVAL_SQL = """
WITH v AS (SELECT l_partkey, l_linestatus, l_returnflag, min(l_extendedprice / l_quantity) AS vmin
           FROM lineitem GROUP BY ALL),
bad AS (SELECT l_orderkey FROM lineitem WHERE (CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END) IS NULL)
SELECT O.o_orderkey AS A_Id, O.o_totalprice AS A_Price, L.l_linenumber AS AI_Line,
       CASE WHEN L.l_partkey % 13 = 0 THEN NULL ELSE L.l_quantity END AS AI_Area,
       N.n_name AS N_Name, vn.vmin AS OV_vmin_normal, va.vmin AS OV_vmin_best
FROM orders O JOIN lineitem L ON L.l_orderkey = O.o_orderkey
  JOIN customer C ON O.o_custkey = C.c_custkey JOIN nation N ON C.c_nationkey = N.n_nationkey
  JOIN v vn ON vn.l_partkey = L.l_partkey AND vn.l_linestatus = L.l_linestatus AND vn.l_returnflag = 'N'
  LEFT JOIN v va ON va.l_partkey = L.l_partkey AND va.l_linestatus = L.l_linestatus AND va.l_returnflag = 'A'
WHERE O.o_orderstatus = O.o_orderstatus AND L.l_partkey IS NOT NULL
  AND O.o_orderkey NOT IN (SELECT l_orderkey FROM bad)
ORDER BY A_Id
"""


@query("legacy_star_retrieval", "J8,J1,J2,P2,P3,W8", oracle=_RETRIEVAL_SQL)
def q_legacy_star_retrieval(spark, d):
    """Star join + state-conditioned value join + row predicate + exclusion of
    acts with an incomplete unit, ordered by act id (the retrieval without the
    spatial parts)."""
    li = load(spark, d, "lineitem")
    area = F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("l_quantity"))
    units = li.select("l_orderkey", "l_partkey", "l_linestatus", "l_linenumber", area.alias("AI_Area"))
    values = (li.groupBy("l_partkey", "l_linestatus", "l_returnflag")
                .agg(F.min(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))).alias("vmin")))
    o = load(spark, d, "orders")
    acts = R.equal_and_present(o, "o_orderstatus", "o_orderstatus", [])
    joined = R.star_join(acts, [
        (units, F.col("l_orderkey") == F.col("o_orderkey")),
        (load(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")),
        (load(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")),
    ]).where(F.col("l_partkey").isNotNull())
    joined = R.state_conditioned_join(joined, values, ["l_partkey", "l_linestatus"], "l_returnflag",
                                      ("N", "normal"), [("A", "best")], ["vmin"])
    bad = units.where(F.col("AI_Area").isNull()).select(F.col("l_orderkey").alias("bad"))
    kept = R.exclude_groups(joined, "o_orderkey", bad, "bad")
    return kept.select(F.col("o_orderkey").alias("A_Id"), F.col("o_totalprice").alias("A_Price"),
                       F.col("l_linenumber").alias("AI_Line"), "AI_Area", F.col("n_name").alias("N_Name"),
                       "OV_vmin_normal", "OV_vmin_best").orderBy("A_Id")
