"""Registered queries for encoding, imputation, scaling and PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoding as E
from ..operators import splits as S
from ..operators.scaling import PCAReduction, StandardScaling
from ..session import load
from .common import rnd, sql_rnd
from .queries_splits import _TEMPORAL_SQL, _orders
from .registry import query

# --------------------------------------------------------------------------- C6
_ROUTE_COLS = ["p_name", "p_brand", "p_type", "code", "size_txt"]


def _route_input(spark, d):
    p = load(spark, d, "part")
    return p.select("p_name", "p_brand", "p_type", F.col("p_partkey").cast("string").alias("code"),
                    F.col("p_size").cast("string").alias("size_txt"))


@query("cardinality_routing", "C6", oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {e}) AS n_unique, "
    f"CASE WHEN count(DISTINCT {e}) < 10 THEN 'one_hot' WHEN count(DISTINCT {e}) < 100 THEN 'target' "
    f"ELSE 'label' END AS method FROM part"
    for c, e in [("p_name", "p_name"), ("p_brand", "p_brand"), ("p_type", "p_type"),
                 ("code", "CAST(p_partkey AS VARCHAR)"), ("size_txt", "CAST(p_size AS VARCHAR)")]))
def q_cardinality_routing(spark, d):
    return E.cardinality_routing(_route_input(spark, d), _ROUTE_COLS)


@query("cardinality_classes", "C6", oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS column, CASE WHEN count(DISTINCT {e}) < 10 THEN 'one_hot' WHEN count(DISTINCT {e}) < 100 THEN 'target' "
    f"ELSE 'label' END AS method FROM part"
    for c, e in [("p_name", "p_name"), ("p_brand", "p_brand"), ("p_type", "p_type"),
                 ("code", "CAST(p_partkey AS VARCHAR)"), ("size_txt", "CAST(p_size AS VARCHAR)")]))
def q_cardinality_classes(spark, d):
    """Routes by sketch, with exact counts near the limits only."""
    return spark.createDataFrame(list(E.cardinality_classes(_route_input(spark, d), _ROUTE_COLS).items()), "column string, method string")


# --------------------------------------------------------------------------- C6a
# Order priorities of the driver's orders table (oracle only; the
# Spark side finds the levels itself).
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _prio(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, None)
                    .otherwise(F.col("o_orderpriority")).alias("prio"))


@query("one_hot", "C6a", oracle="SELECT o_orderkey, " + ", ".join(
    f"coalesce(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END = '{lv}', false) AS \"prio_{lv}\""
    for lv in _PRIORITIES[1:]) + " FROM orders")
def q_one_hot(spark, d):
    df = _prio(spark, d)
    return E.OneHot().fit(df, ["prio"]).transform(df)


# --------------------------------------------------------------------------- C6b
@query("label_encode", "C6b", oracle="""
WITH t AS (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_name END, 'nan') AS v FROM part),
lv AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM t))
SELECT t.p_partkey, lv.code AS name_code FROM t JOIN lv USING (v)""")
def q_label_encode(spark, d):
    p = load(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 6 == 0, None).otherwise(F.col("p_name")).alias("name_code"))
    return E.LabelEncoding().fit(p, ["name_code"]).transform(p)


# --------------------------------------------------------------------------- C7
def _brand(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 13 == 0, None)
                    .otherwise(F.col("p_brand")).alias("brand"), "p_retailprice")


_TE_SQL = """
WITH t AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS brand,
                  p_retailprice AS y FROM part),
g AS (SELECT avg(y) AS gm, var_pop(y) AS gv FROM t),
c AS (SELECT brand, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM t GROUP BY brand),
a AS (SELECT p_partkey, CASE WHEN p_size > 48 THEN 'Brand#new' ELSE brand END AS brand FROM t)
"""


@query("target_encode_transform", "C7", oracle=_TE_SQL + f"""
SELECT a.p_partkey, a.brand,
       {sql_rnd('coalesce(CASE WHEN c.n > 0 THEN coalesce(g.gv * c.n / NULLIF(g.gv * c.n + c.v, 0), 1) * c.m + (1 - coalesce(g.gv * c.n / NULLIF(g.gv * c.n + c.v, 0), 1)) * g.gm END, g.gm)', 4)} AS brand_te
FROM a CROSS JOIN g LEFT JOIN c ON a.brand IS NOT DISTINCT FROM c.brand""")
def q_target_encode_transform(spark, d):
    t = _brand(spark, d)
    model = E.TargetEncoding().fit(t, "brand", "p_retailprice")
    apply = t.select("p_partkey", F.when(F.col("p_size") > 48, F.lit("Brand#new"))
                     .otherwise(F.col("brand")).alias("brand"))
    out = model.transform(apply, "brand_te")
    return out.select("p_partkey", "brand", rnd("brand_te", 4).alias("brand_te"))


@query("target_encode_crossfit", "C7", oracle=f"""
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS c, l_extendedprice AS y,
                  l_orderkey % 5 AS fold FROM lineitem),
cf AS (SELECT c, fold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM t GROUP BY c, fold),
ct AS (SELECT c, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM cf GROUP BY c),
gf AS (SELECT fold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM t GROUP BY fold),
g AS (SELECT count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM t),
loo AS (SELECT cf.c, cf.fold, ct.n - cf.n AS n, ct.s - cf.s AS s, ct.ss - cf.ss AS ss FROM cf JOIN ct USING (c)),
gl AS (SELECT gf.fold, g.n - gf.n AS n, g.s - gf.s AS s, g.ss - gf.ss AS ss FROM gf CROSS JOIN g),
st AS (SELECT loo.c, loo.fold, loo.n, loo.s / NULLIF(loo.n, 0) AS m,
              greatest(loo.ss / NULLIF(loo.n, 0) - power(loo.s / NULLIF(loo.n, 0), 2), 0) AS v FROM loo),
gs AS (SELECT fold, s / n AS gm, greatest(ss / n - power(s / n, 2), 0) AS gv FROM gl)
SELECT t.l_orderkey, t.l_linenumber, t.fold,
  {sql_rnd('coalesce(CASE WHEN st.n > 0 THEN coalesce(gs.gv * st.n / NULLIF(gs.gv * st.n + st.v, 0), 1) * st.m + (1 - coalesce(gs.gv * st.n / NULLIF(gs.gv * st.n + st.v, 0), 1)) * gs.gm END, gs.gm)', 2)} AS supp_te
FROM t JOIN gs USING (fold) LEFT JOIN st ON st.c = t.c AND st.fold = t.fold""")
def q_target_encode_crossfit(spark, d):
    li = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("supp"),
        "l_extendedprice", (F.col("l_orderkey") % 5).alias("fold"))
    out = E.TargetEncoding().fit_transform_crossfit(li, "supp", "l_extendedprice", "fold", "supp_te")
    return out.select("l_orderkey", "l_linenumber", "fold", rnd("supp_te", 2).alias("supp_te"))


# --------------------------------------------------------------------------- C8
def _impute_input(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_partkey") % 7 == 0, None).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_tax")).alias("tax"),
        F.when(F.col("l_suppkey") % 5 == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
        F.lit(None).cast("double").alias("empty"),
        "l_extendedprice")


_IMP_SQL = """
WITH t AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS tax,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag, l_extendedprice FROM lineitem)
"""


@query("impute_median", "C8,A11", oracle=_IMP_SQL + """
SELECT l_orderkey, l_linenumber, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM t)) AS qty,
       coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM t)) AS tax, coalesce(flag, 'MISSING') AS flag,
       l_extendedprice FROM t""")
def q_impute_median(spark, d):
    df = _impute_input(spark, d)
    model = E.Imputer("median", "constant").fit(df, target="l_extendedprice")
    return model.transform(df)


@query("impute_mode_constant", "C8", oracle=_IMP_SQL + """
, mq AS (SELECT qty AS m FROM t WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1),
mt AS (SELECT tax AS m FROM t WHERE tax IS NOT NULL GROUP BY tax ORDER BY count(*) DESC, tax LIMIT 1),
mf AS (SELECT flag AS m FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(qty, (SELECT m FROM mq)) AS qty, coalesce(tax, (SELECT m FROM mt)) AS tax,
       coalesce(flag, (SELECT m FROM mf)) AS flag, l_extendedprice FROM t""")
def q_impute_mode(spark, d):
    df = _impute_input(spark, d)
    model = E.Imputer("most_frequent", "most_frequent").fit(df, target="l_extendedprice")
    return model.transform(df)


# --------------------------------------------------------------------------- C9
@query("standard_scale", "C9", oracle=_TEMPORAL_SQL + f"""
, st AS (SELECT avg(o_totalprice) AS mp, stddev_pop(o_totalprice) AS sp, avg(mo) AS mm, stddev_pop(mo) AS sm
         FROM sp WHERE split = 'train')
SELECT o_orderkey, split, {sql_rnd('(o_totalprice - mp) / sp', 6)} AS o_totalprice, {sql_rnd('(mo - mm) / sm', 6)} AS mo
FROM sp CROSS JOIN st""")
def q_standard_scale(spark, d):
    df = S.temporal_split(_orders(spark, d), "yr", "mo", "o_orderkey", 0.1, 0.22)
    model = StandardScaling().fit(df.where(F.col("split") == "train"), ["o_totalprice", "mo"])
    out = model.transform(df)
    return out.select("o_orderkey", "split", rnd("o_totalprice", 6).alias("o_totalprice"),
                      rnd("mo", 6).alias("mo"))


# --------------------------------------------------------------------------- C10
EMB_DIM = 64


def embedding_columns(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                          for i in range(EMB_DIM)])


@query("pca_projection", "C10")
def q_pca_projection(spark, d):
    """Centre the 64 embedding dimensions, keep the components explaining 90 %."""
    df = embedding_columns(spark, d)
    cols = [f"e{i}" for i in range(EMB_DIM)]
    centred = StandardScaling().fit(df, cols)
    centred.scales = {c: 1.0 for c in cols}  # centre only
    model = PCAReduction(variance=0.9).fit(centred.transform(df), cols)
    out = model.transform(centred.transform(df))
    return out.select("vec_id", *[rnd(f"PC{j + 1}", 6).alias(f"PC{j + 1}") for j in range(model.k)])


@query("pca_loadings", "C10,W6")
def q_pca_loadings(spark, d):
    """Top-5 |loading| features of each retained component."""
    df = embedding_columns(spark, d)
    cols = [f"e{i}" for i in range(EMB_DIM)]
    centred = StandardScaling().fit(df, cols)
    centred.scales = {c: 1.0 for c in cols}
    model = PCAReduction(variance=0.9).fit(centred.transform(df), cols)
    return model.loadings_df(spark, 5)
