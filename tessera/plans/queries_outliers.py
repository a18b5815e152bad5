"""Registered queries for outlier detection (O1-O6, A7) on ``orders``:
target ``o_totalprice``, category ``o_orderpriority``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as O
from ..operators.forest import isolation_flags, pack_tree, score_rows
from ..session import load
from .common import rnd, sql_rnd
from .queries_prepare import EMB_DIM, embedding_columns
from .registry import query


def _orders(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", "o_orderpriority", "o_totalprice",
                    F.month("o_orderdate").alias("mo"), F.year("o_orderdate").alias("yr"))


_GLOBAL_SQL = """
WITH t AS (SELECT o_orderkey, o_totalprice AS y FROM orders),
s AS (SELECT avg(y) AS m, stddev_pop(y) AS sd, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM t),
f AS (SELECT o_orderkey, coalesce(abs((y - m) / NULLIF(sd, 0)) > {z}, false) AS z_out,
             coalesce(y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1), false) AS iqr_out FROM t, s)
"""


@query("outliers_z", "O1", oracle=_GLOBAL_SQL.format(z=2.0) + "SELECT o_orderkey, z_out FROM f")
def q_outliers_z(spark, d):
    out = O.detect_outliers(_orders(spark, d), "o_totalprice", ["o_orderkey"], z_threshold=2.0)
    return out.select("o_orderkey", "z_out")


@query("outliers_iqr", "O2,A11", oracle=_GLOBAL_SQL.format(z=2.0) + "SELECT o_orderkey, iqr_out FROM f")
def q_outliers_iqr(spark, d):
    out = O.detect_outliers(_orders(spark, d), "o_totalprice", ["o_orderkey"], z_threshold=2.0)
    return out.select("o_orderkey", "iqr_out")


@query("outliers_vote", "O4,O6", oracle=_GLOBAL_SQL.format(z=2.0) + """
SELECT o_orderkey, z_out, iqr_out, CAST(z_out AS INTEGER) + CAST(iqr_out AS INTEGER) AS votes,
       CAST(z_out AS INTEGER) + CAST(iqr_out AS INTEGER) >= 1 AS is_outlier FROM f""")
def q_outliers_vote(spark, d):
    out = O.detect_outliers(_orders(spark, d), "o_totalprice", ["o_orderkey"], z_threshold=2.0,
                            min_methods=1)
    return out.select("o_orderkey", "z_out", "iqr_out", "votes", "is_outlier")


@query("outliers_statistics", "O4", oracle=_GLOBAL_SQL.format(z=2.0) + ", q AS (SELECT " + ", ".join(
    f"{e} AS {n}" for e, n in [("count(*)", "n_rows"), ("min(o_totalprice)", "target_min"), ("max(o_totalprice)", "target_max"),
                               ("avg(o_totalprice)", "target_mean"), ("stddev_samp(o_totalprice)", "target_std"),
                               ("quantile_cont(o_totalprice, 0.25)", "q1"), ("quantile_cont(o_totalprice, 0.75)", "q3")]) + """ FROM orders),
n AS (SELECT count(*) FILTER (WHERE z_out) AS n_z, count(*) FILTER (WHERE iqr_out) AS n_iqr,
             count(*) FILTER (WHERE z_out OR iqr_out) AS total_outliers FROM f)
SELECT n_rows, n_z, n_iqr, total_outliers, """ + ", ".join(f"{sql_rnd(e)} AS {n}" for e, n in [
    ("100.0 * total_outliers / n_rows", "outlier_percentage"), ("target_min", "target_min"), ("target_max", "target_max"),
    ("target_mean", "target_mean"), ("target_std", "target_std"), ("q1", "q1"), ("q3", "q3"), ("q3 - q1", "iqr"),
    ("q1 - 1.5 * (q3 - q1)", "lower_bound"), ("q3 + 1.5 * (q3 - q1)", "upper_bound")]) + " FROM q, n")
def q_outliers_statistics(spark, d):
    flagged = O.detect_outliers(_orders(spark, d), "o_totalprice", ["o_orderkey"], z_threshold=2.0, min_methods=1)
    out = O.outlier_statistics(flagged, "o_totalprice")
    whole = ["n_rows", "n_z", "n_iqr", "total_outliers"]
    return out.select(*whole, *[rnd(c, 4).alias(c) for c in out.columns if c not in whole])


_CAT_SQL = """
WITH t AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice, ln(1 + o_totalprice) AS y FROM orders),
s AS (SELECT c, count(*) AS rows, avg(y) AS m, stddev_pop(y) AS sd,
             quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM t GROUP BY c),
f AS (SELECT o_orderkey, t.c, o_totalprice,
             rows >= 30 AND coalesce(abs((y - m) / NULLIF(sd, 0)) > 2.0, false) AS z_out,
             rows >= 30 AND coalesce(y < q1 - 1.0 * (q3 - q1) OR y > q3 + 1.0 * (q3 - q1), false) AS iqr_out
      FROM t JOIN s USING (c)),
v AS (SELECT *, CAST(z_out AS INTEGER) + CAST(iqr_out AS INTEGER) AS votes,
             CAST(z_out AS INTEGER) + CAST(iqr_out AS INTEGER) >= 2 AS is_outlier FROM f)
"""


def _by_category(spark, d):
    return O.detect_outliers_by_category(_orders(spark, d), "o_totalprice", "o_orderpriority",
                                         ["o_orderkey"], z_threshold=2.0, iqr_multiplier=1.0)


@query("outliers_by_category", "O5", oracle=_CAT_SQL + """
SELECT o_orderkey, c AS o_orderpriority, z_out, iqr_out, votes, is_outlier FROM v""")
def q_outliers_by_category(spark, d):
    return _by_category(spark, d).select("o_orderkey", "o_orderpriority", "z_out", "iqr_out",
                                         "votes", "is_outlier")


@query("outlier_category_report", "A7", oracle=_CAT_SQL + f"""
SELECT c AS o_orderpriority, count(*) AS n_rows, count(*) FILTER (WHERE is_outlier) AS n_outliers,
  {sql_rnd('count(*) FILTER (WHERE is_outlier) * 100.0 / count(*)', 4)} AS pct_outliers,
  {sql_rnd('avg(o_totalprice)', 4)} AS mean_all,
  {sql_rnd('avg(o_totalprice) FILTER (WHERE NOT is_outlier)', 4)} AS mean_clean,
  {sql_rnd('stddev_samp(o_totalprice)', 4)} AS std_all,
  {sql_rnd('stddev_samp(o_totalprice) FILTER (WHERE NOT is_outlier)', 4)} AS std_clean,
  min(o_totalprice) AS min, max(o_totalprice) AS max
FROM v GROUP BY c""")
def q_outlier_category_report(spark, d):
    rep = O.category_report(_by_category(spark, d), "o_totalprice", "o_orderpriority")
    return rep.select("o_orderpriority", "n_rows", "n_outliers",
                      *[rnd(c, 4).alias(c) for c in ["pct_outliers", "mean_all", "mean_clean",
                                                     "std_all", "std_clean"]], "min", "max")


@query("isolation_forest", "O3")
def q_isolation_forest(spark, d):
    """Isolation-forest flags (contamination 0.05) over the 64 embedding dimensions."""
    emb = embedding_columns(spark, d)
    return isolation_flags(emb, [f"e{i}" for i in range(EMB_DIM)], ["vec_id"], 0.05)


@query("outliers_vote_forest", "O4,O3")
def q_outliers_vote_forest(spark, d):
    """Three-method vote (z, IQR, isolation forest on price/year/month) on orders."""
    out = O.detect_outliers(_orders(spark, d), "o_totalprice", ["o_orderkey"],
                            features=["o_totalprice", "yr", "mo"], z_threshold=2.0, min_methods=2)
    return out.select("o_orderkey", "z_out", "iqr_out", "iso_out", "votes", "is_outlier")


@query("outliers_by_category_forest", "O5,O3")
def q_outliers_by_category_forest(spark, d):
    """Per-priority vote with a per-priority isolation forest on price/year/month."""
    out = O.detect_outliers_by_category(_orders(spark, d), "o_totalprice", "o_orderpriority",
                                        ["o_orderkey"], features=["o_totalprice", "yr", "mo"])
    return out.select("o_orderkey", "o_orderpriority", "z_out", "iqr_out", "iso_out", "votes",
                      "is_outlier")


#: A forest of three trees over (quantity, discount), written out; nodes are (feature, threshold, left, right, size), 64 rows a tree.
_FIXED_FOREST = [[(0, 25.0, 1, 2, 64), (1, 0.05, 3, 4, 30), (-1, 0.0, -1, -1, 34), (-1, 0.0, -1, -1, 12), (-1, 0.0, -1, -1, 18)],
                 [(1, 0.02, 1, 2, 64), (-1, 0.0, -1, -1, 1), (0, 48.0, 3, 4, 63), (-1, 0.0, -1, -1, 61), (-1, 0.0, -1, -1, 2)],
                 [(-1, 0.0, -1, -1, 64)]]


def _depth_sql(n):
    return f"{0.0 if n < 2 else 1.0} " if n <= 2 else f"(2 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n})"


@query("isolation_fixed_forest", "O3", oracle=f"""
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN q >= 25 THEN 1 + {_depth_sql(34)} WHEN l_discount < 0.05 THEN 2 + {_depth_sql(12)} ELSE 2 + {_depth_sql(18)} END
  + CASE WHEN l_discount < 0.02 THEN 1 + {_depth_sql(1)} WHEN q < 48 THEN 2 + {_depth_sql(61)} ELSE 2 + {_depth_sql(2)} END
  + {_depth_sql(64)} AS path
  FROM (SELECT *, CASE WHEN l_partkey % 6 = 0 THEN 0 ELSE l_quantity END AS q FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_rnd(f'pow(2, -(path / 3) / {_depth_sql(64)})', 6)} AS score FROM h""")
def q_isolation_fixed_forest(spark, d):
    """Scores of all lines by a forest that is given, with missing quantities read as 0."""
    li = load(spark, d, "lineitem").withColumn("quantity", F.when(F.col("l_partkey") % 6 > 0, F.col("l_quantity")))
    out = score_rows(li, ["quantity", "l_discount"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                     [(64, pack_tree(t)) for t in _FIXED_FOREST])
    return out.withColumn("score", rnd("score", 6))
