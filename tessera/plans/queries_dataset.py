"""Composed flows over the retrieval operators: the dataset build
and a row predicate over two different columns with a nullable third (P2).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.floors import with_floor_features
from ..operators import relational as R
from ..operators.cleaning import drop_null_target
from ..session import load
from .common import rnd, sql_rnd
from .queries_columns import floor_input, floor_oracle
from .queries_relational import acts_units
from .registry import query

_FEATURES = ["min_floor", "max_floor", "n_floors", "has_basement", "has_ground", "has_upper", "floor_span",
             "floor_numeric_weighted"]

_BUILD_SQL = f"""
WITH j AS (
  SELECT o.o_orderkey, o.o_totalprice, l.l_linenumber, l.l_partkey,
         CASE WHEN l.l_partkey % 11 = 0 THEN NULL ELSE l.l_quantity END AS area,
         1 + o.o_custkey % 7 AS declared_units
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
g AS (SELECT o_orderkey FROM j GROUP BY o_orderkey HAVING count(*) = min(declared_units)),
u AS (SELECT j.*, (0.9 * p.p_retailprice + 1.1 * p.p_retailprice) / 2.0 * area AS est
      FROM j JOIN part p ON p.p_partkey = j.l_partkey WHERE j.o_orderkey IN (SELECT o_orderkey FROM g)),
c AS (SELECT o_orderkey, min(o_totalprice) / NULLIF(sum(est), 0) AS coef FROM u GROUP BY o_orderkey),
f AS ({floor_oracle()})
SELECT u.o_orderkey, u.l_linenumber, u.l_partkey, u.area,
       {sql_rnd("u.est * c.coef", 2)} AS redistributed_price,
       {", ".join(f"f.floor_{x} AS floor_{x}" for x in _FEATURES)}
FROM u JOIN c ON u.o_orderkey = c.o_orderkey JOIN f ON f.p_partkey = u.l_partkey
WHERE u.est * c.coef IS NOT NULL
"""


@query("dataset_build", "A1,A2,F1,P7", oracle=_BUILD_SQL)
def q_dataset_build(spark, d):
    """Units of coherent acts with the act's price apportioned, floor features, and no missing target."""
    part = load(spark, d, "part").select(
        "p_partkey", (F.lit(0.9) * F.col("p_retailprice")).alias("unit_min"),
        (F.lit(1.1) * F.col("p_retailprice")).alias("unit_max"))
    units = R.coherent_groups(acts_units(spark, d), "o_orderkey", "declared_units")
    units = (units.join(part, F.col("p_partkey") == F.col("l_partkey"))
             .select("o_orderkey", "o_totalprice", "l_linenumber", "l_partkey", "unit_min", "unit_max",
                     F.when(F.col("l_partkey") % 11 == 0, None).otherwise(F.col("l_quantity")).alias("area")))
    priced = R.redistribute_total(units, "o_orderkey", "o_totalprice", "unit_min", "unit_max", "area")
    floors = with_floor_features(floor_input(spark, d), "floor_str")
    full = drop_null_target(priced.join(floors, F.col("l_partkey") == F.col("p_partkey")), "redistributed_price")
    return full.select("o_orderkey", "l_linenumber", "l_partkey", "area",
                       rnd("redistributed_price", 2).alias("redistributed_price"), *[f"floor_{x}" for x in _FEATURES[:-1]],
                       rnd(f"floor_{_FEATURES[-1]}", 6).alias(f"floor_{_FEATURES[-1]}"))


@query("matched_rows", "P2", oracle="""
SELECT o_orderkey, l_linenumber, c_nationkey, s_nationkey,
       CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END AS area
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
     JOIN supplier ON l_suppkey = s_suppkey
WHERE c_nationkey = s_nationkey AND l_partkey % 13 <> 0
""")
def q_matched_rows(spark, d):
    """Order lines whose customer and supplier share a nation and whose area is known."""
    rows = R.star_join(load(spark, d, "lineitem"), [
        (load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")),
        (load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")),
        (load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")),
    ]).withColumn("area", F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("l_quantity")))
    return R.equal_and_present(rows, "c_nationkey", "s_nationkey", ["area"]).select(
        "o_orderkey", "l_linenumber", "c_nationkey", "s_nationkey", "area")
