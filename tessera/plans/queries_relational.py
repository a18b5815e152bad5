"""Registered queries for the retrieval / dataset-construction operators.

Stand-ins on the driver's tables: orders = acts, lineitem = units,
customer/nation/region/part/supplier = dimension chain, events = points of
interest by category.  Derived columns (declared counts, missing areas) are
plain expressions of existing columns, written the same way in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import load
from ..sources.catalog import catalog_select_list, schema_catalog
from .common import rnd, sql_rnd
from .registry import query


def acts_units(spark, d):
    orders = load(spark, d, "orders").withColumn(
        "declared_units", F.lit(1) + F.col("o_custkey") % 7)
    lines = load(spark, d, "lineitem")
    return orders.join(lines, lines.l_orderkey == orders.o_orderkey, "inner")


@query("coherent_groups", "A1,J7", oracle="""
WITH j AS (
  SELECT o.o_orderkey, 1 + o.o_custkey % 7 AS declared_units,
         l.l_linenumber, l.l_partkey, l.l_quantity
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
g AS (SELECT o_orderkey FROM j GROUP BY o_orderkey HAVING count(*) = min(declared_units))
SELECT * FROM j WHERE o_orderkey IN (SELECT o_orderkey FROM g)
""")
def q_coherent_groups(spark, d):
    j = acts_units(spark, d).select("o_orderkey", "declared_units", "l_linenumber",
                                      "l_partkey", "l_quantity")
    return R.coherent_groups(j, "o_orderkey", "declared_units")


@query("price_redistribution", "A2,J6", oracle="""
WITH u AS (
  SELECT o.o_orderkey, o.o_totalprice, l.l_linenumber, l.l_partkey,
         0.9 * p.p_retailprice AS unit_min, 1.1 * p.p_retailprice AS unit_max,
         CASE WHEN l.l_partkey % 11 = 0 THEN NULL ELSE l.l_quantity END AS area
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
                JOIN part p ON p.p_partkey = l.l_partkey),
e AS (SELECT *, (unit_min + unit_max) / 2.0 * area AS est FROM u),
c AS (SELECT o_orderkey, min(o_totalprice) / NULLIF(sum(est), 0) AS coef FROM e GROUP BY o_orderkey)
SELECT e.o_orderkey, e.l_linenumber, e.l_partkey, e.area,
       """ + sql_rnd("e.est * c.coef", 2) + """ AS redistributed_price
FROM e LEFT JOIN c ON e.o_orderkey = c.o_orderkey
""")
def q_price_redistribution(spark, d):
    part = load(spark, d, "part").select(
        "p_partkey", (F.lit(0.9) * F.col("p_retailprice")).alias("unit_min"),
        (F.lit(1.1) * F.col("p_retailprice")).alias("unit_max"))
    u = (acts_units(spark, d)
         .join(part, F.col("p_partkey") == F.col("l_partkey"))
         .select("o_orderkey", "o_totalprice", "l_linenumber", "l_partkey", "unit_min", "unit_max",
                 F.when(F.col("l_partkey") % 11 == 0, None).otherwise(F.col("l_quantity")).alias("area")))
    out = R.redistribute_total(u, "o_orderkey", "o_totalprice", "unit_min", "unit_max", "area")
    return out.select("o_orderkey", "l_linenumber", "l_partkey", "area",
                      rnd("redistributed_price", 2).alias("redistributed_price"))


# Columns of each dimension that the star join retrieves (timestamps left out
# so both engines hash the same values).
_STAR_COLS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_returnflag", "l_linestatus"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "part": ["p_partkey", "p_brand", "p_type", "p_size"],
    "supplier": ["s_suppkey", "s_nationkey"],
}
_STAR_ALIAS = {"lineitem": "L", "orders": "O", "customer": "C", "nation": "N",
               "region": "R", "part": "P", "supplier": "S"}
_STAR_PICK = ["L", "O", "C", "N", "R", "P"]


def _star_oracle() -> str:
    sel = ", ".join(f"{_STAR_ALIAS[t]}.{c} AS {_STAR_ALIAS[t]}_{c}"
                    for t, cols in _STAR_COLS.items() if _STAR_ALIAS[t] in _STAR_PICK for c in cols)
    return f"""
SELECT {sel}
FROM lineitem L
  JOIN orders O ON L.l_orderkey = O.o_orderkey
  JOIN customer C ON O.o_custkey = C.c_custkey
  JOIN nation N ON C.c_nationkey = N.n_nationkey
  JOIN region R ON N.n_regionkey = R.r_regionkey
  JOIN part P ON L.l_partkey = P.p_partkey
  JOIN supplier S ON L.l_suppkey = S.s_suppkey
WHERE C.c_nationkey = S.s_nationkey AND L.l_partkey IS NOT NULL
"""


@query("star_join", "J1,P1,P2,S6", oracle=_star_oracle())
def q_star_join(spark, d):
    tables = {t: load(spark, d, t).select(*cols) for t, cols in _STAR_COLS.items()}
    cat = schema_catalog(spark, tables)
    select_list = catalog_select_list(cat.collect(), selected_aliases=_STAR_PICK)
    a = {t: df.alias(_STAR_ALIAS[t]) for t, df in tables.items()}
    joined = R.star_join(a["lineitem"], [
        (a["orders"], F.col("L.l_orderkey") == F.col("O.o_orderkey")),
        (a["customer"], F.col("O.o_custkey") == F.col("C.c_custkey")),
        (a["nation"], F.col("C.c_nationkey") == F.col("N.n_nationkey")),
        (a["region"], F.col("N.n_regionkey") == F.col("R.r_regionkey")),
        (a["part"], F.col("L.l_partkey") == F.col("P.p_partkey")),
        (a["supplier"], F.col("L.l_suppkey") == F.col("S.s_suppkey")),
    ])
    filtered = joined.where((F.col("C.c_nationkey") == F.col("S.s_nationkey"))
                            & F.col("L.l_partkey").isNotNull())
    return filtered.select(*select_list)


_VALUE_STATES = dict(required=("N", "normal"), optional=[("A", "best"), ("R", "poor")])


@query("state_value_join", "J2", oracle="""
WITH v AS (
  SELECT l_partkey, l_linestatus, l_returnflag,
         min(l_extendedprice / l_quantity) AS vmin, max(l_extendedprice / l_quantity) AS vmax
  FROM lineitem GROUP BY l_partkey, l_linestatus, l_returnflag)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_linestatus,
       """ + ", ".join(f"{sql_rnd(f'{a}.{v}')} AS OV_{v}_{s}" for a, s in
                      [("n", "normal"), ("a", "best"), ("r", "poor")] for v in ("vmin", "vmax")) + """
FROM lineitem f
  JOIN v n ON n.l_partkey = f.l_partkey AND n.l_linestatus = f.l_linestatus AND n.l_returnflag = 'N'
  LEFT JOIN v a ON a.l_partkey = f.l_partkey AND a.l_linestatus = f.l_linestatus AND a.l_returnflag = 'A'
  LEFT JOIN v r ON r.l_partkey = f.l_partkey AND r.l_linestatus = f.l_linestatus AND r.l_returnflag = 'R'
""")
def q_state_value_join(spark, d):
    li = load(spark, d, "lineitem")
    unit = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    values = (li.groupBy("l_partkey", "l_linestatus", "l_returnflag")
                .agg(F.min(unit).alias("vmin"), F.max(unit).alias("vmax")))
    facts = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    out = R.state_conditioned_join(facts, values, ["l_partkey", "l_linestatus"], "l_returnflag",
                                   value_cols=["vmin", "vmax"], **_VALUE_STATES)
    vals = [c for c in out.columns if c.startswith("OV_")]
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus",
                      *[rnd(c, 4).alias(c) for c in vals])


@query("state_value_fan_out", "J2", oracle="""
SELECT o.o_orderkey, o.o_orderstatus, """ + ", ".join(f"{a}.{v} AS OV_{v}_{s}" for a, s in
                                                    [("n", "normal"), ("a", "best"), ("r", "poor")] for v in ("l_quantity", "l_tax")) + """
FROM orders o
  JOIN lineitem n ON n.l_orderkey = o.o_orderkey AND n.l_returnflag = 'N'
  LEFT JOIN lineitem a ON a.l_orderkey = o.o_orderkey AND a.l_returnflag = 'A'
  LEFT JOIN lineitem r ON r.l_orderkey = o.o_orderkey AND r.l_returnflag = 'R'
""")
def q_state_value_fan_out(spark, d):
    """Several value rows of one key and state: every combination comes out."""
    values = load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    facts = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return R.state_conditioned_join(facts, values, ["o_orderkey"], "l_returnflag", value_cols=["l_quantity", "l_tax"], **_VALUE_STATES)


def _incomplete(spark, d, null_key: bool):
    li = load(spark, d, "lineitem")
    area = F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("l_quantity"))
    key = F.col("l_orderkey")
    if null_key:
        key = F.when(F.col("l_linenumber") == 7, None).otherwise(key)
    return li.select(key.alias("bad_key"), area.alias("area")).where(F.col("area").isNull())


def _acts_nullable(spark, d):
    o = load(spark, d, "orders")
    return o.select(F.when(F.col("o_orderkey") % 17 == 0, None).otherwise(F.col("o_orderkey"))
                    .alias("act_id"), "o_custkey", "o_totalprice")


_EXCL_SQL = """
WITH a AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey END AS act_id,
                  o_custkey, o_totalprice FROM orders)
SELECT * FROM a WHERE act_id NOT IN (
  SELECT {key} FROM lineitem WHERE (CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END) IS NULL)
"""


@query("exclude_incomplete_groups", "P3",
       oracle=_EXCL_SQL.format(key="l_orderkey"))
def q_exclude_incomplete(spark, d):
    return R.exclude_groups(_acts_nullable(spark, d), "act_id", _incomplete(spark, d, False), "bad_key")


@query("exclude_incomplete_groups_nullkey", "P3,Q30",
       oracle=_EXCL_SQL.format(key="CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END"))
def q_exclude_incomplete_nullkey(spark, d):
    return R.exclude_groups(_acts_nullable(spark, d), "act_id", _incomplete(spark, d, True), "bad_key")


# The event categories of the driver's events table, used by the
# oracle only (the Spark side discovers them with ``distinct_categories``).
_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("category_counts_wide", "J5,A4,F6", oracle="""
SELECT c.c_custkey AS user_id, """ + ",\n       ".join(
    f"CAST(count(CASE WHEN e.event_type = '{t}' THEN 1 END) AS BIGINT) AS EV_{t}_count"
    for t in _EVENT_TYPES) + """
FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey
GROUP BY c.c_custkey
""")
def q_category_counts_wide(spark, d):
    ev = load(spark, d, "events")
    cats = R.distinct_categories(ev, "event_type")
    entities = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return R.counts_wide(ev, "user_id", "event_type", cats, prefix="EV", entities=entities)


@query("category_counts", "A4", oracle="""
SELECT user_id, event_type, count(event_type) AS n FROM events GROUP BY user_id, event_type
""")
def q_category_counts(spark, d):
    return R.category_counts(load(spark, d, "events"), "user_id", "event_type")


@query("category_list", "A3", oracle="""
SELECT DISTINCT p_type, p_brand FROM part
""")
def q_category_list(spark, d):
    return R.category_list(load(spark, d, "part"), "p_type", "p_brand")
