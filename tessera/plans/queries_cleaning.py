"""Registered queries for row/column cleaning."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..session import load
from .registry import query


def _part_text(spark, d):
    p = load(spark, d, "part")
    return p.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 4 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_partkey") % 6 == 0, F.lit("")).otherwise(F.col("p_type")).alias("type"),
        "p_brand", "p_size",
        F.when(F.col("p_partkey") % 9 == 0, None).otherwise(F.col("p_retailprice")).alias("price"),
        F.lit("").alias("blank"),
        F.lit(None).cast("double").alias("unused"))


_PART_SQL = """
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END AS type, p_brand, p_size,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS price, '' AS blank,
  CAST(NULL AS DOUBLE) AS unused FROM part)
"""


@query("empty_to_null", "P4", oracle=_PART_SQL + """
SELECT p_partkey, nullif(name, '') AS name, nullif(type, '') AS type, nullif(p_brand, '') AS p_brand, p_size,
       price, nullif(blank, '') AS blank, unused FROM t""")
def q_empty_to_null(spark, d):
    return C.empty_to_null(_part_text(spark, d))


@query("drop_listed_columns", "P5", oracle=_PART_SQL + """
SELECT p_partkey, name, type, p_size, price, blank FROM t""")
def q_drop_listed(spark, d):
    out, _ = C.drop_listed(_part_text(spark, d), ["p_brand", "unused", "not_a_column"])
    return out


@query("drop_null_target", "P6", oracle=_PART_SQL + "SELECT * FROM t WHERE price IS NOT NULL")
def q_drop_null_target(spark, d):
    return C.drop_null_target(_part_text(spark, d), "price")


@query("drop_empty_columns", "P7", oracle=_PART_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS column FROM t HAVING count(nullif({c}, '')) = 0" if c in ("name", "type", "p_brand", "blank")
    else f"SELECT '{c}' AS column FROM t HAVING count({c}) = 0"
    for c in ["p_partkey", "name", "type", "p_brand", "p_size", "price", "blank", "unused"]))
def q_drop_empty_columns(spark, d):
    df = C.empty_to_null(_part_text(spark, d))
    return spark.createDataFrame([(c,) for c in C.empty_columns(df)], "column string")


def _dup_input(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_quantity", "l_returnflag",
        F.col("l_quantity").alias("qty_copy"),
        (F.col("l_quantity") * 1.0).alias("qty_times_one"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("qty_near"),
        F.col("l_returnflag").alias("flag_copy"),
        F.when(F.col("l_partkey") % 3 == 0, None).otherwise(F.col("l_tax")).alias("tax_a"),
        F.when(F.col("l_partkey") % 3 == 0, None).otherwise(F.col("l_tax")).alias("tax_b"),
        F.col("l_orderkey").cast("double").alias("okey_double"))


_DUP_COLS = ["l_orderkey", "l_quantity", "l_returnflag", "qty_copy", "qty_times_one", "qty_near",
             "flag_copy", "tax_a", "tax_b", "okey_double"]
_DUP_TYPES = {"l_orderkey": "bigint", "l_returnflag": "string", "flag_copy": "string", "okey_double": "double"}


def _dup_oracle() -> str:
    ty = {c: _DUP_TYPES.get(c, "double") for c in _DUP_COLS}
    pairs = [(a, b) for a, b in itertools.combinations(_DUP_COLS, 2) if ty[a] == ty[b]]
    return """
WITH t AS (SELECT l_orderkey, l_quantity, l_returnflag, l_quantity AS qty_copy, l_quantity * 1.0 AS qty_times_one,
  CASE WHEN l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END AS qty_near, l_returnflag AS flag_copy,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_tax END AS tax_a,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_tax END AS tax_b, CAST(l_orderkey AS DOUBLE) AS okey_double FROM lineitem),
eq AS (""" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {i} AS ia, {j} AS ib, bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM t"
        for (a, b) in pairs for i, j in [(_DUP_COLS.index(a), _DUP_COLS.index(b))]) + """)
SELECT DISTINCT b AS column FROM eq WHERE same"""


@query("duplicate_columns", "D2", oracle=_dup_oracle())
def q_duplicate_columns(spark, d):
    dup = C.duplicate_columns(_dup_input(spark, d))
    return spark.createDataFrame([(c,) for c in dup], "column string")


@query("dedupe_rows", "D1", oracle="""
SELECT DISTINCT l_returnflag, l_linestatus, l_quantity,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount + 0.0 END AS disc FROM lineitem""")
def q_dedupe_rows(spark, d):
    li = load(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity",
        F.when(F.col("l_partkey") % 5 == 0, None).otherwise(F.col("l_discount") + 0.0).alias("disc"))
    return C.dedupe_rows(li)


@query("clean_chain", "C1,P4,P5,C2,P6,P7,D1", oracle=_PART_SQL + """
SELECT DISTINCT p_partkey, nullif(name, '') AS name, nullif(type, '') AS type, p_brand, p_size, price
FROM t WHERE price IS NOT NULL""")
def q_clean_chain(spark, d):
    out, _ = C.clean(_part_text(spark, d), target="price", columns_to_remove=["not_there"],
                     constant_threshold=0.95)
    return out


def _assoc_oracle() -> str:
    from .queries_columns import _CAT_COLS, _CAT_SQL
    nu = " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS u FROM t" for c in _CAT_COLS)
    return _CAT_SQL + f""", nu AS ({nu}),
hi AS (SELECT least(c1, c2) AS a, greatest(c1, c2) AS b FROM v
       WHERE r >= 2 AND k >= 2 AND den > 0 AND sqrt(phi2c / den) > 0.5 AND sqrt(phi2c / den) < 1.0)
SELECT DISTINCT CASE WHEN na.u <= nb.u THEN hi.a ELSE hi.b END AS column
FROM hi JOIN nu na ON na.c = hi.a JOIN nu nb ON nb.c = hi.b"""


@query("association_pruning", "C3,C3b,Q11,Q12", oracle=_assoc_oracle())
def q_association_pruning(spark, d):
    from .queries_columns import _cat_input
    model = C.AssociationPruning(threshold=0.5).fit(_cat_input(spark, d))
    return spark.createDataFrame([(c,) for c in model.dropped], "column string")
