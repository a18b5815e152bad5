"""Registered queries for column functions (F1, F2/C4, F4, F5, A10) and
profiles (A5, A6/C2, A12/C5, A13/C3, A14)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions.floors import with_floor_features
from ..operators import profile as P
from ..session import load
from .common import rnd, sql_rnd
from .registry import query

# Floor strings used as stand-in input (FIXTURES §4.1), picked by
# p_size so every table row gets one; None is a real null.
FLOOR_STRINGS = ["P1-3", "S1-T-2", "PT-ST-1", " p2 ", "SEMI", "RIAL", "S2", "0", "13", "15",
                 "1E1", "01", "-1", "4-5", "1;2;3", "S3", "P13", "P01", "T1", "16", "NULL", "",
                 None, "P2-P3", "S-ST", "T-1", "P12;S1", "2.5", "-4", "1_0"]


def floor_input(spark, d):
    arr = F.array(*[F.lit(s).cast("string") for s in FLOOR_STRINGS])
    idx = (F.col("p_size") % len(FLOOR_STRINGS) + 1).cast("int")
    return load(spark, d, "part").select("p_partkey", F.element_at(arr, idx).alias("floor_str"))


def floor_oracle() -> str:
    lit = ", ".join("NULL" if s is None else "'" + s.replace("'", "''") + "'" for s in FLOOR_STRINGS)
    fl = r"^[+-]?(\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)(E[+-]?\d(_?\d)*)?$"
    return rf"""
WITH src AS (SELECT p_partkey, ([{lit}]::VARCHAR[])[p_size % {len(FLOOR_STRINGS)} + 1] AS floor_str FROM part),
n AS (SELECT p_partkey, floor_str, upper(trim(floor_str)) AS s,
             (floor_str IS NULL OR floor_str IN ('NULL', '')) AS miss FROM src),
f AS (SELECT *, list_sort(list_distinct(list_concat(list_concat(list_concat(
   list_transform(list_filter(regexp_extract_all(s, 'P(\d+)', 1), lambda d: regexp_full_match(d, '(1[0-2]|[1-9])')), lambda d: CAST(d AS DOUBLE)),
   list_transform(list_filter(regexp_extract_all(s, 'S(\d*)', 1), lambda d: d IN ('', '1', '2')), lambda d: CASE WHEN d = '2' THEN -2.0 ELSE -1.0 END)),
   list_filter([CASE WHEN contains(s, 'PT') THEN 0.0 END, CASE WHEN regexp_matches(s, 'T([^0-9]|$)') THEN 0.0 END,
                CASE WHEN contains(s, 'ST') THEN -0.5 END, CASE WHEN contains(s, 'SEMI') THEN -1.0 END,
                CASE WHEN contains(s, 'RIAL') THEN 0.5 END]::DOUBLE[], lambda x: x IS NOT NULL)),
   list_transform(list_filter(regexp_extract_all(s, '\b(\d+)\b', 1), lambda d: regexp_full_match(ltrim(d, '0'), '(1[0-2]|[1-9])')), lambda d: CAST(d AS DOUBLE))
 ))) AS found FROM n),
a AS (SELECT p_partkey, floor_str,
   CASE WHEN miss THEN []::DOUBLE[]
        WHEN len(found) > 0 THEN found
        WHEN regexp_full_match(s, '{fl}') AND TRY_CAST(replace(s, '_', '') AS DOUBLE) BETWEEN -5 AND 15
             THEN [TRY_CAST(replace(s, '_', '') AS DOUBLE)]
        ELSE []::DOUBLE[] END AS lv FROM f)
SELECT p_partkey, floor_str,
  list_min(lv) AS floor_min_floor, list_max(lv) AS floor_max_floor,
  CAST(len(lv) AS DOUBLE) AS floor_n_floors,
  CASE WHEN len(list_filter(lv, lambda x: x < 0)) > 0 THEN 1.0 ELSE 0.0 END AS floor_has_basement,
  CASE WHEN len(list_filter(lv, lambda x: x >= -0.5 AND x <= 0.5)) > 0 THEN 1.0 ELSE 0.0 END AS floor_has_ground,
  CASE WHEN len(list_filter(lv, lambda x: x >= 1)) > 0 THEN 1.0 ELSE 0.0 END AS floor_has_upper,
  coalesce(list_max(lv) - list_min(lv), 0.0) AS floor_floor_span,
  {sql_rnd("list_sum(list_transform(lv, lambda x: x * (x + 3))) / NULLIF(list_sum(list_transform(lv, lambda x: x + 3)), 0)", 6)}
    AS floor_floor_numeric_weighted
FROM a
"""


@query("floor_features", "F1", oracle=floor_oracle())
def q_floor_features(spark, d):
    out = with_floor_features(floor_input(spark, d), "floor_str")
    w = "floor_floor_numeric_weighted"
    return out.withColumn(w, rnd(w, 6))


# --------------------------------------------------------------------------- F2 / C4
def _text_table(spark, d):
    p = load(spark, d, "part")
    nul = F.col("p_partkey") % 9 == 0
    return p.select(
        "p_partkey",
        F.when(nul, None).otherwise(F.col("p_name")).alias("t_name"),
        F.col("p_size").cast("string").alias("t_size"),
        F.when(nul, None).otherwise(
            F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
             .otherwise(F.col("p_retailprice").cast("string"))).alias("t_mixed"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("e1 ")).alias("t_padded"))


_TEXT_SQL = """
WITH t AS (SELECT p_partkey,
   CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS t_name,
   CAST(p_size AS VARCHAR) AS t_size,
   CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_size % 3 = 0 THEN p_brand
        ELSE CAST(p_retailprice AS VARCHAR) END AS t_mixed,
   ' ' || CAST(p_size AS VARCHAR) || 'e1 ' AS t_padded FROM part)
"""
_NUM_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _sql_parse(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@query("numeric_conversion_rates", "F2,C4", oracle=_TEXT_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count({c}) AS n_non_null, count({_sql_parse(c)}) AS n_numeric, "
    f"{sql_rnd(f'count({_sql_parse(c)}) / NULLIF(count({c}), 0)', 6)} AS rate FROM t"
    for c in ["t_name", "t_size", "t_mixed", "t_padded"]))
def q_numeric_conversion_rates(spark, d):
    rates = P.conversion_rates(_text_table(spark, d), ["t_name", "t_size", "t_mixed", "t_padded"])
    return rates.withColumn("rate", rnd("rate", 6))


@query("numeric_conversion", "C4,F2", oracle=_TEXT_SQL + f"""
SELECT p_partkey, t_name, {_sql_parse('t_size')} AS t_size, t_mixed, {_sql_parse('t_padded')} AS t_padded
FROM t""")
def q_numeric_conversion(spark, d):
    from ..operators.cleaning import NumericConversion
    t = _text_table(spark, d)
    model = NumericConversion(threshold=0.8).fit(t, exclude=["p_partkey"])
    return model.transform(t)


# --------------------------------------------------------------------------- F4/F5/A10
def _acct(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, None)
                    .otherwise(F.col("c_acctbal")).alias("y"))


_LOG_SQL = """
WITH y AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS y FROM customer),
sh AS (SELECT CASE WHEN min(y) < -1 THEN abs(min(y)) + 1 ELSE 0 END AS shift FROM y),
l AS (SELECT c_custkey, y, shift, CASE WHEN y + shift > -1 THEN ln(1 + y + shift) END AS yl FROM y, sh),
med AS (SELECT quantile_cont(yl, 0.5) AS m FROM l WHERE yl IS NOT NULL AND isfinite(yl)),
o AS (SELECT c_custkey, y, shift, coalesce(yl, m) AS y_log FROM l, med)
"""


def _fit_log(df, col):
    from ..operators.scaling import LogTarget
    return LogTarget().fit(df, col)


@query("target_log", "F4", oracle=_LOG_SQL + f"SELECT c_custkey, {sql_rnd('y_log', 6)} AS y_log FROM o")
def q_target_log(spark, d):
    df = _acct(spark, d)
    model = _fit_log(df, "y")
    return model.transform(df).select("c_custkey", rnd("y_log", 6).alias("y_log"))


@query("target_inverse", "F5", oracle=_LOG_SQL + f"""
SELECT c_custkey, {sql_rnd('exp(y_log) - 1 - shift', 4)} AS y_back FROM o""")
def q_target_inverse(spark, d):
    df = _acct(spark, d)
    model = _fit_log(df, "y")
    logged = model.transform(df)
    return logged.select("c_custkey", rnd(model.inverse("y_log"), 4).alias("y_back"))


def _sql_skew(x: str, src: str) -> str:
    return (f"(SELECT avg(power({x} - m, 3)) / power(avg(power({x} - m, 2)), 1.5) FROM {src}, "
            f"(SELECT avg({x}) AS m FROM {src}) mm)")


@query("target_log_report", "F4,A10", oracle=_LOG_SQL + f"""
SELECT {sql_rnd(_sql_skew('y + shift', 'o'), 6)} AS original_skew,
       {sql_rnd(_sql_skew('y_log', 'o'), 6)} AS log_skew,
       (SELECT max(shift) FROM o) AS shift_applied,
       (SELECT count(*) FROM o WHERE y IS NULL) AS n_replaced""")
def q_target_log_report(spark, d):
    df = _acct(spark, d)
    model = _fit_log(df, "y")
    return model.report(df)


# --------------------------------------------------------------------------- A5
def _lines_with_nulls(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        F.when(F.col("l_partkey") % 7 == 0, None).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_suppkey") % 5 == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_tax")).alias("tax"),
        "l_extendedprice")


_LINES_SQL = """
WITH t AS (SELECT l_orderkey,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS tax,
  l_extendedprice FROM lineitem)
"""


@query("column_null_census", "A5", oracle=_LINES_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS n_missing, count(*) AS n_rows FROM t"
    for c in ["l_orderkey", "qty", "flag", "tax", "l_extendedprice"]))
def q_column_null_census(spark, d):
    return P.null_census(_lines_with_nulls(spark, d))


# --------------------------------------------------------------------------- A6 / C2
_PROFILE_COLS = ["p_brand", "p_type", "p_size", "maker", "tag"]


def _profile_input(spark, d):
    p = load(spark, d, "part")
    return p.select("p_brand", "p_type", "p_size",
                    F.when(F.col("p_partkey") % 50 == 0, F.lit("other")).otherwise(F.lit("acme")).alias("maker"),
                    F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_type")).alias("tag"))


_PROFILE_SQL = """
WITH t AS (SELECT p_brand, p_type, p_size,
   CASE WHEN p_partkey % 50 = 0 THEN 'other' ELSE 'acme' END AS maker,
   CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS tag FROM part),
cells AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value FROM t" for c in _PROFILE_COLS) + """),
cnt AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY "column", value),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS FIRST) AS rn,
              CAST(sum(n) OVER (PARTITION BY "column") AS BIGINT) AS n_rows, count(*) OVER (PARTITION BY "column") AS n_distinct
       FROM cnt)
"""


@query("top_value_share", "A6", oracle=_PROFILE_SQL + f"""
SELECT "column", {sql_rnd('n / n_rows', 6)} AS top_share, n_distinct, value AS top_value, n_rows
FROM rk WHERE rn = 1""")
def q_top_value_share(spark, d):
    prof = P.value_profile(_profile_input(spark, d))
    return prof.withColumn("top_share", rnd("top_share", 6))


@query("constant_columns", "C2", oracle=_PROFILE_SQL + f"""
SELECT "column", {sql_rnd('n / n_rows', 6)} AS top_share FROM rk WHERE rn = 1 AND n / n_rows >= 0.95""")
def q_constant_columns(spark, d):
    const = P.constant_columns(_profile_input(spark, d), 0.95)
    return const.select("column", rnd("top_share", 6).alias("top_share"))


def _missing_input(spark, d):
    """A number that is mostly NaN or null, a text that is half null, and columns without a frequent value."""
    p = load(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 1, None).otherwise(F.col("p_retailprice")).alias("gap"),
                    F.when(k % 2 == 0, None).otherwise(F.col("p_brand")).alias("half"),
                    F.when(k % 5 < 2, F.lit("low")).otherwise(F.lit("high")).alias("side"), "p_type", "p_partkey")


@query("frequent_values", "A6,C2", oracle="""
WITH t AS (SELECT CASE WHEN p_partkey % 3 < 2 THEN NULL ELSE p_retailprice END AS gap,
   CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS half,
   CASE WHEN p_partkey % 5 < 2 THEN 'low' ELSE 'high' END AS side, p_type, p_partkey FROM part),
cells AS (SELECT 'gap' AS column, NULL AS value, count(*) AS n FROM t WHERE gap IS NULL
  UNION ALL SELECT 'half', half, count(*) FROM t GROUP BY half
  UNION ALL SELECT 'side', side, count(*) FROM t GROUP BY side
  UNION ALL SELECT 'p_type', p_type, count(*) FROM t GROUP BY p_type),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS FIRST) AS rn FROM cells)
SELECT "column", n AS top_count, """ + sql_rnd("n / (SELECT count(*) FROM t)", 6) + """ AS top_share, value AS top_value,
       (SELECT count(*) FROM t) AS n_rows
FROM rk WHERE rn = 1 AND n >= 0.3 * (SELECT count(*) FROM t)""")
def q_frequent_values(spark, d):
    return P.frequent_values(_missing_input(spark, d), least_share=0.3).withColumn("top_share", rnd("top_share", 6))


# --------------------------------------------------------------------------- A12 / C5
_NUM_COLS = ["qty", "price", "disc", "tax", "qty2"]


def _numeric_input(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_partkey") % 7 == 0, None).otherwise(F.col("l_quantity")).alias("qty"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_discount") + 0.0).alias("disc"),
        F.when(F.col("l_suppkey") % 4 == 0, None).otherwise(F.col("l_tax")).alias("tax"),
        (F.lit(2.0) * F.col("l_quantity") + F.when(F.col("l_linenumber") == 3, 1.0).otherwise(0.0)).alias("qty2"))


_NUM_SQL = """
WITH t AS (SELECT CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
   l_extendedprice AS price, l_discount + 0.0 AS disc,
   CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_tax END AS tax,
   2.0 * l_quantity + CASE WHEN l_linenumber = 3 THEN 1.0 ELSE 0.0 END AS qty2 FROM lineitem),
pr AS (""" + " UNION ALL ".join(
    f"SELECT {k} AS pos, '{a}' AS column1, '{b}' AS column2, "
    f"covar_pop(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) / "
    f"NULLIF(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS r FROM t"
    for k, (a, b) in enumerate(itertools.combinations(_NUM_COLS, 2))) + ")"


@query("pearson_pairs", "A12", oracle=_NUM_SQL + f" SELECT column1, column2, {sql_rnd('r', 6)} AS r FROM pr")
def q_pearson_pairs(spark, d):
    pairs = P.pearson_pairs_df(_numeric_input(spark, d), _NUM_COLS)
    return pairs.withColumn("r", rnd("r", 6))


_WIDE = 40


@query("pearson_wide", "A12", oracle=f"""
WITH m AS (SELECT id, list(CASE WHEN (l_orderkey + k) % 11 > 0 THEN l_quantity * (k % 5 + 1) + (l_partkey * (k + 3)) % 97 END ORDER BY k) AS v
      FROM (SELECT *, row_number() OVER () AS id FROM lineitem), (SELECT unnest(range(0, {_WIDE})) AS k) GROUP BY id)
SELECT 'c' || a.k AS column1, 'c' || b.k AS column2, {sql_rnd('corr(v[a.k + 1], v[b.k + 1])', 6)} AS r
FROM (SELECT unnest(range(0, {_WIDE})) AS k) AS a JOIN (SELECT unnest(range(0, {_WIDE})) AS k) AS b ON a.k < b.k, m
GROUP BY a.k, b.k""")
def q_pearson_wide(spark, d):
    li = load(spark, d, "lineitem")
    cols = [F.when((F.col("l_orderkey") + k) % 11 > 0, F.col("l_quantity") * (k % 5 + 1) + (F.col("l_partkey") * (k + 3)) % 97)
            .alias(f"c{k}") for k in range(_WIDE)]
    return P.pearson_pairs_df(li.select(*cols), [f"c{k}" for k in range(_WIDE)]).withColumn("r", rnd("r", 6))


@query("pearson_drop_list", "C5", oracle=_NUM_SQL + " SELECT DISTINCT column2 AS column FROM pr WHERE abs(r) > 0.95")
def q_pearson_drop_list(spark, d):
    from ..operators.cleaning import CorrelationPruning
    model = CorrelationPruning(threshold=0.95).fit(_numeric_input(spark, d), _NUM_COLS)
    return model.dropped_df(spark)


# --------------------------------------------------------------------------- A13 / C3
_CAT_COLS = ["flag", "status", "ship_month", "flag2"]


def _cat_input(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_partkey") % 9 == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.month("l_shipdate").cast("string").alias("ship_month"),
        F.when(F.col("l_returnflag") == "N", F.lit("x")).otherwise(F.col("l_linestatus")).alias("flag2"))


_CAT_SQL = """
WITH t AS (SELECT CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_returnflag END AS flag,
   l_linestatus AS status, CAST(month(l_shipdate) AS VARCHAR) AS ship_month,
   CASE WHEN l_returnflag = 'N' THEN 'x' ELSE l_linestatus END AS flag2 FROM lineitem),
cells AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS c1, '{b}' AS c2, {a} AS a, {b} AS b, count(*) AS n FROM t "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"
    for a, b in itertools.combinations(_CAT_COLS, 2)) + """),
ra AS (SELECT c1, c2, a, sum(n) AS na FROM cells GROUP BY ALL),
rb AS (SELECT c1, c2, b, sum(n) AS nb FROM cells GROUP BY ALL),
per AS (SELECT cells.c1, cells.c2, CAST(sum(n) AS DOUBLE) AS n, sum(n * n / (na * nb)) AS s,
               CAST(count(DISTINCT cells.a) AS DOUBLE) AS r, CAST(count(DISTINCT cells.b) AS DOUBLE) AS k
        FROM cells JOIN ra USING (c1, c2, a) JOIN rb USING (c1, c2, b) GROUP BY ALL),
v AS (SELECT c1, c2, n, n * (s - 1) AS chi2,
        greatest(0, n * (s - 1) / n - (k - 1) * (r - 1) / (n - 1)) AS phi2c,
        least((k - (k - 1) * (k - 1) / (n - 1)) - 1, (r - (r - 1) * (r - 1) / (n - 1)) - 1) AS den, r, k FROM per)
"""


@query("cramers_v_pairs", "A13,C3", oracle=_CAT_SQL + f"""
SELECT c1, c2, {sql_rnd('chi2', 4)} AS chi2,
       CASE WHEN r >= 2 AND k >= 2 AND den > 0 THEN {sql_rnd('sqrt(phi2c / den)', 6)} END AS cramers_v,
       CAST(n AS BIGINT) AS n FROM v""")
def q_cramers_v_pairs(spark, d):
    v = P.cramers_v_pairs(_cat_input(spark, d), _CAT_COLS)
    return v.select("c1", "c2", rnd("chi2", 4).alias("chi2"), rnd("cramers_v", 6).alias("cramers_v"), "n")


_CELL_COLS = ["flag", "line", "month", "supplier"]


@query("contingency_cells", "A13", oracle="""
WITH t AS (SELECT CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_returnflag END AS flag, CAST(l_linenumber AS VARCHAR) AS line,
                  CAST(month(l_shipdate) AS VARCHAR) AS month, 's' || (l_partkey % 1000) AS supplier FROM lineitem)
""" + " UNION ALL ".join(f"SELECT '{a}' AS c1, '{b}' AS c2, {a} AS a, {b} AS b, count(*) AS n FROM t "
                        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for a, b in itertools.combinations(_CELL_COLS, 2)))
def q_contingency_cells(spark, d):
    li = load(spark, d, "lineitem")
    return P.contingency(li.select(
        F.when(F.col("l_partkey") % 9 == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
        F.col("l_linenumber").cast("string").alias("line"), F.month("l_shipdate").cast("string").alias("month"),
        F.concat(F.lit("s"), F.col("l_partkey") % 1000).alias("supplier")), _CELL_COLS)


@query("target_correlations", "A14", oracle=_NUM_SQL.split(",\npr AS")[0] + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sql_rnd(f'covar_pop(coalesce({c}, 0), price) / NULLIF(stddev_pop(coalesce({c}, 0)) * stddev_pop(price), 0)', 6)} AS r FROM t"
    for c in ["qty", "disc", "tax", "qty2"]))
def q_target_correlations(spark, d):
    out = P.target_correlations(_numeric_input(spark, d), ["qty", "disc", "tax", "qty2"], "price")
    return out.withColumn("r", rnd("r", 6))
