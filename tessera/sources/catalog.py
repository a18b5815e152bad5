"""Schema catalogue (S6) and catalogue-driven projection.

The catalogue is a small DataFrame ``(table, alias, column, type, retrieve)``
built from Spark schemas; the projection turns it into one ``select`` whose
column pruning reaches the parquet / JDBC scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type-name normalisation, tested in this order on the upper-cased
# raw type name (first hit wins).
TYPE_RULES = [
    ("integer", ["INT"]),
    ("float", ["FLOAT", "REAL", "DECIMAL", "NUMERIC"]),
    ("geometry", ["GEOMETRY"]),
    ("geography", ["GEOGRAPHY"]),
    ("nvarchar", ["NVARCHAR"]),
    ("varchar", ["VARCHAR"]),
    ("char", ["CHAR"]),
    ("datetime", ["DATE", "TIME", "DATETIME"]),
    ("money", ["MONEY"]),
    ("binary", ["BINARY"]),
    ("text", ["TEXT"]),
    ("boolean", ["BIT"]),
    ("uuid", ["UNIQUEIDENTIFIER"]),
]
GEO_TYPES = ("geometry", "geography")

# Spark type names mapped into the same vocabulary before the rules above.
_SPARK_TO_RAW = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT",
    "float": "FLOAT", "double": "FLOAT", "string": "NVARCHAR", "boolean": "BIT",
    "binary": "VARBINARY", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME",
    "date": "DATE",
}


def normalize_type_expr(raw: F.Column) -> F.Column:
    """Column expression: raw type name → normalised type (first matching rule)."""
    up = F.upper(raw)
    expr = F.lit("unknown")
    for name, needles in reversed(TYPE_RULES):
        cond = None
        for n in needles:
            c = up.contains(n)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(name)).otherwise(expr)
    return expr


def table_alias(table_name: str) -> str:
    """Capitals of each ``_``-separated part, or its first letter upper-cased."""
    parts = []
    for part in table_name.split("_"):
        caps = "".join(c for c in part if c.isupper())
        parts.append(caps if caps else part[:1].upper())
    return "_".join(parts)


def _raw_type(dt: T.DataType) -> str:
    s = dt.simpleString()
    if s.startswith("decimal"):
        return "DECIMAL"
    return _SPARK_TO_RAW.get(s, s.upper())


def schema_catalog(spark: SparkSession, tables: dict[str, DataFrame],
                   geo_columns: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per (table, column) with alias, normalised type and retrieve flag.

    ``geo_columns`` marks WKT text columns that hold geometries (Spark has no
    enabled geometry type), so they get type ``geometry`` and ``retrieve=False``.
    """
    geo_columns = geo_columns or {}
    rows = []
    for tname, df in tables.items():
        for f in df.schema.fields:
            raw = "GEOMETRY" if f.name in geo_columns.get(tname, []) else _raw_type(f.dataType)
            rows.append((tname, table_alias(tname), f.name, raw))
    cat = spark.createDataFrame(rows, "table string, alias string, column string, raw_type string")
    norm = normalize_type_expr(F.col("raw_type"))
    return (cat.withColumn("type", norm)
               .withColumn("retrieve", ~F.col("type").isin(*GEO_TYPES))
               .drop("raw_type"))


def catalog_select_list(catalog_rows: list, selected_aliases: list[str] | None = None,
                        state_alias: str | None = None,
                        states: list[tuple[str, str]] | None = None) -> list[F.Column]:
    """Select list from catalogue rows (``catalog.collect()`` — one row per column).

    Each kept column becomes ``{ALIAS}_{col}``; the value table (``state_alias``)
    is expanded once per state as ``{ALIAS}_{col}_{suffix}`` read from the
    per-state alias; geometry columns pass through as their WKT text.
    """
    out = []
    for r in catalog_rows:
        if selected_aliases is not None and r["alias"] not in selected_aliases:
            continue
        if not r["retrieve"]:
            continue
        if state_alias is not None and r["alias"] == state_alias:
            for st_alias, suffix in states or []:
                out.append(F.col(f"{st_alias}.{r['column']}").alias(
                    f"{r['alias']}_{r['column']}_{suffix}"))
        else:
            out.append(F.col(f"{r['alias']}.{r['column']}").alias(f"{r['alias']}_{r['column']}"))
    return out
