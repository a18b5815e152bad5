"""Registered spatial queries.

Parcels: one per customer, a diamond |x−cx| + |y−cy| < r around a centre
derived from the key (every 50th parcel large, every 7th with a hole of
radius r/2).  Points of interest: events at (value / 5, k of props) by
``event_type``.  Zones: one square per supplier.  Radii end in .3333 / .1111
so no point lies on a boundary, and the oracle's closed-form tests agree with
ray casting exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as G
from ..operators.cell_counts import category_counts_in_polygons
from ..operators.relational import distinct_categories
from ..session import load
from .queries_relational import _EVENT_TYPES
from .registry import query


def _s(c):
    return c.cast("string")


def _diamond(cx, cy, r):
    pts = [(cx + r, cy), (cx, cy + r), (cx - r, cy), (cx, cy - r), (cx + r, cy)]
    return F.concat_ws(", ", *[F.concat_ws(" ", _s(x), _s(y)) for x, y in pts])


def parcels(spark, d):
    c = load(spark, d, "customer")
    k = F.col("c_custkey")
    cx = F.pmod(k * 37, F.lit(100)).cast("double")
    cy = F.pmod(k * 61, F.lit(100)).cast("double")
    r = F.lit(3.3333) + F.pmod(k, F.lit(5)).cast("double") + F.when(k % 50 == 0, 37.0).otherwise(0.0)
    shell = F.concat(F.lit("("), _diamond(cx, cy, r), F.lit(")"))
    hole = F.concat(F.lit(", ("), _diamond(cx, cy, r / 2.0), F.lit(")"))
    wkt = F.concat(F.lit("POLYGON ("), shell, F.when(k % 7 == 0, hole).otherwise(F.lit("")), F.lit(")"))
    return c.select(k.alias("parcel_id"), cx.alias("cx"), cy.alias("cy"), wkt.alias("isodistance"))


def pois(spark, d):
    e = load(spark, d, "events")
    return e.select((F.col("value") / 5.0).alias("x"),
                    F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("y"),
                    "event_type")


def zones(spark, d):
    s = load(spark, d, "supplier")
    k = F.col("s_suppkey")
    zx = F.pmod(k * 17, F.lit(100)).cast("double") + 0.25
    zy = F.pmod(k * 29, F.lit(100)).cast("double") + 0.25
    h = F.lit(2.1111) + F.pmod(k, F.lit(3)).cast("double") + F.when(k % 40 == 0, 20.0).otherwise(0.0)
    pts = [(zx - h, zy - h), (zx + h, zy - h), (zx + h, zy + h), (zx - h, zy + h), (zx - h, zy - h)]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", _s(x), _s(y)) for x, y in pts])
    return s.select(k.alias("zone_id"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("polygon"))


_SPATIAL_SQL = r"""
WITH p AS (SELECT c_custkey AS parcel_id, CAST((c_custkey * 37) % 100 AS DOUBLE) AS cx,
                  CAST((c_custkey * 61) % 100 AS DOUBLE) AS cy,
                  3.3333 + CAST(c_custkey % 5 AS DOUBLE) + CASE WHEN c_custkey % 50 = 0 THEN 37.0 ELSE 0.0 END AS r,
                  c_custkey % 7 = 0 AS has_hole FROM customer),
e AS (SELECT value / 5.0 AS x, CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS y, event_type FROM events),
z AS (SELECT CAST((s_suppkey * 17) % 100 AS DOUBLE) + 0.25 AS zx, CAST((s_suppkey * 29) % 100 AS DOUBLE) + 0.25 AS zy,
             2.1111 + CAST(s_suppkey % 3 AS DOUBLE) + CASE WHEN s_suppkey % 40 = 0 THEN 20.0 ELSE 0.0 END AS h FROM supplier)
"""


@query("point_in_polygon_counts", "J3,J5,F8,A4", oracle=_SPATIAL_SQL + """
, hits AS (SELECT p.parcel_id, e.event_type FROM p JOIN e
           ON abs(e.x - p.cx) + abs(e.y - p.cy) < p.r
          AND NOT (p.has_hole AND abs(e.x - p.cx) + abs(e.y - p.cy) < p.r / 2))
SELECT p.parcel_id, """ + ", ".join(
    f"CAST(count(CASE WHEN h.event_type = '{t}' THEN 1 END) AS BIGINT) AS POI_{t}_count"
    for t in _EVENT_TYPES) + """
FROM p LEFT JOIN hits h USING (parcel_id) GROUP BY p.parcel_id""")
def q_point_in_polygon_counts(spark, d):
    pts = pois(spark, d)
    cats = distinct_categories(pts, "event_type")
    return category_counts_in_polygons(pts, "x", "y", "event_type", parcels(spark, d),
                                         "parcel_id", "isodistance", cats)


@query("inside_any_zone", "J4,F8,F9", oracle=_SPATIAL_SQL + """
SELECT parcel_id, CASE WHEN EXISTS (SELECT 1 FROM z WHERE abs(p.cx - z.zx) < z.h AND abs(p.cy - z.zy) < z.h)
                       THEN 1 ELSE 0 END AS in_zone FROM p""")
def q_inside_any_zone(spark, d):
    p = parcels(spark, d).select("parcel_id", "cx", "cy")
    out = G.inside_any(p, "parcel_id", "cx", "cy", zones(spark, d), "zone_id", "polygon")
    return out.select("parcel_id", "in_zone")
