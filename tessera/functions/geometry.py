"""F8: WKT polygons and point-in-polygon as native column expressions.

A polygon's WKT text becomes an array of edges (x1, y1, x2, y2) over all of
its rings (shell, holes, parts of a multipolygon).  Even-odd ray casting over
all edges gives "inside the shell and outside every hole"; points on an edge
are not contained (the ``STContains`` convention).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RING = r"\(([^()]*)\)"


def wkt_rings(wkt: Column | str) -> Column:
    """array<array<struct<x double, y double>>>: every innermost coordinate list."""
    wkt = F.col(wkt) if isinstance(wkt, str) else wkt
    rings = F.regexp_extract_all(wkt, F.lit(_RING), 1)

    def point(p):
        xy = F.split(F.trim(p), r"\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))
    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))


def ring_edges(rings: Column) -> Column:
    """array<struct<x1,y1,x2,y2>>: consecutive vertex pairs of every ring, with
    the closing edge added when a ring is not closed."""
    def edges_of(r):
        n = F.size(r)
        closed = (r[0]["x"] == F.element_at(r, -1)["x"]) & (r[0]["y"] == F.element_at(r, -1)["y"])
        pts = F.when(closed, r).otherwise(F.concat(r, F.array(r[0])))
        m = F.size(pts)
        return F.zip_with(F.slice(pts, 1, m - 1), F.slice(pts, 2, m - 1),
                          lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"),
                                                b["x"].alias("x2"), b["y"].alias("y2")))
    return F.flatten(F.transform(rings, edges_of))


def polygon_bbox(rings: Column) -> Column:
    pts = F.flatten(rings)
    xs = F.transform(pts, lambda p: p["x"])
    ys = F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def point_in_polygon(px: Column, py: Column, edges: Column) -> Column:
    """Strictly inside (even-odd rule); on-edge points are outside."""
    def on_edge(e):
        cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        return ((cross == 0)
                & (px >= F.least(e["x1"], e["x2"])) & (px <= F.greatest(e["x1"], e["x2"]))
                & (py >= F.least(e["y1"], e["y2"])) & (py <= F.greatest(e["y1"], e["y2"])))

    def crosses(e):
        straddles = (e["y1"] > py) != (e["y2"] > py)
        x_at = F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return straddles & (px < x_at)
    n_cross = F.size(F.filter(edges, crosses))
    return ~F.exists(edges, on_edge) & (n_cross % 2 == 1)


def point_wkt(x: Column, y: Column) -> Column:
    return F.format_string("POINT (%s %s)", x.cast("string"), y.cast("string"))


def parse_point(wkt: Column | str) -> tuple[Column, Column]:
    wkt = F.col(wkt) if isinstance(wkt, str) else wkt
    inner = F.regexp_extract(wkt, r"\(\s*([^()]*)\)", 1)
    xy = F.split(F.trim(inner), r"\s+")
    return xy[0].cast("double"), xy[1].cast("double")
