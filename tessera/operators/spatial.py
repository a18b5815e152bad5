"""Spatial joins: the (point, polygon) pairs and the "inside any zone" flag (J4),
with no cartesian product.  Counts by category (J3 + J5) are in ``cell_counts``.

Multi-level grid: a polygon with bounding-box extent e goes to the level L
whose cell size ``s0 * 2**L`` is at least e, so it covers at most 2 × 2 cells
there; a point is keyed once per level in use (a handful).  The equi-join on
(level, cell) yields candidate pairs, the bounding box prunes them, and the
exact even-odd ray-casting test decides, with numpy over Arrow batches.  Large
polygons therefore cost 4 cells, not thousands, and AQE's skew-join splitting
handles a crowded cell.

Candidates carry the number of their polygon; the edges are broadcast in parts of
a checked size, and a polygon table too large for one part is tested part by part
in the same way.  Polygons without text or edges hold no point; polygons with the
same id are polygons of their own; without polygons nothing is inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from ..functions.geometry import polygon_bbox, ring_edges, wkt_rings


EDGE_COLS = ["__ex1", "__ey1", "__ex2", "__ey2"]


def prepare_polygons(polys: DataFrame, id_col: str, wkt_col: str) -> DataFrame:
    """(id, edges, bbox) per polygon — parsed once, before any join.  Edges are
    also kept as four flat coordinate arrays for the vectorised exact test."""
    rings = wkt_rings(wkt_col)
    out = (polys.select(id_col, rings.alias("__rings"))
                .select(id_col, ring_edges(F.col("__rings")).alias("edges"),
                        polygon_bbox(F.col("__rings")).alias("bbox")))
    def field(k):
        return lambda e: e[k]
    return out.withColumns({c: F.transform("edges", field(k))
                            for c, k in zip(EDGE_COLS, ["x1", "y1", "x2", "y2"])})


#: Edges that are broadcast at once (four doubles each).
PART_EDGES = 4_000_000


def pack_polygons(prepared: DataFrame):
    """Broadcast numbers, offsets and edge coordinates of one bounded part of the polygons."""
    t = prepared.select("__pid", *EDGE_COLS).orderBy("__pid").toArrow().combine_chunks()
    lists = [t.column(c).combine_chunks() for c in EDGE_COLS]
    offs = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    coords = [x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in lists]
    return prepared.sparkSession.sparkContext.broadcast((t.column("__pid").to_numpy(), offs, coords))


def _even_odd(px, py, row, x1, y1, x2, y2, n):
    """Per-row inside flags from per-edge arrays (``row`` = owning row index)."""
    ex, ey = px[row], py[row]
    cross = (x2 - x1) * (ey - y1) - (y2 - y1) * (ex - x1)
    on_edge = ((cross == 0) & (ex >= np.minimum(x1, x2)) & (ex <= np.maximum(x1, x2))
               & (ey >= np.minimum(y1, y2)) & (ey <= np.maximum(y1, y2)))
    straddle = (y1 > ey) != (y2 > ey)
    with np.errstate(divide="ignore", invalid="ignore"):
        x_at = np.where(straddle, (x2 - x1) * (ey - y1) / np.where(straddle, y2 - y1, 1.0) + x1, 0.0)
    crosses = straddle & (ex < x_at)
    n_cross = np.bincount(row, weights=crosses, minlength=n)
    n_edge = np.bincount(row, weights=on_edge, minlength=n)
    return (n_cross.astype(np.int64) % 2 == 1) & (n_edge == 0)


def exact_inside(cand: DataFrame, x_col: str, y_col: str, packed, keep: list[str] | None = None) -> DataFrame:
    """Candidate rows whose point is strictly inside their polygon (``__pid``); only the ``keep`` columns if given."""
    keep = keep or cand.columns

    def run(batches):
        numbers, offs, (cx1, cy1, cx2, cy2) = packed.value
        for b in batches:
            n = b.num_rows
            px = b.column(x_col).to_numpy(zero_copy_only=False).astype(float)
            py = b.column(y_col).to_numpy(zero_copy_only=False).astype(float)
            pos = np.searchsorted(numbers, b.column("__pid").to_numpy(zero_copy_only=False))
            start, cnt = offs[pos], offs[pos + 1] - offs[pos]
            row = np.repeat(np.arange(n), cnt)
            first = np.repeat(start - np.concatenate([[0], np.cumsum(cnt)[:-1]]), cnt) if n else start
            e = first + np.arange(len(row))
            inside = _even_odd(px, py, row, cx1[e], cy1[e], cx2[e], cy2[e], n)
            yield b.select(keep).filter(pa.array(inside, type=pa.bool_()))
    # Only the hits travel back to the JVM.
    ship_package(cand.sparkSession)
    return cand.mapInArrow(run, cand.select(*keep).schema)


def base_cell_size(prepared: DataFrame) -> float:
    """Median polygon extent (approximate quantile; one number to the driver)."""
    ext = F.greatest(F.col("bbox.maxx") - F.col("bbox.minx"), F.col("bbox.maxy") - F.col("bbox.miny"))
    v = prepared.agg(F.approx_percentile(ext, 0.5, 1000)).first()[0]
    return float(v) if v and v > 0 else 1.0


def _polygon_cells(prepared: DataFrame, s0: float) -> DataFrame:
    ext = F.greatest(F.col("bbox.maxx") - F.col("bbox.minx"), F.col("bbox.maxy") - F.col("bbox.miny"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(ext, F.lit(1e-300)) / F.lit(s0)))).cast("int")
    size = F.lit(s0) * F.pow(F.lit(2.0), F.col("__lvl"))
    out = prepared.withColumn("__lvl", level).withColumn("__size", size)
    cx = F.sequence(F.floor(F.col("bbox.minx") / F.col("__size")), F.floor(F.col("bbox.maxx") / F.col("__size")))
    cy = F.sequence(F.floor(F.col("bbox.miny") / F.col("__size")), F.floor(F.col("bbox.maxy") / F.col("__size")))
    return (out.withColumn("__cx", F.explode(cx)).withColumn("__cy", F.explode(cy))
               .drop("__size"))


def points_in_polygons(points: DataFrame, x_col: str, y_col: str, polys: DataFrame,
                       poly_id: str, wkt_col: str, s0: float | None = None) -> DataFrame:
    """All (point row, polygon id) pairs with the point strictly inside the polygon."""
    prepared = prepare_polygons(polys.where(F.col(wkt_col).isNotNull()), poly_id, wkt_col)
    # Written once: the numbers given here stay when a later task is run again.
    prepared = cut_lineage(prepared.where(F.size(EDGE_COLS[0]) > 0).withColumn("__pid", F.monotonically_increasing_id()))
    total = prepared.agg(F.sum(F.size(EDGE_COLS[0]))).first()[0] or 0
    px, py = F.col(x_col), F.col(y_col)
    real = points.where(px.isNotNull() & py.isNotNull() & ~F.isnan(px.cast("double")) & ~F.isnan(py.cast("double")))
    if not total:
        return real.join(prepared.select(poly_id), F.lit(False), "inner")
    s0 = s0 or base_cell_size(prepared)
    parts = -(-total // PART_EDGES)
    out = None
    for part in range(parts):
        mine = prepared.where(F.pmod(F.xxhash64("__pid"), F.lit(parts)) == part) if parts > 1 else prepared
        cells = _polygon_cells(mine, s0).drop("edges", *EDGE_COLS)
        levels = sorted(r[0] for r in cells.select("__lvl").distinct().collect())
        if not levels:
            continue
        keyed = real.withColumn(
            "__pk", F.explode(F.array(*[
                F.struct(F.lit(L).alias("l"),
                         F.floor(px / F.lit(s0 * 2.0 ** L)).alias("cx"),
                         F.floor(py / F.lit(s0 * 2.0 ** L)).alias("cy"))
                for L in levels])))
        keyed = (keyed.withColumn("__lvl", F.col("__pk.l")).withColumn("__cx", F.col("__pk.cx"))
                      .withColumn("__cy", F.col("__pk.cy")).drop("__pk"))
        cand = keyed.join(cells, on=["__lvl", "__cx", "__cy"], how="inner")
        in_box = cand.where((px > F.col("bbox.minx")) & (px < F.col("bbox.maxx"))
                            & (py > F.col("bbox.miny")) & (py < F.col("bbox.maxy"))).drop("__lvl", "__cx", "__cy", "bbox")
        hits = exact_inside(in_box, x_col, y_col, pack_polygons(mine)).drop("__pid")
        out = hits if out is None else out.unionByName(hits)
    return out


def inside_any(points: DataFrame, point_id: str, x_col: str, y_col: str, zones: DataFrame,
               zone_id: str, wkt_col: str, out_col: str = "in_zone") -> DataFrame:
    """1 when the point lies strictly inside at least one zone, else 0.

    No (point, zone) pair is formed for a point that lies in an inside cell of some
    zone's cover (``cell_counts``), and zones of one text are one shape.  Zones with
    edges that are not finite have no cover and are joined to the points pair by pair.
    """
    from .cell_counts import ids_inside_any
    shapes = zones.where(F.col(wkt_col).isNotNull()).select(F.col(wkt_col).alias("__shape")).distinct()
    prepared = prepare_polygons(shapes, "__shape", "__shape")
    # A null or NaN is not below the limit, and a sum with one is one.
    odd = F.exists("edges", lambda e: ~F.coalesce(sum((F.abs(e[k]) for k in ("y1", "x2", "y2")), F.abs(e["x1"])) < 1e300, F.lit(False)))
    # Written once: the numbers given here stay when a later task is run again.
    prepared = cut_lineage(prepared.where(F.size(EDGE_COLS[0]) > 0).withColumn("__odd", odd)
                           .withColumn("__pid", F.monotonically_increasing_id()))
    found = [ids_inside_any(points, point_id, x_col, y_col, prepared.where("not __odd"))]
    strange = prepared.where("__odd").select("__shape")
    if not strange.isEmpty():
        found.append(points_in_polygons(points.select(F.col(point_id).alias("__id"), x_col, y_col), x_col, y_col,
                                        strange.select("__shape", F.col("__shape").alias("__text")), "__shape", "__text").select("__id"))
    hits = points.select(F.col(point_id).alias("__id")).limit(0)
    for f in found:
        hits = hits if f is None else hits.unionByName(f)
    hits = hits.distinct().select(F.col("__id").alias(point_id), F.lit(1).alias(out_col))
    return (points.join(hits, on=point_id, how="left")
                  .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0))))
