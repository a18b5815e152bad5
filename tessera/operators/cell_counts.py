"""Points of each category inside polygons (J3 + J5) by tiles of points, and whether a point lies in any (J4) by cell covers.

*Tiles.*  The points are sorted by x and cut into tiles of a bounded number of points.
A tile is one row: its points in the order of a grid of cells that hold a few points
each, row by row.  Every polygon goes to the tiles that its box meets, and the polygons
of a tile are dealt to groups of a bounded number of edges, each with a copy of the tile.

*Counting.*  Rows of cells run along the longer side of a tile, so an edge meets few of
them.  In a row, an edge touches one range of cells.  Between the ranges
of a polygon's edges no edge lies, so all cells there are inside or all outside, by the
number of edges to their left, and running totals of the row count them.  The points of
touched cells are compared with the edges of their row; those that lie within a small
part of a cell of an edge, where rounding could decide, meet the exact even-odd test.

So the work follows the boundary of the polygons, not the points inside them, and only
counts and the few points near an edge leave a group.  The edges for the exact test are
broadcast in parts of a checked size.  Joins with the polygons' rows are merge joins
whatever a shuffle measures: the driver never holds one as a hash table.

*Cover* (J4).  Cells are squares whose side is a power of two.  A polygon starts from
the at most 2 x 2 cells of its own size.  A cell that no edge touches is inside or
outside as a whole; a touched cell is cut into four, down to the level where a cell
holds a few points (or at most ``ANY_DEPTH`` times).  A point in an inside cell is done,
and only the others meet the polygons of their boundary cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from . import spatial
from .relational import count_names

#: Points that a cell at the end of a cover holds on average.
POINTS_PER_CELL = 2.0
#: A cover is cut at most this often: a point has to meet an inside cell of one polygon only.
ANY_DEPTH = 5
#: (cell, edge) pairs that are tested at once.
PAIRS = 1_000_000


def _touches(cx: np.ndarray, cy: np.ndarray, size: np.ndarray, e: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether an edge may touch a closed cell; rounding only ever adds a cell."""
    x1, y1, x2, y2 = e
    left, low = cx * size, cy * size
    right, high = left + size, low + size
    near = ((np.maximum(x1, x2) >= left) & (np.minimum(x1, x2) <= right)
            & (np.maximum(y1, y2) >= low) & (np.minimum(y1, y2) <= high))
    dx, dy = x2 - x1, y2 - y1
    # The side of the edge's line on which the four corners lie.
    sides = np.stack([dx * (b - y1) - dy * (a - x1) for a in (left, right) for b in (low, high)])
    scale = np.abs(x1) + np.abs(x2) + np.abs(y1) + np.abs(y2) + np.abs(left) + np.abs(low) + size
    slack = 1e-12 * (np.abs(dx) + np.abs(dy)) * scale
    return near & (sides.min(axis=0) <= slack) & (sides.max(axis=0) >= -slack)


def _centres_inside(poly: np.ndarray, x: np.ndarray, y: np.ndarray, offs: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    """Even-odd test of one point for each entry of ``poly``, none of which lies near an edge."""
    out = np.zeros(len(poly), bool)
    count = offs[poly + 1] - offs[poly]
    for piece in _pieces(count):
        row = np.repeat(piece, count[piece])
        e = _edge_numbers(offs[poly[piece]], count[piece])
        out[piece] = spatial._even_odd(x, y, row, *(c[e] for c in edges), len(poly))[piece]
    return out


def _pieces(count: np.ndarray, most: int = PAIRS) -> Iterator[np.ndarray]:
    """Consecutive entries with at most ``most`` pairs together (one at least)."""
    total, at = np.cumsum(count), 0
    while at < len(count):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield np.arange(at, end)
        at = end


def _edge_numbers(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] times, then the same for the next entry."""
    start = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    return np.arange(int(count.sum())) + np.repeat(first - start, count)


def cover(boxes: np.ndarray, offs: np.ndarray, edges: tuple[np.ndarray, ...], top: np.ndarray,
          bottom: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of polygons: (polygon, level, cx, cy, inside); not inside means boundary.

    ``boxes`` has minx, miny, maxx, maxy by polygon; polygon i has the edges offs[i] to
    offs[i + 1]; its cells have sides of 2^top[i] down to 2^bottom[i].
    """
    lows, highs = (np.floor(np.ldexp(b, -top[:, None])).astype(np.int64) for b in (boxes[:, :2], boxes[:, 2:]))
    wide = highs - lows + 1
    poly = np.repeat(np.arange(len(boxes)), wide[:, 0] * wide[:, 1])
    k = _edge_numbers(np.zeros(len(boxes), np.int64), wide[:, 0] * wide[:, 1])
    cx, cy, level = lows[poly, 0] + k % wide[poly, 0], lows[poly, 1] + k // wide[poly, 0], top[poly].astype(np.int64)
    count = offs[poly + 1] - offs[poly]
    cell, edge = np.repeat(np.arange(len(poly)), count), _edge_numbers(offs[poly], count)
    done = []
    while len(poly):
        size = np.ldexp(1.0, level)
        hit = np.zeros(len(cell), bool)
        for at in range(0, len(cell), PAIRS):
            c, e = cell[at:at + PAIRS], edge[at:at + PAIRS]
            hit[at:at + PAIRS] = _touches(cx[c], cy[c], size[c], tuple(v[e] for v in edges))
        cell, edge = cell[hit], edge[hit]
        touched = np.zeros(len(poly), bool)
        touched[cell] = True
        free = np.flatnonzero(~touched)
        free = free[_centres_inside(poly[free], (cx[free] + 0.5) * size[free], (cy[free] + 0.5) * size[free], offs, edges)]
        last = np.flatnonzero(touched & (level <= bottom[poly]))
        done += [(poly[i], level[i], cx[i], cy[i], np.full(len(i), i is free)) for i in (free, last)]
        # The four parts of every other touched cell, with the edges that touch the whole.
        cut = np.flatnonzero(touched & (level > bottom[poly]))
        place = np.full(len(poly), -1)
        place[cut] = np.arange(len(cut))
        going = place[cell] >= 0
        cell, edge = place[cell[going]], edge[going]
        quarter = np.arange(4)
        cell, edge = (cell[:, None] * 4 + quarter).ravel(), np.repeat(edge, 4)
        poly, level = np.repeat(poly[cut], 4), np.repeat(level[cut] - 1, 4)
        cx, cy = ((2 * v[cut][:, None] + q).ravel() for v, q in ((cx, quarter % 2), (cy, quarter // 2)))
    if not done:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(c) for c in zip(*done))


class Cells:
    """The cells of a bounded area as one number each, whatever their level."""

    def __init__(self, x0: float, y0: float, x1: float, y1: float, finest: int):
        self.box, self.finest = (x0, y0, x1, y1), finest

    def _first(self, level: int) -> tuple[int, int, int]:
        """One before the first cell of the area in x and y, and the cells of a column with one more at each end."""
        x0, y0, _, y1 = (math.floor(math.ldexp(v, -level)) for v in self.box)
        return x0 - 1, y0 - 1, y1 - y0 + 3

    def number(self, level: int, cx, cy):
        """For Spark columns and numpy arrays alike."""
        x0, y0, wide = self._first(level)
        return ((cx - x0) * wide + (cy - y0)) * 64 + (level - self.finest)

    def of_point(self, x: str, y: str, level: int):
        return self.number(level, _cell(x, level), _cell(y, level))


def _cover_rows(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                lists = [b.column(c) for c in spatial.EDGE_COLS]
                offs = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                edges = tuple(v.flatten().to_numpy(zero_copy_only=False).astype(float) for v in lists)
                box = b.column("bbox")
                boxes = np.stack([box.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4)], axis=1)
                top, bottom = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__top", "__bottom"))
                poly, level, cx, cy, inside = cover(boxes, offs, edges, top, bottom)
                number = np.zeros(len(poly), np.int64)
                for k in np.unique(level).tolist():
                    mine = level == k
                    number[mine] = cells.number(k, cx[mine], cy[mine])
                yield pa.RecordBatch.from_arrays(
                    [b.column("__pid").take(pa.array(poly)), pa.array(level, pa.int32()), pa.array(number), pa.array(inside)],
                    ["__pid", "__lvl", "__cell", "__inside"])
    return run


def _cell(x: str, level: int):
    return F.floor(F.col(x) * F.lit(math.ldexp(1.0, -level)))


def polygon_cover(prepared: DataFrame, cells: Cells, depth: int) -> DataFrame:
    """(__pid, __lvl, __cell, __inside) of the polygons, down to the finest cells or ``depth`` cuts of their own size."""
    ext = F.greatest(F.col("bbox.maxx") - F.col("bbox.minx"), F.col("bbox.maxy") - F.col("bbox.miny"))
    finest = F.lit(cells.finest).cast("long")
    # The exponent is only a start size: rounding of the logarithm may add a row of cells, never lose one.
    top = F.greatest(F.ceil(F.log2(F.greatest(ext, F.lit(1e-300)))).cast("long"), finest)
    rows = prepared.select("__pid", "bbox", *spatial.EDGE_COLS, top.alias("__top")).withColumn(
        "__bottom", F.greatest(F.col("__top") - depth, finest))
    ship_package(prepared.sparkSession)
    return rows.mapInArrow(_cover_rows(cells), "__pid long, __lvl int, __cell long, __inside boolean")


#: Points of a tile, edges and (if that gives tasks enough) polygons that meet a copy of it.
TILE_POINTS, GROUP_EDGES, GROUP_POLYGONS = 500_000, 1_000_000, 500
#: Points nearer to an edge than this part of a cell meet the exact test.
NEAR_PART = 1 / 64
#: (row, edge) or (point, edge) pairs of a tile that are worked on at once: few enough for a processor's cache.
TILE_PAIRS = 100_000
_TILE = "x0 double, x1 double, y0 double, y1 double, turned boolean, rows long, cols long, starts binary, x binary, y binary, c binary"


def pack_tile(x: np.ndarray, y: np.ndarray, c: np.ndarray, per_cell: float) -> dict:
    """Points in the order of the cells of a grid, row by row, and where each cell's points start.

    ``turned`` tells that x and y have changed places, so that rows run along the longer side.
    """
    turned = bool(x.max() - x.min() < y.max() - y.min())
    x, y = (y, x) if turned else (x, y)
    box = [float(v) for v in (x.min(), x.max(), y.min(), y.max())]
    wide, high = box[1] - box[0], box[3] - box[2]
    most = max(1, int(len(x) / per_cell))
    side = math.sqrt(wide * high / most)
    cols = min(max(1, round(wide / side)), most) if side else most if wide else 1
    rows = max(1, most // cols) if high else 1
    cell = _row_of(y, box[2:], rows) * cols + _row_of(x, box[:2], cols)
    order = np.argsort(cell, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=rows * cols))])
    return dict(zip(("x0", "x1", "y0", "y1"), box), turned=turned, rows=rows, cols=cols, starts=starts, x=x[order], y=y[order], c=c[order])


def _row_of(v: np.ndarray, ends: Sequence[float], n: int) -> np.ndarray:
    """The row (or column) of values; never falls when they grow, and the first and last take all beyond."""
    size = (ends[1] - ends[0]) / n or 1.0
    return np.clip(np.floor((v - ends[0]) / size), 0, n - 1).astype(np.int64)


def _tile_rows(most: int, per_cell: float):
    kinds = {"starts": np.int64, "x": np.float64, "y": np.float64, "c": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile() -> pa.RecordBatch:
            t = pack_tile(*(np.concatenate(v) for v in zip(*held)), per_cell)
            return pa.RecordBatch.from_pylist([{k: v.astype(kinds[k]).tobytes() if k in kinds else v for k, v in t.items()}], schema)
        schema = pa.schema([(n, {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t])
                            for n, t in (f.split() for f in _TILE.split(", "))])
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, most - n)
                held.append([piece.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == most:
                    yield tile()
                    held, n = [], 0
        if n:
            yield tile()
    return run


def count_in_tile(tile: dict, offs: np.ndarray, edges: tuple[np.ndarray, ...], n_kinds: int) -> tuple[np.ndarray, ...]:
    """(counts by polygon and kind, polygons and points that are near an edge and not counted).

    Polygon i has the edges offs[i] to offs[i + 1], whose rings are closed.
    """
    px, py, pc, starts, rows, cols = (tile[k] for k in ("x", "y", "c", "starts", "rows", "cols"))
    xs, ys = (tile["x0"], tile["x1"]), (tile["y0"], tile["y1"])
    wide, high = (xs[1] - xs[0]) / cols or 1.0, (ys[1] - ys[0]) / rows or 1.0
    cell = np.repeat(np.arange(rows * cols), np.diff(starts))
    upto = [np.concatenate([[0], np.cumsum(np.bincount(cell[pc == k], minlength=rows * cols))]) for k in range(n_kinds)]
    ex1, ey1, ex2, ey2 = [edges[i] for i in ((1, 0, 3, 2) if tile["turned"] else (0, 1, 2, 3))]
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    low, top = np.minimum(ey1, ey2), np.maximum(ey1, ey2)
    left, right = np.minimum(ex1, ex2), np.maximum(ex1, ex2)
    # Far above any rounding of the numbers at hand.
    tiny = 1e-13 * (np.abs(ex1) + np.abs(ex2) + np.abs(ey1) + np.abs(ey2) + abs(xs[0]) + abs(xs[1]) + abs(ys[0]) + abs(ys[1]))
    with np.errstate(all="ignore"):
        slope = (ex2 - ex1) / (ey2 - ey1)
    flat = ~(np.abs(slope) < 1e6)
    # The line of an edge: x = base + (y - ey1) * slope, and how near to it the exact test decides.
    slope, base = np.where(flat, 0.0, slope), np.where(flat, left / 2 + right / 2, ex1)
    near = wide * NEAR_PART + (100 + np.abs(slope)) * tiny
    reach = near + np.where(flat, right / 2 - left / 2, 0.0)
    under, over = low - tiny, top + tiny
    meets = (over >= ys[0]) & (under <= ys[1])
    first, last = _row_of(under, ys, rows), _row_of(over, ys, rows)
    spans = np.where(meets, last - first + 1, 0)
    counts = np.zeros((len(offs) - 1) * n_kinds)
    found = []
    total = np.concatenate([[0], np.cumsum(spans)])
    for some in _pieces(total[offs[1:]] - total[offs[:-1]], TILE_PAIRS):
        mine = np.arange(offs[some[0]], offs[some[-1] + 1])
        edge = np.repeat(mine, spans[mine])
        if not len(edge):
            continue
        row = _edge_numbers(first[mine], spans[mine])
        # The x range of the edge in its row.
        at = ys[0] + row * high
        slack = 1e-6 * high + 1e-11 * (abs(ys[0]) + abs(ys[1]))
        lo_y, hi_y = low[edge], top[edge]
        # The first and the last row take all that lies beyond.
        ends = [np.where(row == 0, lo_y, np.minimum(np.maximum(at - slack, lo_y), hi_y)),
                np.where(row == rows - 1, hi_y, np.maximum(np.minimum(at + (high + slack), hi_y), lo_y))]
        ends = [base[edge] + (v - ey1[edge]) * slope[edge] for v in ends]
        lo, hi = np.minimum(*ends) - reach[edge], np.maximum(*ends) + reach[edge]
        a = np.where(lo > xs[1], cols, np.where(lo < xs[0], -1, _row_of(lo, xs, cols)))
        b = np.where(hi < xs[0], -1, np.where(hi > xs[1], cols, _row_of(hi, xs, cols)))
        middle = at + high / 2
        odd = (lo_y <= middle) & (middle < hi_y)
        group = owner[edge] * rows + row
        order = np.argsort(group * (cols + 2) + a)
        a, b, odd, group, edge, row = a[order], b[order], odd[order], group[order], edge[order], row[order]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        rank = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(group)))
        done = np.maximum.accumulate(b + rank * (cols + 2)) - rank * (cols + 2)
        # Between this range and the next one of the row no edge lies.
        passed = np.cumsum(odd)
        passed = passed - (passed - odd)[begin][rank]
        gap_to = np.append(a[1:], 0) - 1
        gap = np.flatnonzero(~np.append(new[1:], True) & (passed % 2 == 1))
        gap = gap[np.maximum(done[gap] + 1, 0) <= np.minimum(gap_to[gap], cols - 1)]
        left_cell, after = row[gap] * cols + np.maximum(done[gap] + 1, 0), row[gap] * cols + np.minimum(gap_to[gap], cols - 1) + 1
        for k in range(n_kinds):
            counts[k::n_kinds] += np.bincount(owner[edge[gap]], upto[k][after] - upto[k][left_cell], len(offs) - 1)
        # The points of the touched cells, each cell once.
        before = np.append(-1, done[:-1])
        ta, tb = np.maximum(np.where(new, a, np.maximum(a, before + 1)), 0), np.minimum(b, cols - 1)
        touched = np.flatnonzero(ta <= tb)
        p0 = starts[row[touched] * cols + ta[touched]]
        n_points = starts[row[touched] * cols + tb[touched] + 1] - p0
        item = np.repeat(touched, n_points)
        point = _edge_numbers(p0, n_points)
        for part in _pieces(size[rank[item]], TILE_PAIRS):
            mates = size[rank[item[part]]]
            e = edge[_edge_numbers(begin[rank[item[part]]], mates)]
            where = np.repeat(point[part], mates)
            y = py[where]
            away = base[e] + (y - ey1[e]) * slope[e] - px[where]
            begins = np.concatenate([[0], np.cumsum(mates)[:-1]])
            unsure = np.logical_or.reduceat((y >= under[e]) & (y <= over[e]) & ~(np.abs(away) > reach[e]), begins)
            inside = np.logical_xor.reduceat((y >= low[e]) & (y < top[e]) & (away > 0), begins)
            sure = part[inside & ~unsure]
            counts += np.bincount(owner[edge[item[sure]]] * n_kinds + pc[point[sure]], minlength=len(counts))
            found.append((owner[edge[item[part[unsure]]]], point[part[unsure]]))
    found = [np.concatenate(v) for v in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
    return counts.astype(np.int64).reshape(-1, n_kinds), *found


def _count_groups(n_kinds: int):
    """Polygons of a tile (left) meet it (right): a row of counts for a polygon, and a row for a point near its edges."""
    def run(polygons: pa.Table, tiles: pa.Table) -> pa.Table:
        names = ["__pid", "__x", "__y", "__c", *[f"__n{k}" for k in range(n_kinds)]]
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), *[pa.int64()] * n_kinds]
        empty = pa.schema(list(zip(names, kinds))).empty_table()
        if not polygons.num_rows or not tiles.num_rows:
            return empty
        polygons = polygons.combine_chunks()
        lists = [polygons.column(c).combine_chunks() for c in spatial.EDGE_COLS]
        offs = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        edges = tuple(v.flatten().to_numpy(zero_copy_only=False).astype(float) for v in lists)
        pid = polygons.column("__pid").to_numpy()
        tile = tiles.slice(0, 1).to_pylist()[0]
        tile |= {k: np.frombuffer(tile[k], t) for k, t in (("starts", np.int64), ("x", np.float64), ("y", np.float64), ("c", np.int32))}
        counts, poly, point = count_in_tile(tile, offs, edges, n_kinds)
        held = np.flatnonzero(counts.any(axis=1))
        a = [pa.array(pid[held]), *[pa.nulls(len(held), t) for t in kinds[1:4]], *[pa.array(counts[held, k]) for k in range(n_kinds)]]
        b = [pa.array(pid[poly]), *[pa.array(tile[k][point]) for k in ("yxc" if tile["turned"] else "xyc")], *[pa.nulls(len(poly), pa.int64())] * n_kinds]
        return pa.concat_tables([pa.table(a, names), pa.table(b, names), empty])
    return run


def category_counts_in_polygons(points: DataFrame, x_col: str, y_col: str, category_col: str,
                                polys: DataFrame, poly_id: str, wkt_col: str, categories: list,
                                prefix: str = "POI", points_per_cell: float = POINTS_PER_CELL) -> DataFrame:
    """J3 + J5: per polygon row, the number of points of each category strictly inside it.

    One ``{prefix}_{category}_count`` column for each category, zeros kept.  Polygons
    of one id count together; polygons without text, without edges or with
    coordinates that are not finite hold no point, and nor does a null id.  Points
    without coordinates or category, or with NaN, lie nowhere.
    """
    names = count_names(categories, prefix, "count")
    flags = {f"__n{i}": (F.col("__c") == i).cast("long") for i in range(len(categories))}
    zero = [F.lit(0).cast("long").alias(names[str(c)]) for c in categories]
    prepared = spatial.prepare_polygons(polys.where(F.col(wkt_col).isNotNull()), poly_id, wkt_col)
    box = [F.col(f"bbox.{c}") for c in ("minx", "miny", "maxx", "maxy")]
    finite = F.lit(True)
    for b in box:
        finite = finite & (F.abs(b) < F.lit(1e300))
    spark = polys.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # Written once: the numbers given here stay when a later task is run again.
    prepared = cut_lineage(prepared.where((F.size(spatial.EDGE_COLS[0]) > 0) & finite).drop("edges")
                           .withColumn("__pid", F.monotonically_increasing_id()))
    whole = prepared.agg(F.sum(F.size(spatial.EDGE_COLS[0])).alias("edges"), F.count(F.lit(1)).alias("n"), F.min(box[0]).alias("x0"),
                         F.min(box[1]).alias("y0"), F.max(box[2]).alias("x1"), F.max(box[3]).alias("y1")).first()
    if not whole.edges or not categories:
        return polys.select(poly_id, *zero)
    x, y = F.col(x_col).cast("double"), F.col(y_col).cast("double")
    # A category travels as its place in the list.
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category_col)).cast("int") - 1
    near = (points.select(x.alias("__x"), y.alias("__y"), place.alias("__c"))
            .where(F.col("__x").between(whole.x0, whole.x1) & F.col("__y").between(whole.y0, whole.y1) & (F.col("__c") >= 0)))
    n = near.count()
    if not n or whole.x1 == whole.x0 or whole.y1 == whole.y0:
        return polys.select(poly_id, *zero)
    ship_package(spark)
    # Running totals of a tile take as much memory as its points, whatever the number of categories.
    most = max(1000, min(TILE_POINTS, 32 * TILE_POINTS // len(categories)))
    # Points of one place are many at most by their number, so no task gets them all.
    sorted_points = (near.withColumn("__at", F.monotonically_increasing_id())
                     .repartitionByRange(max(1, -(-n // most)), "__x", "__y", "__at").sortWithinPartitions("__x", "__y"))
    tiles = cut_lineage(sorted_points.select("__x", "__y", "__c").mapInArrow(_tile_rows(most, points_per_cell), _TILE)
                        .withColumn("__tile", F.monotonically_increasing_id()))
    ends = [F.when(F.col("turned"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("y0", "x0"), ("y1", "x1"), ("x0", "y0"), ("x1", "y1"))]
    boxes = tiles.select("__tile", *ends).collect()  # a row for each half million points
    groups = max(-(-whole.edges // GROUP_EDGES), min(-(-8 * cores // len(boxes)), -(-whole.n // GROUP_POLYGONS)))
    met = F.filter(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in b.asDict().items()]) for b in boxes]),
                   lambda t: (t["x0"] <= box[2]) & (t["x1"] >= box[0]) & (t["y0"] <= box[3]) & (t["y1"] >= box[1]))
    dealt = (prepared.select("__pid", *spatial.EDGE_COLS, F.explode(met["__tile"].cast("array<long>")).alias("__tile"))
             .withColumn("__group", F.pmod(F.xxhash64("__pid"), F.lit(groups))).repartition(groups * len(boxes), "__tile", "__group"))
    copies = (tiles.withColumn("__group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
              .repartition(groups * len(boxes), "__tile", "__group"))
    counted = cut_lineage(dealt.groupBy("__tile", "__group").cogroup(copies.groupBy("__tile", "__group")).applyInArrow(
        _count_groups(len(categories)), ", ".join(["__pid long, __x double, __y double, __c int", *[f"`{k}` long" for k in flags]])))
    ids = prepared.select("__pid", F.col(poly_id).alias("__id"))
    hits = _boundary_hits(counted.where("__c is not null"), prepared, whole.edges, ["__pid", "__c"])
    counts = counted.where("__c is null").select("__pid", *flags).unionByName(
        hits.groupBy("__pid").agg(*[F.sum(c).alias(k) for k, c in flags.items()]))
    by_id = counts.join(ids.hint("merge"), "__pid").groupBy("__id").agg(*[F.sum(k).alias(k) for k in flags])
    return (polys.select(poly_id).join(by_id.hint("merge"), F.col(poly_id) == F.col("__id"), "left")
            .select(poly_id, *[F.coalesce(k, F.lit(0)).alias(names[str(c)]) for k, c in zip(flags, categories)]))


def _boundary_hits(near: DataFrame, prepared: DataFrame, edges: int, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of the points of boundary cells (__x, __y, __pid) that lie strictly inside."""
    near = near.select("__x", "__y", "__pid", *[c for c in keep if c != "__pid"])
    parts = -(-edges // spatial.PART_EDGES)
    out = None
    for part in range(parts):
        def mine(df):
            return df.where(F.pmod(F.xxhash64("__pid"), F.lit(parts)) == part) if parts > 1 else df
        hits = spatial.exact_inside(mine(near), "__x", "__y", spatial.pack_polygons(mine(prepared)), keep)
        out = hits if out is None else out.unionByName(hits)
    return out


def ids_inside_any(points: DataFrame, id_col: str, x_col: str, y_col: str, prepared: DataFrame,
                   points_per_cell: float = POINTS_PER_CELL) -> DataFrame | None:
    """Distinct ``__id`` of the points strictly inside at least one polygon, or None where there can be none.

    ``prepared`` has numbered polygons (``__pid``) whose edges are all finite.
    """
    box = [F.col(f"bbox.{c}") for c in ("minx", "miny", "maxx", "maxy")]
    whole = prepared.agg(F.sum(F.size(spatial.EDGE_COLS[0])).alias("edges"), F.min(box[0]).alias("x0"), F.min(box[1]).alias("y0"),
                         F.max(box[2]).alias("x1"), F.max(box[3]).alias("y1")).first()
    if not whole.edges:
        return None
    near = (points.select(F.col(id_col).alias("__id"), F.col(x_col).cast("double").alias("__x"), F.col(y_col).cast("double").alias("__y"))
            .where(F.col("__x").between(whole.x0, whole.x1) & F.col("__y").between(whole.y0, whole.y1) & F.col("__id").isNotNull()))
    n = near.count()
    area = (whole.x1 - whole.x0) * (whole.y1 - whole.y0)
    if not n or not area:
        return None
    cells = Cells(whole.x0, whole.y0, whole.x1, whole.y1, math.floor(math.log2(points_per_cell * area / n) / 2))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    covers = cut_lineage(polygon_cover(prepared.repartition(tasks, "__pid"), cells, ANY_DEPTH))
    used = covers.groupBy("__inside").agg(F.collect_set("__lvl").alias("l")).collect()  # a few dozen numbers
    levels = {r["__inside"]: sorted(r["l"]) for r in used}

    def keyed(rows, inside):
        return rows.select("*", F.explode(F.array(*[cells.of_point("__x", "__y", k) for k in levels[inside]])).alias("__cell"))
    found, rest = [], near
    if levels.get(True):
        whole_cells = covers.where("__inside").select("__cell").distinct()
        done = cut_lineage(keyed(near, True).join(whole_cells.hint("merge"), "__cell", "left_semi").select("__id").distinct())
        found.append(done)
        rest = near.join(done.hint("merge"), "__id", "left_anti")
    if levels.get(False):
        edge = covers.where("not __inside").select("__pid", "__cell")
        found.append(_boundary_hits(keyed(rest, False).join(edge.hint("merge"), "__cell"), prepared, whole.edges, ["__id"]).distinct())
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
