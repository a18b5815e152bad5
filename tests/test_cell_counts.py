"""Counts by grid and cell covers against a ray cast of every pair."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cell_counts as C
from tessera.operators import spatial as G

KINDS = ["a", "b", "c d"]


def _wkt(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"


def _inside(x, y, rings):
    odd = False
    for ring in rings:
        pts = ring if ring[0] == ring[-1] else ring + ring[:1]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
            if ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2)
                    and min(y1, y2) <= y <= max(y1, y2)):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, n, far):
    """A ring of n corners around a centre, not convex."""
    cx, cy = rng.uniform(-far, far, 2)
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(0.02, far, n)
    return [(float(x), float(y)) for x, y in zip((cx + r * np.cos(a)).round(3), (cy + r * np.sin(a)).round(3))]


def fixture(seed):
    rng = np.random.default_rng(seed)
    polys = [(k, [star(rng, int(rng.integers(3, 40)), 30.0 if k % 5 == 0 else 4.0)]) for k in range(30)]
    polys += [(40, [[(0.0, 0.0), (16.0, 0.0), (16.0, 16.0), (0.0, 16.0)], [(4.0, 4.0), (8.0, 4.0), (8.0, 8.0), (4.0, 8.0)]]),
              (41, [[(-8.0, -8.0), (-8.0, 8.0), (8.0, 8.0), (8.0, -8.0), (-8.0, -8.0)]]),
              (42, [[(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)]]), (43, [[(0.0, 0.0), (9.0, 9.0), (0.0, 0.0)]])]
    pts = [(float(x), float(y)) for x, y in rng.uniform(-35, 35, (1500, 2)).round(1)]
    pts += [(float(x), float(y)) for x in range(-8, 17, 4) for y in range(-8, 17, 4)] + [(3.0, 3.0)] * 40
    return polys, [(x, y, KINDS[i % 3] if i % 11 else None) for i, (x, y) in enumerate(pts)]


@pytest.mark.parametrize("seed,per_cell", [(1, 2.0), (2, 0.05), (3, 400.0)])
def test_counts_match_a_ray_cast_of_every_pair(spark, seed, per_cell):
    polys, pts = fixture(seed)
    rows = [(k, _wkt(r)) for k, r in polys] + [(50, None), (51, "POLYGON EMPTY"), (40, _wkt(polys[-4][1])), (None, _wkt(polys[-3][1]))]
    points = spark.createDataFrame(pts + [(float("nan"), 1.0, "a"), (None, 1.0, "a"), (float("inf"), 1.0, "a")],
                                   "x double, y double, kind string")
    got = C.category_counts_in_polygons(points, "x", "y", "kind", spark.createDataFrame(rows, "pid int, wkt string"), "pid", "wkt",
                                        KINDS, points_per_cell=per_cell)
    assert got.columns == ["pid", "POI_a_count", "POI_b_count", "POI_c_d_count"]
    want = []
    shape = dict(polys)
    for k, text in rows:
        times = 2 if k == 40 else 1  # polygons of one id count together
        want.append((k, *(times * sum(kind == c and _inside(x, y, shape[k]) for x, y, kind in pts) if k in shape else 0 for c in KINDS)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_polygons_no_points_no_categories(spark):
    polys = spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1))"), (2, None)], "pid int, wkt string")
    points = spark.createDataFrame([(0.6, 0.3, "a")], "x double, y double, kind string")

    def run(p, q, kinds):
        return sorted(map(tuple, C.category_counts_in_polygons(p, "x", "y", "kind", q, "pid", "wkt", kinds).collect()))
    assert run(points, polys, ["a"]) == [(1, 1), (2, 0)]
    assert run(points.limit(0), polys, ["a"]) == [(1, 0), (2, 0)]
    assert run(points, polys.limit(0), ["a"]) == []
    assert run(points, polys.where("wkt is null"), ["a"]) == [(2, 0)]
    assert run(points, polys, []) == [(1,), (2,)]


def test_cells_cover_each_point_once():
    """Inside and boundary cells of a polygon hold every point inside it exactly once, and inside cells no other."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        ring = star(rng, 12, 10.0)
        e = np.array([(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]).T
        xy = np.array(ring)
        box = np.concatenate([xy.min(axis=0), xy.max(axis=0)])[None]
        _, level, cx, cy, inside = C.cover(box, np.array([0, len(ring)]), tuple(e), np.array([5]), np.array([-2]))
        for x, y in rng.uniform(-20, 20, (300, 2)):
            held = (np.floor(np.ldexp(x, -level)) == cx) & (np.floor(np.ldexp(y, -level)) == cy)
            assert held.sum() <= 1
            assert held.sum() == 1 or not _inside(x, y, [ring])
            assert not (held & inside).any() or _inside(x, y, [ring])


def test_only_points_of_boundary_cells_are_tested(spark, monkeypatch):
    """Four times the points: the rows that reach Python grow with the boundary, by about two."""
    seen = []
    real = G.exact_inside
    monkeypatch.setattr(G, "exact_inside", lambda cand, *a: seen.append(cand.count()) or real(cand, *a))
    polys = spark.createDataFrame([(k, _wkt([[(k, 0), (k + 40, 30), (k, 60), (k - 40, 30)]])) for k in range(8)], "pid int, wkt string")
    for n in (4_000, 16_000):
        points = spark.range(n).select((F.rand(1) * 60).alias("x"), (F.rand(2) * 60).alias("y"), F.lit("a").alias("kind"))
        hits = C.category_counts_in_polygons(points, "x", "y", "kind", polys, "pid", "wkt", ["a"]).agg(F.sum("POI_a_count")).first()[0]
    small, large = seen
    assert large < 3 * small and large < 0.35 * hits


def test_edges_in_parts(spark, monkeypatch):
    polys, pts = fixture(4)
    args = (spark.createDataFrame(pts, "x double, y double, kind string"), "x", "y", "kind",
            spark.createDataFrame([(k, _wkt(r)) for k, r in polys], "pid int, wkt string"), "pid", "wkt", KINDS)
    once = sorted(map(tuple, C.category_counts_in_polygons(*args).collect()))
    monkeypatch.setattr(G, "PART_EDGES", 200)
    assert sorted(map(tuple, C.category_counts_in_polygons(*args).collect())) == once


def test_grids_and_covers_are_never_broadcast(spark):
    """Small when shuffled, they are large as hash tables of the driver."""
    polys, pts = fixture(4)
    got = C.category_counts_in_polygons(spark.createDataFrame(pts, "x double, y double, kind string"), "x", "y", "kind",
                                        spark.createDataFrame([(k, _wkt(r)) for k, r in polys], "pid int, wkt string"), "pid", "wkt", KINDS)
    assert got.count() == len(polys)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_inside_any_meets_few_pairs(spark, monkeypatch):
    polys, pts = fixture(5)
    rows = [(k, _wkt(r)) for k, r in polys] + [(None, _wkt(polys[3][1])), (61, None)]
    # Many zones that differ a little and lie on each other.
    many = [[(20 + k / 1000, 20.0), (30.0, 20 - k / 1000), (30.0, 30.0), (20.0, 30 + k / 1000)] for k in range(200)]
    rows += [(100 + k, _wkt([r])) for k, r in enumerate(many)]
    spots = [(x, y) for x, y, _ in pts] + [(21 + i / 50, 25.0) for i in range(400)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)] + [(0, 1e9, 0.0), (None, 25.0, 25.0), (9999, float("nan"), 1.0)],
                                   "id long, x double, y double")
    met, test = [], G.exact_inside

    def seen(cand, *rest):
        met.append(cand.count())
        return test(cand, *rest)
    monkeypatch.setattr(G, "exact_inside", seen)
    got = {r.id: r.in_zone for r in G.inside_any(points, "id", "x", "y", spark.createDataFrame(rows, "z int, wkt string"), "z", "wkt").collect()}
    shapes = [r for _, r in polys] + [[r] for r in many]
    assert all(got[i] == int(any(_inside(x, y, s) for s in shapes)) for i, (x, y) in enumerate(spots) if i)
    assert got[None] == 0 and got[9999] == 0
    assert sum(met) < 400 * 200 / 2


@pytest.mark.parametrize("seed,per_cell,pairs", [(1, 2.0, 100_000), (2, 0.05, 50), (3, 400.0, 1000)])
def test_tile_counts_without_a_row_for_each_cell_or_point(monkeypatch, seed, per_cell, pairs):
    """Counts of a tile, wide or narrow, with the few points near an edge, are those of a ray cast."""
    monkeypatch.setattr(C, "TILE_PAIRS", pairs)
    polys, pts = fixture(seed)
    edges, offs = [], [0]
    for _, rings in polys:
        for ring in rings:
            closed = ring if ring[0] == ring[-1] else ring + ring[:1]
            edges += [(*a, *b) for a, b in zip(closed, closed[1:])]
        offs.append(len(edges))
    edges = tuple(np.array(v, float) for v in zip(*edges))
    for far in (99, 3):
        mine = [(x, y, KINDS.index(kind)) for x, y, kind in pts if kind and abs(x) <= far]
        tile = C.pack_tile(*map(np.array, zip(*mine)), per_cell)
        assert (tile["turned"] or far != 3) and tile["starts"][-1] == len(mine)
        got, poly, point = C.count_in_tile(tile, np.array(offs), edges, 3)
        xs, ys = (tile["y"], tile["x"]) if tile["turned"] else (tile["x"], tile["y"])
        for a, b in zip(poly, point):
            got[a, tile["c"][b]] += _inside(xs[b], ys[b], polys[a][1])
        assert got.tolist() == [[sum(c == k and _inside(x, y, rings) for x, y, c in mine) for k in range(3)] for _, rings in polys]
        assert per_cell > 2 or len(poly) < 200


@pytest.mark.parametrize("tile_points", [500_000, 1000])
def test_every_group_of_polygons_meets_its_tiles(spark, monkeypatch, tile_points):
    monkeypatch.setattr(C, "GROUP_POLYGONS", 3)
    monkeypatch.setattr(C, "TILE_POINTS", tile_points)
    polys, pts = fixture(6)
    got = C.category_counts_in_polygons(spark.createDataFrame(pts, "x double, y double, kind string"), "x", "y", "kind",
                                        spark.createDataFrame([(k, _wkt(r)) for k, r in polys], "pid int, wkt string"), "pid", "wkt", KINDS)
    want = [(k, *(sum(kind == c and _inside(x, y, rings) for x, y, kind in pts) for c in KINDS)) for k, rings in polys]
    assert sorted(map(tuple, got.collect())) == sorted(want)
