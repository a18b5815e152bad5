"""Splits (FIXTURES §4.5) and spatial predicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import point_in_polygon, ring_edges, wkt_rings
from tessera.operators import spatial as G
from tessera.operators import splits as S


@pytest.mark.parametrize("n,train,val,test", [(10, 7, 2, 1), (1000, 702, 198, 100),
                                               (1500, 1053, 297, 150), (15000, 10530, 2970, 1500)])
def test_temporal_sizes_golden(n, train, val, test):
    s = S.temporal_sizes(n, 0.1, 0.22)
    assert (s.train, s.val, s.test) == (train, val, test)


def test_temporal_split_exact_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 8)
    rng = np.random.default_rng(3)
    n = 5000
    # one month holds a third of the rows (a hot key)
    months = np.where(rng.random(n) < 1 / 3, 6, rng.integers(1, 13, n))
    df = spark.createDataFrame([(i, 2020, int(m)) for i, m in enumerate(rng.permutation(n))
                                for m in [months[i]]], "id long, yr int, mo int")
    out = S.temporal_split(df, "yr", "mo", "id", 0.1, 0.22).toPandas()
    sizes = S.temporal_sizes(n, 0.1, 0.22)
    counts = out["split"].value_counts()
    assert (counts["train"], counts["val"], counts["test"]) == (sizes.train, sizes.val, sizes.test)
    key = out["mo"] * 10**6 + out["id"]
    assert key[out.split == "train"].max() < key[out.split == "val"].min()
    assert key[out.split == "val"].max() < key[out.split == "test"].min()


@pytest.mark.parametrize("kind", ["long", "double", "string", "date"])
def test_boundaries_match_a_sort(spark, monkeypatch, kind):
    monkeypatch.setattr(S, "BUCKETS", 5)
    rng = np.random.default_rng(7)
    raw = [int(x) for x in np.concatenate([rng.integers(-2**62, 2**62, 60), rng.integers(0, 9, 60), [0] * 40])]
    cast = {"long": "k", "double": "cast(k as double) / 7", "string": "concat('é', cast(k as string))",
            "date": "date_add(date'2000-01-01', cast(k % 5000 as int))"}[kind]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(raw)], "k long, id long").selectExpr(f"{cast} AS v", "id")
    rows = [tuple(r) for r in df.orderBy("v", "id").collect()]
    keys = S.order_keys(df, ["v", "id"])
    ks = [0, 1, 77, 120, 159]
    got = S.boundaries(df, keys, ks)
    for k in ks:
        below = df.where(S.before(keys, got[k])).collect()
        assert sorted(tuple(r) for r in below) == sorted(rows[:k])


def test_split_takes_few_jobs(spark):
    df = spark.range(20000).selectExpr("id", "2020 AS yr", "cast(id % 12 AS int) AS mo")
    status = spark.sparkContext.statusTracker()
    for call in (lambda: S.temporal_split(df, "yr", "mo", "id"), lambda: S.random_split(df, "id"), lambda: S.kfold(df, "id")):
        spark.sparkContext.setJobGroup("split-jobs", "count the jobs of one split")
        before = len(status.getJobIdsForGroup("split-jobs"))
        call()
        # An adaptive query runs one job for its shuffle and one for its result.
        assert len(status.getJobIdsForGroup("split-jobs")) - before <= 14
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_kfold_and_timeseries_blocks(spark):
    df = spark.range(13).withColumnRenamed("id", "k")
    folds = S.kfold(df, "k", 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [3, 3, 3, 2, 2]
    blocks = {r.k: r.block for r in S.timeseries_blocks(df, ["k"], 5).collect()}
    # test blocks [3,5) [5,7) [7,9) [9,11) [11,13)
    assert [blocks[i] for i in range(13)] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def _ray(px, py, rings):
    inside = False
    for ring in rings:
        pts = ring if ring[0] == ring[-1] else ring + [ring[0]]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
            if (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0 and min(x1, x2) <= px <= max(x1, x2) \
                    and min(y1, y2) <= py <= max(y1, y2):
                return False
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


POLYS = {
    1: [[(0, 0), (4, 0), (0, 4), (0, 0)]],                                   # triangle
    2: [[(10, 10), (20, 10), (20, 20), (10, 20)], [(13, 13), (17, 13), (17, 17), (13, 17), (13, 13)]],
    3: [[(30, 0), (32, 0), (32, 2), (30, 2)], [(35, 0), (37, 0), (37, 2), (35, 2)]],  # multipolygon
}


def _wkt(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"


def test_point_in_polygon_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(float(x), float(y)) for x, y in rng.uniform(-2, 40, (3000, 2)).round(1)]
    pts += [(2.0, 2.0), (0.0, 1.0), (15.0, 15.0), (13.0, 15.0), (31.0, 1.0), (36.0, 1.0)]  # edges, holes
    polys = spark.createDataFrame([(k, _wkt(v)) for k, v in POLYS.items()], "pid int, wkt string")
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "i int, x double, y double")
    got = {(r.i, r.pid) for r in G.points_in_polygons(points, "x", "y", polys, "pid", "wkt").collect()}
    want = {(i, k) for i, (x, y) in enumerate(pts) for k, rings in POLYS.items() if _ray(x, y, rings)}
    assert got == want and len(want) > 100
    # the column-expression form gives the same answer
    expr = (points.crossJoin(polys.select("pid", ring_edges(wkt_rings("wkt")).alias("e")))
                  .where(point_in_polygon(F.col("x"), F.col("y"), F.col("e"))))
    assert {(r.i, r.pid) for r in expr.collect()} == want


def test_spatial_join_has_no_cartesian_product(spark):
    polys = spark.createDataFrame([(k, _wkt(v)) for k, v in POLYS.items()], "pid int, wkt string")
    points = spark.createDataFrame([(1, 1.0, 1.0)], "i int, x double, y double")
    plan = G.points_in_polygons(points, "x", "y", polys, "pid", "wkt")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_spatial_join_in_parts(spark, monkeypatch):
    polys = spark.createDataFrame([(k, _wkt(v)) for k, v in POLYS.items()], "pid int, wkt string")
    pts = [(1.0, 1.0), (15.0, 15.0), (11.0, 11.0), (36.0, 1.0), (float("nan"), 1.0), (None, 1.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "i int, x double, y double")
    for edges in (4_000_000, 5):
        monkeypatch.setattr(G, "PART_EDGES", edges)
        got = {(r.i, r.pid) for r in G.points_in_polygons(points, "x", "y", polys, "pid", "wkt").collect()}
        assert got == {(0, 1), (2, 2), (3, 3)}


def test_spatial_null_repeated_and_no_polygons(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 50.0)], "i int, x double, y double")
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    polys = spark.createDataFrame([(1, square), (1, square), (2, None), (None, square)], "pid int, wkt string")
    got = sorted((r.i, r.pid) for r in G.points_in_polygons(points, "x", "y", polys, "pid", "wkt").collect() if r.pid)
    assert got == [(1, 1), (1, 1)]
    assert G.points_in_polygons(points, "x", "y", polys.limit(0), "pid", "wkt").collect() == []
    for zones, want in ((polys, [1, 0]), (polys.limit(0), [0, 0]), (polys.where("wkt is null"), [0, 0])):
        flags = {r.i: r.in_zone for r in G.inside_any(points, "i", "x", "y", zones, "pid", "wkt").collect()}
        assert [flags[1], flags[2]] == want


def test_null_tie_breaks_come_last(spark):
    rows = [(i, 2020, 1, None if i % 3 == 0 else float(i % 7 + 1), None if i % 4 == 0 else f"s{i:03d}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, m int, v double, t string")
    for cols, key in ((["t"], lambda r: (r[4] is None, r[4] or "")), (["v", "id"], lambda r: (r[3] is None, r[3] or 0, r[0]))):
        keys = S.order_keys(df, cols)
        order = sorted(rows, key=key)
        places = [p for p in (0, 7, 20, 33) if order.index(order[p]) == p]
        bounds = S.boundaries(df, keys, places)
        got = {r.id: r.b for r in df.select("id", S.block_index(keys, bounds).alias("b")).collect()}
        assert got == {r[0]: sum(p <= k for p in places) for k, r in enumerate(order)}
