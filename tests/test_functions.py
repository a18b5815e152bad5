"""Golden rows for the column functions (FIXTURES §4.1, §4.6)."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.floors import with_floor_features
from tessera.functions.numeric import parse_number

NAN = None
# input, min, max, n, basement, ground, upper, span, weighted
GOLDEN = [
    ("P1-3", 1, 3, 2, 0, 0, 1, 2, 2.2),
    ("S1-T-2", -1, 2, 3, 1, 1, 1, 3, 0.8),
    ("PT-ST-1", -1, 1, 4, 1, 1, 1, 2, 0.065217),
    (" p2 ", 2, 2, 1, 0, 0, 1, 0, 2),
    ("SEMI", -1, -1, 1, 1, 0, 0, 0, -1),
    ("RIAL", 0.5, 0.5, 1, 0, 1, 0, 0, 0.5),
    ("S2", -2, -2, 1, 1, 0, 0, 0, -2),
    ("0", 0, 0, 1, 0, 1, 0, 0, 0),
    ("13", 13, 13, 1, 0, 0, 1, 0, 13),
    ("15", 15, 15, 1, 0, 0, 1, 0, 15),
    ("1E1", 10, 10, 1, 0, 0, 1, 0, 10),
    ("01", 1, 1, 1, 0, 0, 1, 0, 1),
    ("-1", 1, 1, 1, 0, 0, 1, 0, 1),
    ("4-5", 4, 5, 2, 0, 0, 1, 1, 4.533333),
    ("1;2;3", 1, 3, 3, 0, 0, 1, 2, 2.133333),
]
EMPTY = ["S3", "P13", "P01", "T1", "16", "   ", "NULL", "", None]
COLS = ["min_floor", "max_floor", "n_floors", "has_basement", "has_ground", "has_upper",
        "floor_span", "floor_numeric_weighted"]


def _features(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = with_floor_features(df, "s").orderBy("i").collect()
    return [[r["floor_" + c] for c in COLS] for r in rows]


def test_floor_golden(spark):
    got = _features(spark, [g[0] for g in GOLDEN])
    for g, row in zip(GOLDEN, got):
        for want, have in zip(g[1:], row):
            assert have == pytest.approx(want, abs=1e-6), (g[0], row)


def test_floor_unparsable(spark):
    for row in _features(spark, EMPTY):
        assert row[0] is None and row[1] is None and row[7] is None
        assert row[2:7] == [0.0, 0.0, 0.0, 0.0, 0.0]


def test_parse_number(spark):
    vals = [" 12 ", "1e3", "-.5", "1d", "0x10", "abc", "", None, "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(parse_number("s")).collect()]
    assert got[:3] == [12.0, 1000.0, -0.5]
    assert got[3:8] == [None] * 5
    assert math.isinf(got[8])
