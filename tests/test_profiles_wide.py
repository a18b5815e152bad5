"""Wide profiles: Gram-matrix correlations, coded contingency, frequent values and cardinality classes."""
import itertools
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import contingency as K
from tessera.operators import gram as G
from tessera.operators import profile as P
from tessera.operators.cleaning import ConstantColumns


def _frame(spark, data: pd.DataFrame):
    rows = [tuple(None if v is None else v for v in r) for r in data.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in data.columns))


def test_pearson_matches_numpy_with_missing_cells_and_hard_columns(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 400
    data = pd.DataFrame({f"x{k}": rng.normal(size=n) * 10.0 ** (k - 3) + 10.0 ** k for k in range(6)})
    data["sum.of"] = data.x1 + 0.01 * data.x0
    data["same"] = 0.1
    data["outlier"] = np.where(np.arange(n) == 7, 1e9, rng.normal(size=n))
    data["empty"] = np.nan
    for c in ("x0", "x2", "outlier"):
        data.loc[rng.random(n) < 0.3, c] = np.nan
    data["flat_there"] = np.where(data.x0.notna(), 5.0, rng.normal(size=n))
    for block in (256, 3):
        monkeypatch.setattr(G, "BLOCK_COLUMNS", block)
        got = {(a, b): r for a, b, r in P.pearson_pairs(_frame(spark, data), list(data.columns))}
        assert list(got) == list(itertools.combinations(data.columns, 2))
        for (a, b), r in got.items():
            both = data[[a, b]].dropna().to_numpy()
            if len(both) == 0 or (both == both[0]).all(axis=0).any():
                assert r is None, (a, b)
            else:
                assert r == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9), (a, b)


def test_pearson_null_nan_infinite_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, float("inf")), (float("nan"), 5.0, 2.0), (4.0, 9.0, 3.0), (5.0, 8.0, 2.0)],
                               "a double, b double, c double")
    got = {(a, b): r for a, b, r in P.pearson_pairs(df, ["a", "b", "c"])}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 4, 5], [2, 9, 8])[0, 1], abs=1e-12)
    assert got["b", "c"] == pytest.approx(np.corrcoef([2, 5, 9, 8], [1, 2, 3, 2])[0, 1], abs=1e-12)
    assert [r for *_, r in P.pearson_pairs(df.limit(0), ["a", "b"])] == [None]


def test_pearson_of_120_columns_takes_few_jobs(spark):
    df = spark.range(2000).select(*[(F.rand(i) + (F.col("id") % 7) * (i % 3)).alias(f"c{i}") for i in range(120)])
    P.pearson_pairs(df.select("c0", "c1"), ["c0", "c1"])
    start = time.time()
    assert len(P.pearson_pairs(df, df.columns)) == 7140
    assert time.time() - start < 30  # the pair-wise form took minutes


def test_contingency_of_few_and_many_levels_matches_a_count_of_pairs(spark, monkeypatch):
    rng = random.Random(2)
    pools = {"few": "abc", "two.dots": "xy", "many": [str(k) for k in range(40)], "null": [None], "some": ["", None, "é", "z"]}
    rows = [tuple(rng.choice(p) for p in pools.values()) for _ in range(600)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in pools))
    want = Counter()
    for r in rows:
        for (i, a), (j, b) in itertools.combinations(enumerate(pools), 2):
            if r[i] is not None and r[j] is not None:
                want[a, b, r[i], r[j]] += 1
    monkeypatch.setattr(K, "LONG_PAIRS", 2)
    for few, cells in ((256, 8_000_000), (10, 8), (0, 1)):
        monkeypatch.setattr(K, "CELLS", cells)
        got = K.contingency(df, list(pools), few).collect()
        assert {(r.c1, r.c2, r.a, r.b): r.n for r in got} == want and len(got) == len(want)
    assert K.contingency(df.limit(0), list(pools)).collect() == []


def test_sixty_text_columns_are_not_copied_by_pair(spark):
    df = spark.range(500).select(*[((F.col("id") * (i + 3)) % (2 + i % 5)).cast("string").alias(f"t{i}") for i in range(60)])
    out = P.contingency(df, df.columns)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert out.select("c1", "c2").distinct().count() == 1770


def test_frequent_values_count_nan_and_null_together(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, "a", None), (None, "a", None), (1.0, "b", None), (nan, "b", "x")], "v double, t string, u string")
    got = {r.column: tuple(r)[1:] for r in P.frequent_values(df, least_share=0.5).collect()}
    assert got == {"v": (3, 0.75, None, 4), "t": (2, 0.5, "a", 4), "u": (3, 0.75, None, 4)}
    assert ConstantColumns(0.75).fit(df).constant == ["v", "u"]
    assert P.value_profile(df, ["v"]).first().top_share == 0.75
    assert P.frequent_values(df.limit(0)).collect() == []


def test_frequent_values_match_a_full_count(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), str(rng.randrange(5000)), rng.choice([None, 1.5]), rng.choice([7] * 6 + list(range(100)))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "a string, wide string, half double, mixed long")
    for share in (0.05, 0.4, 0.6):
        want = {}
        for i, c in enumerate(df.columns):
            value, n = min(Counter(r[i] for r in rows).items(), key=lambda x: (-x[1], x[0] is not None, str(x[0])))
            if n >= share * len(rows):
                want[c] = (n, None if value is None else str(value))
        got = {r.column: (r.top_count, r.top_value) for r in P.frequent_values(df, least_share=share).collect()}
        assert got == want


def test_frequent_values_do_not_shuffle_by_value(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 2).alias("x"))
    plans, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: plans.append(out := agg(self, *a)) or out)
    P.constant_columns(df, 0.4)
    assert len(plans) == 2
    for p in plans:
        assert "hashpartitioning" not in p._jdf.queryExecution().executedPlan().toString()


def test_pearson_when_the_first_rows_tell_nothing(spark):
    rng = np.random.default_rng(5)
    n = 3 * G.FIRST_ROWS
    late = np.where(np.arange(n) < 2 * G.FIRST_ROWS, 7.0, 1e9 + rng.normal(size=n))
    tail = 1e9 + rng.normal(size=n)
    plain = rng.normal(size=n)
    rows = [(float(a), float(c) if i >= 2 * G.FIRST_ROWS else None, float(p), float(p + a / 1e9), 3.0, float("nan"))
            for i, (a, c, p) in enumerate(zip(late, tail, plain))]
    df = spark.createDataFrame(rows, "late double, tail double, plain double, both double, flat double, none double").coalesce(1)
    got = {(a, b): r for a, b, r in G.pearson_pairs(df, df.columns)}
    seen = slice(2 * G.FIRST_ROWS, None)
    for pair, x, y in ((("late", "plain"), late, plain), (("late", "tail"), late[seen], tail[seen]),
                       (("tail", "plain"), tail[seen], plain[seen]), (("plain", "both"), plain, plain + late / 1e9)):
        assert got[pair] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
    assert all(r is None for p, r in got.items() if "flat" in p or "none" in p)


def test_pearson_reads_all_rows_once_when_the_first_ones_serve(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(G, "_sizes", lambda df, old=G._sizes: passes.append(df.count()) or old(df))
    df = spark.range(4 * G.FIRST_ROWS).selectExpr("id % 17 as a", "id % 5 as b", "(id * 7) % 13 as c")
    assert len(G.pearson_pairs(df, ["a", "b", "c"])) == 3 and passes == [G.FIRST_ROWS]
