"""Statistics: Cramér's V and shrinkage golden values (FIXTURES §4.3-4.4),
exact quantiles and order statistics against numpy on the bracket path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encoding as E
from tessera.operators import profile as P
from tessera.operators import quantiles as Q
from tessera.operators import splits as S


def _table(spark, counts):
    rows = []
    for i, row in enumerate(counts):
        for j, n in enumerate(row):
            rows += [(f"a{i}", f"b{j}")] * n
    return spark.createDataFrame(rows, "x string, y string")


@pytest.mark.parametrize("counts,chi2,v", [
    ([[30, 10], [10, 50]], 34.027778, 0.577534),
    ([[10, 0], [0, 10]], 20.0, 1.0),
    ([[5, 5], [5, 5]], 0.0, 0.0),
])
def test_cramers_v_golden(spark, counts, chi2, v):
    r = P.cramers_v_pairs(_table(spark, counts), ["x", "y"]).first()
    assert r.chi2 == pytest.approx(chi2, abs=1e-5)
    assert r.cramers_v == pytest.approx(v, abs=1e-6)


def test_target_encoding_golden(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("b", 12.0), ("c", 5.0)],
                               "c string, y double")
    model = E.TargetEncoding().fit(df, "c", "y")
    apply = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "c string")
    got = {r.c: r.enc for r in model.transform(apply, "enc").collect()}
    assert got["a"] == pytest.approx(2.045381, abs=1e-6)
    assert got["b"] == pytest.approx(10.842105, abs=1e-6)
    assert got["c"] == pytest.approx(5.0, abs=1e-9)
    assert got["z"] == pytest.approx(5.5, abs=1e-9)


def test_crossfit_uses_only_other_folds(spark):
    rows = [("a", float(i), i % 2) for i in range(10)] + [("b", 100.0 + i, i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "c string, y double, fold int")
    out = E.TargetEncoding().fit_transform_crossfit(df, "c", "y", "fold", "enc").collect()
    for r in out:
        other = [x for x in rows if x[2] != r.fold]
        ys = np.array([x[1] for x in other])
        yc = np.array([x[1] for x in other if x[0] == r.c])
        lam = ys.var() * len(yc) / (ys.var() * len(yc) + yc.var())
        assert r.enc == pytest.approx(lam * yc.mean() + (1 - lam) * ys.mean(), rel=1e-9)


@pytest.mark.parametrize("buckets,accuracy", [(8, 20), (1024, 10000)])
def test_quantiles_match_numpy(spark, monkeypatch, buckets, accuracy):
    """Coarse sketches and buckets (several passes, missed ranges) and the usual ones agree with numpy."""
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    vals = np.round(rng.lognormal(3, 1, 20000), 3)
    groups = rng.integers(0, 3, len(vals))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: [r[f"q_{i}"] for i in range(len(probs))] for r in
           Q.grouped_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
    for g in range(3):
        want = np.quantile(vals[groups == g], probs)
        assert got[g] == pytest.approx(list(want), rel=1e-12)
    assert Q.quantiles(df, "v", [0.5], accuracy=accuracy)[0] == pytest.approx(float(np.median(vals)))


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", None), ("c", float("inf")), ("c", 1.0),
                                ("c", 2.0)], "g string, v double")
    got = {r.g: (r.n, r.q_0) for r in Q.grouped_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {"a": (1, 1.0), "c": (3, 2.0)}
    assert Q.quantiles(df.where("g = 'b'"), "v", [0.5]) == [None]


def test_value_profile_counts_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), ("x",)], "c string")
    r = P.value_profile(df).first()
    assert r.top_share == pytest.approx(2 / 3) and r.top_value is None and r.n_distinct == 2


def test_pearson_constant_column_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert P.pearson_pairs(df, ["a", "b"])[0][2] is None


def test_statistics_conventions(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    q1, med = Q.quantiles(df, "x", [0.25, 0.5])
    r = df.agg(F.stddev_pop("x"), F.stddev_samp("x"), F.skewness("x")).first()
    assert (q1, med) == (1.75, 3.0)
    assert r[0] == pytest.approx(3.491060, abs=1e-6) and r[1] == pytest.approx(4.031129, abs=1e-6)
    assert r[2] == pytest.approx(0.848321, abs=1e-6)
