"""Encoders and quality checks: semantics on small hand-checked tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import encoding as E
from tessera.operators import quality as Q


def test_one_hot_drops_first_sorted_level_and_zeroes_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None)], "k int, c string")
    out = {r.k: r for r in E.OneHot().fit(df, ["c"]).transform(df).collect()}
    assert "c_a" not in out[1].asDict() and "c" not in out[1].asDict()
    assert (out[1].c_b, out[1].c_c) == (True, False)
    assert (out[2].c_b, out[2].c_c) == (False, False)
    assert (out[4].c_b, out[4].c_c) == (False, False)


def test_label_codes_sorted_text_with_nan_token(spark):
    df = spark.createDataFrame([(1, "pear"), (2, "apple"), (3, None), (4, "pear")], "k int, c string")
    out = {r.k: r.c for r in E.LabelEncoding().fit(df, ["c"]).transform(df).collect()}
    # sorted texts: apple < nan < pear
    assert out == {1: 2, 2: 0, 3: 1, 4: 2}


def test_routing_thresholds():
    assert [E.route(n) for n in (1, 9, 10, 99, 100)] == ["one_hot", "one_hot", "target", "target", "label"]


def test_imputer_strategies(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "y"), (3.0, "y"), (None, "x")],
                               "v double, c string")
    med = E.Imputer("median", "constant").fit(df)
    assert med.fills == {"v": 3.0, "c": "MISSING"}
    mode = E.Imputer("most_frequent", "most_frequent").fit(df)
    assert mode.fills["v"] == 3.0 and mode.fills["c"] == "x"      # tie x/y -> smallest
    mean = E.Imputer("mean").fit(df)
    assert mean.fills["v"] == pytest.approx(7.0 / 3.0)


def test_category_drift_values(spark):
    rows = ([("train", "a")] * 6 + [("train", "b")] * 4 + [("val", "a")] * 5 + [("val", "b")] * 5
            + [("test", "a")] * 2 + [("test", "c")] * 2)
    df = spark.createDataFrame(rows, "split string, cat string")
    r = Q.category_drift(df, ["cat"], max_drift=0.05).first()
    assert r.train_val_drift == pytest.approx(0.1)
    assert r.train_test_drift == pytest.approx(0.5)     # c: 0 vs 0.5; a: 0.6 vs 0.5; b: 0.4 vs 0
    assert r.val_test_drift == pytest.approx(0.5)
    assert r.max_drift == pytest.approx(0.5) and r.drifted


def test_target_leakage_rules(spark):
    df = spark.createDataFrame([(float(i), float(i) * 2 + 1, float(i % 3), float(-i)) for i in range(50)],
                               "price double, twice double, noise double, price_lag double")
    out = {r.feature: r for r in Q.target_leakage(df, "price", ["twice", "noise", "price_lag"]).collect()}
    assert out["twice"].suspicious and out["twice"].reason == "high correlation"
    assert out["price_lag"].suspicious and out["price_lag"].reason == "name contains target"
    assert not out["noise"].suspicious
