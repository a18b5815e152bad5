"""The preparation flow (C11): no missing features on any split, and its encoders against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encoding as E
from tessera.operators.scaling import StandardScaling
from tessera.plans.preprocessing import PrepConfig, prepare


def test_no_feature_is_missing_on_any_split(spark):
    rng = np.random.default_rng(1)
    n = 900
    rows = [(i, 2018 + i // 180, i % 12 + 1, f"code{rng.integers(0, 300)}", f"t{rng.integers(0, 15)}", f"o{i % 3}",
             None if i > 600 and i % 3 else float(rng.normal()), float("nan") if i % 7 == 0 else float(rng.normal()),
             float(rng.lognormal(8, 1))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, yr int, mo int, code string, kind string, few string, late double, nan double, y double")
    cfg = PrepConfig(target="y", row_id="id", year_col="yr", month_col="mo", outliers=False, low_card=10,
                     steps={"cramers_analysis": False})
    out, info = prepare(df, cfg)
    assert info["encoding"] == {"code": "label", "kind": "target", "few": "one_hot"}
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 576, "val": 144, "test": 180}
    features = [c for c in out.columns if c not in ("id", "split", "y", "y_original")]
    assert {"yr", "mo", "late", "nan", "code", "kind"} <= set(features)
    assert out.select(*[F.count_if(F.col(f"`{c}`").isNull()).alias(str(i)) for i, c in enumerate(features)]).first() == (0,) * len(features)


def test_split_encoding_of_several_columns_equals_one_column_at_a_time(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"a{rng.integers(0, 6)}", None if i % 11 == 0 else f"b{rng.integers(0, 4)}", float(rng.normal()),
             int(i % 5) if i < 80 else None) for i in range(100)] + [(100, "new", "new", 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string, y double, fold int")
    got = {r.id: (r.a, r.b) for r in E.TargetEncoding().encode_split(df, ["a", "b"], "y", "fold").collect()}
    train = df.where("fold is not null")
    for k, c in enumerate("ab"):
        te = E.TargetEncoding()
        want = {r.id: r.enc for r in te.fit_transform_crossfit(train, c, "y", "fold", "enc").collect()}
        want |= {r.id: r.enc for r in te.fit(train, c, "y").transform(df.where("fold is null"), "enc").collect()}
        assert {i: v[k] for i, v in got.items()} == pytest.approx(want)


def test_label_codes_are_sorted_and_gapless(spark):
    values = [f"v{i:04d}" for i in np.random.default_rng(3).permutation(500)] + [None]
    df = spark.createDataFrame([(v, "x") for v in values], "c string, d string").repartition(7)
    model = E.LabelEncoding(unseen=-1).fit(df, ["c", "d"])
    want = {v: i for i, v in enumerate(sorted("nan" if v is None else v for v in values))}
    assert {r["value"]: r["code"] for r in model.tables["c"].collect()} == want
    assert [tuple(r) for r in model.transform(spark.createDataFrame([("zz", "x")], "c string, d string")).collect()] == [(-1, 0)]


def test_one_hot_has_no_cap(spark):
    df = spark.createDataFrame([(f"l{i:02d}",) for i in range(25)], "c string")
    assert len(E.OneHot().fit(df, ["c"]).levels["c"]) == 24


@pytest.mark.parametrize("how,fill", [("mean", 2.0), ("median", 1.0), ("most_frequent", 1.0)])
def test_nan_is_missing(spark, how, fill):
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (nan,), (nan,), (nan,), (None,)], "x double")
    out = [r.x for r in E.Imputer(numeric=how).fit(df).transform(df).collect()]
    assert out == [1.0, 1.0, 4.0] + [fill] * 4
    m = StandardScaling().fit(df, ["x"])
    assert m.means["x"] == 2.0 and m.scales["x"] == pytest.approx(np.std([1, 1, 4]))


def test_flow_takes_levels_with_dots_backticks_and_blanks(spark):
    levels = ["b.c", "b_c", "d`e", "f g", "B.C"]
    rows = [(i, 2018 + i // 60, i % 12 + 1, levels[i % 5], float(i % 17), float(100 + i % 23)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, yr int, mo int, k string, x double, y double")
    out, info = prepare(df, PrepConfig(target="y", row_id="id", year_col="yr", month_col="mo", outliers=False,
                                       steps={"cramers_analysis": False, "correlation_removal": False}))
    assert info["encoding"] == {"k": "one_hot"}
    made = [c for c in out.columns if c.startswith("k_")]
    assert len(made) == 4 and not any(ch in c for c in made for ch in ".`") and out.count() == 300
    assert len({c.lower() for c in out.columns}) == len(out.columns)


def test_cardinality_classes_match_exact_counts(spark):
    df = spark.range(4000).select(*[(F.col("id") % n).cast("string").alias(f"c.{n}") for n in (1, 9, 10, 11, 99, 100, 101, 130, 4000)],
                                  F.lit(None).cast("string").alias("none"))
    got = E.cardinality_classes(df)
    exact = {"c.1": "one_hot", "c.9": "one_hot", "c.10": "target", "c.11": "target", "c.99": "target", "c.100": "label",
             "c.101": "label", "c.130": "label", "c.4000": "label", "none": "one_hot"}
    assert got == exact


def test_target_codes_are_worked_out_per_category_not_per_row(spark):
    rows = [(i, "ab"[i % 2], float(i * i % 11), i % 3) for i in range(30)] + [(30, "a", None, None), (31, "new", None, None), (32, "new", None, 1)]
    df = spark.createDataFrame(rows, "id long, c string, y double, fold int")
    out = E.TargetEncoding().encode_split(df, ["c"], "y", "fold")
    assert "try_divide" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.id: r.c for r in out.collect()}
    mean = {f: [y for i, _, y, g in rows[:30] if g != f] for f in (None, 1)}
    assert got[31] == pytest.approx(sum(mean[None]) / len(mean[None]))
    assert got[32] == pytest.approx(sum(mean[1]) / len(mean[1]))
    assert len({got[i] for i in range(0, 30, 2)}) == 3 and got[30] not in {got[i] for i in range(30)}
