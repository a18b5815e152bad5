"""Outliers, isolation forest, k-NN, models and importance against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forest as FN
from tessera.operators import importance as I
from tessera.operators import models as ML
from tessera.operators import outliers as O
from tessera.operators.forest import isolation_flags
from tessera.operators.knn import knn_regress
from tessera.operators.metrics import regression_metrics


def test_z_and_iqr_flags_match_numpy(spark):
    rng = np.random.default_rng(11)
    y = np.concatenate([rng.normal(0, 1, 500), [8.0, -9.0, 6.5]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double")
    out = {r.i: r for r in O.detect_outliers(df, "y", ["i"], z_threshold=3.0).collect()}
    z = np.abs((y - y.mean()) / y.std()) > 3.0
    q1, q3 = np.quantile(y, [0.25, 0.75])
    iqr = (y < q1 - 1.5 * (q3 - q1)) | (y > q3 + 1.5 * (q3 - q1))
    assert [out[i].z_out for i in range(len(y))] == list(z)
    assert [out[i].iqr_out for i in range(len(y))] == list(iqr)


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(2)
    normal = rng.normal(0, 1, (2000, 3))
    planted = rng.normal(0, 1, (20, 3)) * 0.2 + 9.0
    x = np.vstack([normal, planted])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    out = isolation_flags(df, ["a", "b", "c"], ["i"], contamination=0.02).toPandas()
    flagged = set(out.loc[out.is_outlier, "i"])
    assert len(flagged) == pytest.approx(0.02 * len(x), abs=3)
    assert len(flagged & set(range(2000, 2020))) >= 18


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (1500, 6))
    y = rng.integers(0, 10, 1500).astype(float)
    df = spark.createDataFrame([(i, list(map(float, x[i])), float(y[i])) for i in range(1500)],
                               "id int, v array<double>, y double")
    train, test = df.where("id >= 200"), df.where("id < 200")
    got = {r.id: r.prediction for r in knn_regress(train, test, "id", "v", "y", k=5).collect()}
    tr = x[200:]
    for q in range(200):
        d = np.sqrt(((tr - x[q]) ** 2).sum(axis=1))
        nn = np.lexsort((np.arange(200, 1500), d))[:5]
        assert got[q] == pytest.approx(y[200:][nn].mean())


def test_ols_and_metrics_match_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (400, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + 3.0 + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), "train") for i in range(400)],
                               "row_id int, a double, b double, c double, label double, split string")
    data = ML.assemble(df, ["a", "b", "c"])
    model = ML.baseline_estimators(400, float(y.std()), "label")["Baseline_LinearRegression"].fit(data)
    coef = np.linalg.lstsq(np.c_[x, np.ones(400)], y, rcond=None)[0]
    assert list(model.coefficients) == pytest.approx(list(coef[:3]), abs=1e-6)
    pred = ML.predict_long({"ols": model}, data, "row_id", "label")
    m = regression_metrics(pred, ["model"]).first()
    p = x @ coef[:3] + coef[3]
    assert m.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)), rel=1e-6)
    assert m.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), rel=1e-6)


def test_permuted_rows_keep_every_value_once(spark):
    df = spark.createDataFrame([(i, float(i * i), float(-i)) for i in range(300)], "row_id int, v double, w double").repartition(5)
    out = I.permuted_rows(df, "row_id", ["v", "w"], 300, 2, seed=5).toPandas()
    assert len(out) == 1200
    for run, part in out.groupby("run"):
        moved, kept = ("v", "w") if run < 2 else ("w", "v")
        want = {"v": [float(i * i) for i in range(300)], "w": [float(-i) for i in range(300)]}
        part = part.sort_values("row_id")
        assert sorted(part[moved]) == sorted(want[moved]) and list(part[kept]) == want[kept]
        assert (part[moved].values != np.array(want[moved])).sum() > 250


def test_permutation_importance_of_a_linear_model(spark):
    """MSE grows by 2 b^2 var(x) when an independent feature of a linear model is shuffled; in few jobs."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (2000, 2)) * np.array([1.0, 2.0])
    y = x @ np.array([3.0, 0.5])
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(2000)], "row_id int, a double, b double, label double")
    model = ML.baseline_estimators(2000, float(y.std()), "label")["Baseline_LinearRegression"].fit(ML.assemble(df, ["a", "b"]))
    spark.sparkContext.setJobGroup("permute", "permutation importance")
    got = {r.feature: r.importance_mean for r in I.permutation_importance(model, df, ["a", "b"], "row_id", "label").collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("permute"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == pytest.approx({"a": 2 * 9 * x[:, 0].var(), "b": 2 * 0.25 * x[:, 1].var()}, rel=0.08)
    assert jobs <= 25  # an adaptive query runs one job for each shuffle


def test_knn_meets_few_cells_of_clustered_rows():
    from tessera.operators.knn import cell_pairs
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 10, (30, 16))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.3, (3000, 16))
    pivots = x[:55]
    cell = ((x[:, None] - pivots) ** 2).sum(2).argmin(1)
    dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
    cells = {int(c): {"n": int((cell == c).sum()), "r": float(dist[cell == c].max())} for c in set(cell)}
    met = cell_pairs(pivots, cells, cells, 5)
    share = sum(cells[a]["n"] * cells[b]["n"] for a, b in met) / 3000 ** 2
    assert share < 0.3
    for a in range(0, 3000, 100):  # no neighbour lies in a cell that is left out
        near = np.argsort(((x - x[a]) ** 2).sum(1))[:5]
        assert {(int(cell[a]), int(cell[b])) for b in near} <= set(met)


def test_knn_odd_inputs(spark):
    train = spark.createDataFrame([(1, [0.0, 1.0], 2.0), (2, None, 3.0), (3, [5.0, 5.0], 4.0)], "id int, v array<double>, y double")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "id int, v array<double>")
    assert [tuple(r) for r in knn_regress(train, queries, "id", "v", "y", k=5).collect()] == [(1, 3.0, 2)]
    assert knn_regress(train.limit(0), queries, "id", "v", "y").collect() == []


def test_pca_matches_numpy(spark):
    from tessera.operators.scaling import PCAReduction
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (500, 4)) @ np.array([[3, 0, 0, 0], [1, 1, 0, 0], [0, 0, .5, 0], [0, 0, 0, .1]])
    x = x - x.mean(axis=0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    info = PCAReduction(variance=0.95).fit(df, ["a", "b", "c", "d"])
    ev = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert list(info.explained_variance) == pytest.approx(list(ev / ev.sum()), abs=1e-9)
    assert info.k == int(np.searchsorted(np.cumsum(ev / ev.sum()), 0.95, side="right") + 1)
    assert info.reconstruction_error(df) == pytest.approx(
        ev[info.k:].sum() * 499 / 500 / 4, rel=1e-6, abs=1e-9)


def test_sampled_shap_recovers_linear_shap(spark):
    """On a linear model sampled Shapley values converge to the exact linear form."""
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (600, 3)) * np.array([1.0, 3.0, 0.2])
    y = x @ np.array([2.0, 1.0, 5.0]) + rng.normal(0, 0.01, 600)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(600)],
                               "row_id int, a double, b double, c double, label double")
    model = ML.baseline_estimators(600, float(y.std()), "label")["Baseline_LinearRegression"].fit(
        ML.assemble(df, ["a", "b", "c"]))
    exact = {r.feature: r.shap_importance for r in I.linear_shap(model, df, ["a", "b", "c"]).collect()}
    sampled = {r.feature: r.shap_importance for r in
               I.sampled_shap(model, df, ["a", "b", "c"], "row_id", n_rows=100, n_background=100,
                              n_samples=30).collect()}
    for f in "abc":
        assert sampled[f] == pytest.approx(exact[f], abs=0.08)


def test_knn_takes_the_smallest_ids_of_many_ties_and_survives_large_norms():
    import pyarrow as pa

    from tessera.operators.knn import _block_pairs

    def nearest(x, z, ids):
        kind = pa.list_(pa.struct([("id", pa.int64()), ("vec", pa.list_(pa.float64())), ("y", pa.float64())]))
        q = pa.array([[{"id": 0, "vec": list(x), "y": None}]], kind)
        t = pa.array([[{"id": int(i), "vec": list(v), "y": 1.0} for i, v in zip(ids, z)]], kind)
        out = next(_block_pairs(5, len(x))([pa.RecordBatch.from_arrays([q, t], ["q", "t"])]))
        return sorted(out.column(1).to_pylist())
    rng = np.random.default_rng(1)
    assert nearest(np.zeros(4), np.ones((300, 4)), rng.permutation(300)) == [0, 1, 2, 3, 4]
    far = np.full(4, 1e8)
    steps = rng.permutation(300)
    assert nearest(far, far + steps[:, None] * 1e-3, steps) == [0, 1, 2, 3, 4]


def test_forests_of_groups_equal_forests_of_each_group_alone(spark, monkeypatch):
    """Salts and co-grouping change nothing; rows without a group have no score."""
    from tessera.operators import forest as I
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 50 == 7 else "big" if i % 3 else f"g{i % 4}", float(a), None if i % 9 == 0 else float(b))
            for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "i long, g string, a double, b double")

    def scores():
        return {r.i: (r.g, r.score) for r in I.isolation_scores(df, ["a", "b"], ["i"], "g", n_trees=7, psi=32).collect()}
    once = scores()
    monkeypatch.setattr(I, "SALT_ROWS", 40)
    monkeypatch.setattr(I, "TREE_BLOCK", 2)
    assert len(once) == 900 and str(sorted(scores().items())) == str(sorted(once.items()))
    assert all((v is None) == (g is None) for g, v in once.values())
    far = df.withColumn("a", F.when(F.col("i") == 11, 60.0).otherwise(F.col("a")))
    got = {r.i: r.score for r in I.isolation_scores(far.where("g = 'big'"), ["a", "b"], ["i"], "g", n_trees=50, psi=512).collect()}
    assert max(got, key=got.get) == 11


def test_many_groups_send_no_forest_to_the_driver(spark, monkeypatch):
    from tessera.operators import forest as I
    df = spark.range(3000).select("id", (F.col("id") % 1000).cast("string").alias("g"), F.rand(1).alias("a"))
    kind, sent = type(df), []
    monkeypatch.setattr(kind, "toPandas", lambda self: sent.append("toPandas"))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sent.append("broadcast"))
    assert I.isolation_scores(df, ["a"], ["id"], "g", n_trees=3, psi=16).where("score > 0").count() == 3000
    assert sent == []


def test_score_of_a_fixed_forest(spark):
    from tessera.operators import forest as I
    trees = [(4, I.pack_tree([(0, 1.5, 1, 2, 4), (-1, 0.0, -1, -1, 3), (-1, 0.0, -1, -1, 1)])),
             (4, I.pack_tree([(1, 0.0, 1, 2, 4), (-1, 0.0, -1, -1, 2), (0, 5.0, 3, 4, 2), (-1, 0.0, -1, -1, 1), (-1, 0.0, -1, -1, 1)]))]
    df = spark.createDataFrame([(1, 1.0, -1.0), (2, 2.0, 3.0), (3, 9.0, None)], "k int, x double, y double")
    got = {r.k: r.score for r in I.score_rows(df, ["x", "y"], ["k"], trees).collect()}
    c = {n: float(I.avg_path_length([n])[0]) for n in (1, 2, 3, 4)}
    paths = {1: (1 + c[3]) + (1 + c[2]), 2: (1 + c[1]) + (2 + c[1]), 3: (1 + c[1]) + (2 + c[1])}
    assert got == pytest.approx({k: 2 ** (-(p / 2) / c[4]) for k, p in paths.items()})
    assert I.score_rows(df, ["x", "y"], ["k"], []).first().score is None


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 4097])
def test_permuted_is_a_bijection_that_depends_on_the_seed(spark, n):
    from tessera.operators.permutation import permuted, sides
    df = spark.range(n).select("id", *[permuted(F.col("id"), n, F.lit(s), F.lit(7)).alias(f"p{s}") for s in range(3)])
    rows = df.collect()
    for s in range(3):
        assert sorted(r[f"p{s}"] for r in rows) == list(range(n))
    if n >= 97:
        a, b = sides(n)
        assert 0 <= a * b - n < a
        x = np.array([(r.id, r.p0, r.p1) for r in rows], float)
        assert abs(np.corrcoef(x.T) - np.eye(3)).max() < 0.3
        assert sum(r.p0 == r.p1 for r in rows) < 0.05 * n and sum(r.p0 == r.id for r in rows) < 0.05 * n


def test_permutation_importance_equals_the_closed_form(spark):
    """Shuffling x adds 2 * beta^2 * var(x) to the squared error; nothing but row numbers is sorted."""
    from pyspark.ml.regression import LinearRegression

    from tessera.operators import importance as I
    from tessera.operators.models import assemble
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 2)) * [1.0, 3.0]
    df = spark.createDataFrame([(i, float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(x)], "i long, a double, b double, y double")
    model = LinearRegression(labelCol="y", featuresCol="__features").fit(assemble(df, ["a", "b"]))
    got = {r.feature: (r.importance_mean, r.importance_std) for r in I.permutation_importance(model, df, ["a", "b"], "i", "y", n_repeats=5).collect()}
    assert got["a"][0] == pytest.approx(2 * 4 * x[:, 0].var(), rel=0.1) and got["b"][0] == pytest.approx(2 * x[:, 1].var(), rel=0.1)
    assert 0 < got["a"][1] < 0.2 * got["a"][0]


def test_outlier_statistics_match_pandas(spark):
    rng = np.random.default_rng(9)
    y = np.concatenate([rng.normal(size=200), [30.0, -25.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(900, None)], "i long, y double")
    flagged = O.detect_outliers(df, "y", ["i"], z_threshold=2.0, min_methods=2)
    r = O.outlier_statistics(flagged, "y").first()
    q1, q3 = np.quantile(y, [0.25, 0.75])
    z, iqr = abs((y - y.mean()) / y.std()) > 2, (y < q1 - 1.5 * (q3 - q1)) | (y > q3 + 1.5 * (q3 - q1))
    assert (r.n_rows, r.n_z, r.n_iqr, r.total_outliers) == (203, z.sum(), iqr.sum(), (z & iqr).sum())
    assert (r.target_min, r.target_max, r.q1, r.q3) == pytest.approx((y.min(), y.max(), q1, q3))
    assert (r.target_mean, r.target_std, r.upper_bound) == pytest.approx((y.mean(), y.std(ddof=1), q3 + 1.5 * (q3 - q1)))
    none = O.outlier_statistics(flagged.limit(0), "y").first()
    assert (none.n_rows, none.total_outliers, none.outlier_percentage, none.q1) == (0, 0, None, None)


def test_knn_vectors_of_floats_travel_as_floats(spark, monkeypatch):
    from tessera.operators import knn as K
    kept = []
    monkeypatch.setattr(K, "cut_lineage", lambda df, old=K.cut_lineage: kept.append(dict(df.dtypes)["vec"]) or old(df))
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=5).astype("f4")], float(i % 7)) for i in range(80)]
    out = []
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"id long, v array<{kind}>, y double")
        out.append(sorted(map(tuple, K.knn_regress(df.where("id >= 20"), df.where("id < 20"), "id", "v", "y").collect())))
    assert out[0] == out[1] and len(out[0]) == 20
    assert kept == ["array<float>"] * 2 + ["array<double>"] * 2


def test_forest_scores_go_down_the_trees_without_path_lengths_by_row(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[0, 1], x[1, 2] = np.nan, np.inf
    trees = [FN._grow(np.nan_to_num(x[i:i + n]), np.random.default_rng(i), 5) for i, n in enumerate((64, 32, 1))]

    def height(nodes, row):
        node = depth = 0
        while nodes[node][0] >= 0:
            f, threshold, left, right, _ = nodes[node]
            node, depth = left if row[f] < threshold else right, depth + 1
        return depth + FN.avg_path_length([nodes[node][4]])[0]
    want = [2.0 ** (-np.mean([height(t, row) for t in trees]) / FN.avg_path_length([64])[0]) for row in x]
    calls, length = [], FN.avg_path_length
    monkeypatch.setattr(FN, "avg_path_length", lambda n: calls.append(np.size(n)) or length(n))
    assert FN._score(x, FN._forest([FN.pack_tree(t) for t in trees]), 64) == pytest.approx(want, abs=1e-12)
    assert len(calls) == 2
