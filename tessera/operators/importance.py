"""Feature importance (E1-E5): built-in, ensemble mean, permutation, linear
Shapley values, and the method comparison with an average-tie rank.

Permutation importance draws the seeded permutations of all features and
repeats by a keyed bijection of row numbers (``permutation``), scores all
shuffled copies in one job, and reports MSE(shuffled) −
MSE(original), mean and population std over repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import average_rank
from .models import FEATURES, assemble
from .numbering import number_rows
from .permutation import permuted


def basic_importance(model: Model, features: Sequence[str], name: str,
                     spark: SparkSession) -> DataFrame:
    """Tree importances or |coefficients|, normalised to sum 1, with a real rank (Q21)."""
    if hasattr(model, "featureImportances"):
        raw = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "coefficients"):
        raw = [abs(float(v)) for v in model.coefficients.toArray()]
    else:
        raise ValueError("model has neither featureImportances nor coefficients")
    total = sum(raw)
    rows = [(name, f, (v / total) if total > 0 else 0.0) for f, v in zip(features, raw)]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    return df.withColumn("rank", average_rank(F.col("importance"), ["model"], descending=True))


def ensemble_importance(member_importance: DataFrame, name: str) -> DataFrame:
    """Mean importance over the ensemble's members."""
    return (member_importance.groupBy("feature").agg(F.avg("importance").alias("importance"))
                             .withColumn("model", F.lit(name)))


def permuted_rows(base: DataFrame, row_id: str, features: Sequence[str], n: int, n_repeats: int,
                  seed: int = 42) -> DataFrame:
    """Every row once per (feature, repeat), with that feature's value from a seeded permutation of the rows.

    ``run`` = feature index * n_repeats + repeat.  A row's value goes to the row whose
    number a keyed bijection of its own number gives, so nothing is sorted but the rows
    once, for their numbers.  The values meet by place (one for each run) before the
    rows do, so the whole rows are shuffled once and not for each run.
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(len(features) * n_repeats - 1))).alias("run")
    values = F.array(*[F.col(f).cast("double") for f in features])

    def which(run):
        return F.floor(run / n_repeats).cast("int")
    natural = number_rows(base, [F.col(row_id)], "pos")
    given = (natural.select("pos", values.alias("__x"), runs)
             .select(permuted(F.col("pos"), n, F.col("run"), F.lit(seed)).alias("pos"),
                     F.struct("run", F.get("__x", which(F.col("run"))).alias("value")).alias("__g"))
             .groupBy("pos").agg(F.collect_list("__g").alias("__g")))
    rows = natural.join(given, "pos").select(*natural.columns, F.explode("__g").alias("__g")).withColumn("run", F.col("__g.run"))
    return rows.withColumns({f: F.when(which(F.col("run")) == j, F.col("__g.value")).otherwise(F.col(f).cast("double"))
                             for j, f in enumerate(features)}).drop("__g", "pos")


def permutation_importance(model: Model, df: DataFrame, features: Sequence[str], row_id: str,
                           label: str, n_repeats: int = 10, seed: int = 42,
                           name: str = "model") -> DataFrame:
    """(model, feature, importance_mean, importance_std) on the given rows.

    All (feature, repeat) runs are scored in one job: mean squared error with the
    permuted feature minus the plain one, mean and population std over repeats.
    """
    features = list(features)
    base = df.select(row_id, label, *features).persist()
    error = (F.col(label) - F.col("prediction")) ** 2
    plain = model.transform(assemble(base, features)).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("e")).first()
    rows = permuted_rows(base, row_id, features, plain["n"], n_repeats, seed)
    runs = model.transform(assemble(rows, features)).groupBy("run").agg(F.avg(error).alias("e")).collect()
    base.unpersist()
    drops: dict = {}
    for r in sorted(runs, key=lambda r: r["run"]):
        drops.setdefault(features[r["run"] // n_repeats], []).append(r["e"] - plain["e"])
    out = []
    for f, v in drops.items():
        m = sum(v) / len(v)
        out.append((name, f, m, (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5))
    return df.sparkSession.createDataFrame(
        out, "model string, feature string, importance_mean double, importance_std double")


def linear_shap(model: Model, df: DataFrame, features: Sequence[str], name: str = "model",
                background: DataFrame | None = None) -> DataFrame:
    """E4 (linear models): φ_j = coef_j · (x_j − mean_j), importance = mean |φ_j|
    normalised to sum 1.  Exact, as column expressions over all rows."""
    coefs = [float(v) for v in model.coefficients.toArray()]
    bg = background if background is not None else df
    means = bg.fillna(0.0, subset=list(features)).agg(*[F.avg(f).alias(f) for f in features]).first()
    filled = df.fillna(0.0, subset=list(features))
    agg = filled.agg(*[F.avg(F.abs(F.lit(c) * (F.col(f) - F.lit(means[f] or 0.0)))).alias(f)
                       for f, c in zip(features, coefs)]).first()
    total = sum(agg[f] or 0.0 for f in features)
    rows = [(name, f, (agg[f] or 0.0) / total if total > 0 else 0.0) for f in features]
    return df.sparkSession.createDataFrame(rows, "model string, feature string, shap_importance double")


def compare_methods(basic: DataFrame | None, shap: DataFrame | None,
                    perm: DataFrame | None) -> DataFrame:
    """E5: join the methods by feature, average the available ones, rank (average ties)."""
    parts = []
    if basic is not None:
        parts.append(basic.select("feature", F.col("importance").alias("basic_importance")))
    if shap is not None:
        parts.append(shap.select("feature", "shap_importance"))
    if perm is not None:
        parts.append(perm.select("feature", F.col("importance_mean").alias("permutation_importance"),
                                 F.col("importance_std").alias("permutation_std")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "feature", "full")
    cols = [c for c in out.columns if "importance" in c and "std" not in c]
    present = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in cols]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))
    n = sum(present[1:], present[0])
    out = out.withColumn("average_importance", F.try_divide(total, n.cast("double")))
    return out.withColumn("rank", average_rank(F.col("average_importance"), descending=True))


def global_importance(per_model: DataFrame, value_col: str = "importance") -> DataFrame:
    """D4 + A19: models × features wide with 0 for a missing pair, and the mean
    over models per feature (one name for it: ``global_average``, Q23)."""
    models = sorted(r[0] for r in per_model.select("model").distinct().collect())
    wide = per_model.groupBy("feature").pivot("model", models).agg(F.first(value_col)).fillna(0.0, subset=models)
    mean = sum((F.col(f"`{m}`") for m in models[1:]), F.col(f"`{models[0]}`")) / float(len(models))
    return wide.withColumn("global_average", mean)


def sampled_shap(model: Model, df: DataFrame, features: Sequence[str], row_id: str,
                 name: str = "model", n_rows: int | None = None, n_background: int = 100,
                 n_samples: int = 20, seed: int = 42) -> DataFrame:
    """E4 (any model): Monte-Carlo Shapley values (Štrumbelj & Kononenko 2014).

    For an explained row x, feature j and sample m: a random feature order
    (seeded hash ranks) and a random background row z give two synthetic
    rows — features up to and including j in the order from x, the rest from z
    (x+) and the same without j (x−); φ_j ≈ mean_m f(x+) − f(x−).  One order
    serves all features, so its rows are scored once for each step.  All rows
    are explained unless ``n_rows`` asks for a seeded-hash sample; the background
    is a sample of ``n_background`` rows; the synthetic rows
    (rows · n_samples · (d + 1)) are scored by ``model.transform`` in one job.
    Importance = mean |φ_j| over explained rows, normalised to sum 1.
    """
    from pyspark.ml.functions import array_to_vector
    feats = list(features)
    d = len(feats)
    vec = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats])
    keyed = df.select(F.col(row_id).alias("__rid"), vec.alias("__x"))
    explained = keyed if n_rows is None else keyed.orderBy(F.xxhash64("__rid", F.lit(seed)), "__rid").limit(n_rows)
    # The background sample has at most n_background rows: numbering it with
    # a window over that bounded sample is cheap.
    bg_order = F.xxhash64("__rid", F.lit(seed + 1))
    background = (keyed.orderBy(bg_order, "__rid").limit(n_background)
                       .select(F.row_number().over(Window.orderBy(bg_order, "__rid")).alias("__b"),
                               F.col("__x").alias("__z")))
    n_bg = background.count()
    samples = (explained.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
                        .withColumn("__b", (F.pmod(F.xxhash64("__rid", "__m", F.lit(seed + 2)),
                                                   F.lit(n_bg)) + 1).cast("int")))
    # n_background rows at most: a bounded broadcast
    s = samples.join(F.broadcast(background), "__b")
    s = s.select("*", *[F.xxhash64("__rid", "__m", F.lit(k), F.lit(seed + 3)).alias(f"__h{k}") for k in range(d)])
    # A feature's place in the order; the index breaks ties.
    place = [sum(((F.col(f"__h{i}") < F.col(f"__h{k}")) if i > k else (F.col(f"__h{i}") <= F.col(f"__h{k}"))).cast("int")
                 for i in range(d) if i != k) + F.lit(0) for k in range(d)]
    s = s.select("__rid", "__x", "__z", *[p.alias(f"__p{k}") for k, p in enumerate(place)])
    # x- of a feature is x+ of the one before it: d + 1 rows for an order, the first without any feature of x.
    steps = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*[
        F.when(F.col(f"__p{k}") < t, F.col("__x")[k]).otherwise(F.col("__z")[k]) for k in range(d)]).alias("v")) for t in range(d + 1)])
    rows = s.select("__rid", *[f"__p{k}" for k in range(d)], F.explode(steps).alias("__s"))
    scored = model.transform(rows.select("__rid", *[f"__p{k}" for k in range(d)], F.col("__s.t").alias("__t"),
                                         array_to_vector(F.col("__s.v")).alias(FEATURES)))
    phi = scored.groupBy("__rid").agg(*[
        (F.sum(F.when(F.col("__t") == F.col(f"__p{k}") + 1, F.col("prediction"))
               .when(F.col("__t") == F.col(f"__p{k}"), -F.col("prediction")).otherwise(0.0)) / F.lit(float(n_samples))).alias(f"__f{k}")
        for k in range(d)])
    imp = (phi.agg(*[F.avg(F.abs(f"__f{k}")).alias(f"__f{k}") for k in range(d)])
              .select(F.posexplode(F.array(*[f"__f{k}" for k in range(d)])).alias("__j", "__imp")).where("__imp is not null"))
    total = imp.agg(F.sum("__imp")).first()[0] or 0.0
    names = df.sparkSession.createDataFrame(list(enumerate(feats)), "__j int, feature string")
    return (imp.join(names, "__j")
               .select(F.lit(name).alias("model"), "feature",
                       (F.col("__imp") / F.lit(total if total > 0 else 1.0)).alias("shap_importance")))
