"""Target log transform (F4/F5), standard scaling (C9) and PCA."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.target import inverse_log_target, is_finite, log_shift_for_min, log_target
from . import profile as P
from .quantiles import quantiles


# --------------------------------------------------------------------------- F4/F5
@dataclass
class LogTargetModel:
    column: str
    shift: float
    median_log: float | None

    def log_expr(self):
        raw = log_target(self.column, self.shift)
        if self.median_log is None:
            return F.when(is_finite(raw), raw)
        return F.when(is_finite(raw), raw).otherwise(F.lit(self.median_log))

    def transform(self, df: DataFrame, out_col: str = "y_log") -> DataFrame:
        """``log1p(y + shift)``; non-finite results (and missing y) → median of the finite logs."""
        return df.withColumn(out_col, self.log_expr())

    def inverse(self, col: str = "y_log"):
        return inverse_log_target(col, self.shift)

    def report(self, df: DataFrame) -> DataFrame:
        """Skewness (population) before and after, the shift, and replaced values."""
        raw = log_target(self.column, self.shift)
        return df.select(
            F.skewness(F.col(self.column) + F.lit(self.shift)).alias("original_skew"),
            F.skewness(self.log_expr()).alias("log_skew"),
            F.count_if(~is_finite(raw)).alias("n_replaced"),
        ).select(
            (F.round(F.col("original_skew") * 1e6) / 1e6).alias("original_skew"),
            (F.round(F.col("log_skew") * 1e6) / 1e6).alias("log_skew"),
            F.lit(float(self.shift)).alias("shift_applied"),
            "n_replaced")


class LogTarget:
    def fit(self, df: DataFrame, column: str) -> LogTargetModel:
        lo = df.agg(F.min(column)).first()[0]
        shift = log_shift_for_min(lo)
        raw = log_target(column, shift)
        finite = df.select(F.when(is_finite(raw), raw).alias("__l"))
        med = quantiles(finite, "__l", [0.5])[0]
        return LogTargetModel(column, shift, med)


# --------------------------------------------------------------------------- C9
@dataclass
class StandardScalingModel:
    means: dict
    scales: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(self.means[c])) / F.lit(self.scales[c])
                               for c in self.means})


class StandardScaling:
    """(x - mean) / population std, fitted on the rows given (train); std 0 → 1.  NaN is missing."""

    def fit(self, df: DataFrame, cols: Sequence[str]) -> StandardScalingModel:
        df = P.nan_to_null(df)
        exprs = []
        for i, c in enumerate(cols):
            exprs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
        row = P._chunked_agg(df, exprs)
        means, scales = {}, {}
        for i, c in enumerate(cols):
            means[c] = float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0
            s = row[f"s{i}"]
            scales[c] = float(s) if s not in (None, 0.0) and s == s else 1.0
        return StandardScalingModel(means, scales)


# --------------------------------------------------------------------------- C10
@dataclass
class PCAModelInfo:
    k: int
    components: np.ndarray        # d x k loadings (columns are components)
    explained_variance: np.ndarray  # ratio per component (all d)
    feature_cols: list
    signs: list = None            # +1/-1 per component (sign alignment)
    ml_model: object = None       # the fitted Spark ML PCAModel

    def transform(self, df: DataFrame, prefix: str = "PC") -> DataFrame:
        """Project the (already centred) features: one column per component.

        The projection runs inside Spark ML's PCAModel (BLAS per row); the
        first k coordinates are sliced out and sign-aligned.
        """
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        vec = VectorAssembler(inputCols=self.feature_cols, outputCol="__features",
                              handleInvalid="keep")
        proj = self.ml_model.transform(vec.transform(df)).withColumn("__arr", vector_to_array("__pca"))
        keep = [c for c in df.columns if c not in self.feature_cols]
        out = [(F.col("__arr")[j] * F.lit(float(self.signs[j]))).alias(f"{prefix}{j + 1}")
               for j in range(self.k)]
        return proj.select(*keep, *out)

    def reconstruction_error(self, df: DataFrame, prefix: str = "PC") -> float:
        """Mean squared difference of the centred features and their projection back, over all cells.

        The components are orthonormal, so it is the squared length that the projection leaves out.
        """
        centre = df.agg(*[F.avg(c).alias(str(i)) for i, c in enumerate(self.feature_cols)]).first()
        length = sum(((F.col(c) - F.lit(centre[i])) ** 2 for i, c in enumerate(self.feature_cols)), F.lit(0.0))
        moved = df.withColumns({c: F.col(c) - F.lit(centre[i]) for i, c in enumerate(self.feature_cols)})
        kept = sum((F.col(f"{prefix}{j + 1}") ** 2 for j in range(self.k)), F.lit(0.0))
        whole = df.agg(F.avg(length)).first()[0]
        part = self.transform(moved, prefix).agg(F.avg(kept)).first()[0]
        return max(0.0, whole - part) / len(self.feature_cols)

    def loadings_df(self, spark, top: int = 5) -> DataFrame:
        """Top-|loading| features per component."""
        rows = []
        for j in range(self.k):
            order = np.argsort(-np.abs(self.components[:, j]), kind="stable")[:top]
            for r, i in enumerate(order):
                rows.append((j + 1, r + 1, self.feature_cols[i], float(self.components[i, j])))
        return spark.createDataFrame(rows, "component int, rank int, feature string, loading double")


class PCAReduction:
    """PCA on centred features: ``variance`` (0-1 share, k = 1 + #cumulative ≤ share)
    or a fixed ``n_components``.

    The d×d covariance is a distributed aggregation (Spark ML's RowMatrix);
    only the d×d matrix reaches the driver for the eigen-decomposition.  Signs
    are aligned so each component's largest-|loading| entry is positive.
    """

    def __init__(self, variance: float | None = 0.95, n_components: int | None = None):
        self.variance = variance
        self.n_components = n_components

    def fit(self, df: DataFrame, cols: Sequence[str]) -> PCAModelInfo:
        from pyspark.ml.feature import PCA, VectorAssembler
        cols = list(cols)
        vec = VectorAssembler(inputCols=cols, outputCol="__features", handleInvalid="error")
        model = PCA(k=len(cols), inputCol="__features", outputCol="__pca").fit(vec.transform(df))
        pc = np.array(model.pc.toArray(), copy=True)
        ev = np.asarray(model.explainedVariance.toArray())
        signs = []
        for j in range(pc.shape[1]):
            i = int(np.argmax(np.abs(pc[:, j])))
            signs.append(-1.0 if pc[i, j] < 0 else 1.0)
            pc[:, j] = pc[:, j] * signs[-1]
        if self.n_components is not None:
            k = int(self.n_components)
        else:
            k = int(np.searchsorted(np.cumsum(ev), self.variance, side="right") + 1)
        k = max(1, min(k, len(cols)))
        return PCAModelInfo(k, pc[:, :k], ev, cols, signs[:k], model)
