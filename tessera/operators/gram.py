"""Pairwise-complete Pearson correlations (A12) by masked Gram matrices.

With X the columns (missing cells 0) and M their presence (1 or 0), the six sums of
every pair of columns over the rows where both are present are entries of four matrix
products: M'M, X'M, (X*X)'M and X'X.  Each task adds the products of its Arrow batches
and gives one row for each pair; the rows are summed by partial aggregation.  So the
number of jobs and scans does not depend on the number of pairs.  Columns are taken in
blocks, which bounds the matrices of a task.

Columns are shifted and scaled by the mean and deviation of the first rows.  Only if that
leaves a column's variance small against what was summed, its mean and deviation over all
rows are found in a pass of their own, and the products are made again.  Where the
variance of a pair's rows is still small (a column that hardly varies where the other is
present), or a column holds infinities, the pair goes through Spark's own moments, which
do not cancel.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Columns of one block; a task holds four matrices of two blocks.
BLOCK_COLUMNS = 256
#: Aggregates of one job.
AGGS = 240
#: A variance below this share of the mean square has lost too many digits.
CANCELLED = 1e-6
#: Rows whose mean and deviation are taken first.
FIRST_ROWS = 1000
_SUMS = "n double, si double, sj double, qi double, qj double, p double"


def _cells(b: pa.RecordBatch) -> np.ndarray:
    """A line for each column from the lists of the rows' cells; missing cells are NaN."""
    return np.ascontiguousarray(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each column of which a task has numbers: how many, the ends, the mean and the squares around it."""
    total: dict[int, tuple] = {}
    with np.errstate(all="ignore"):
        for b in batches:
            for i, x in enumerate(_cells(b)):
                x = x[~np.isnan(x)]
                if len(x):
                    mean = x.mean()
                    new = len(x), x.min(), x.max(), mean, ((x - mean) ** 2).sum()
                    if i in total:
                        n, low, high, before, m2 = total[i]
                        step, of = mean - before, len(x) / (n + len(x))
                        new = (n + len(x), min(low, new[1]), max(high, new[2]), before + step * of, m2 + new[4] + step * step * n * of)
                    total[i] = new
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), *(pa.array([float(v[k]) for v in total.values()], pa.float64()) for k in range(5))],
        ["i", "n", "low", "high", "mean", "m2"])


def _listed(numbers: DataFrame, names: Sequence[str]) -> DataFrame:
    """The cells of each row as one list, NaN as null.

    Spark evaluates the columns of such a list in methods of their own, so that of
    many computed columns none is too long for the JVM to compile.
    """
    return numbers.select(F.transform(F.array(*names), lambda v: F.nanvl(v, F.lit(None).cast("double"))).alias("cells"))


def _sizes(numbers: DataFrame) -> dict[str, float | None]:
    """Least and greatest value, mean and deviation of every column: one pass, one row for each task and column."""
    out: dict[str, float | None] = {f"{t}{c}": None for c in numbers.columns for t in ("low", "high", "mean", "dev")}
    rows = _listed(numbers, numbers.columns).mapInArrow(_moments, "i int, n double, low double, high double, mean double, m2 double")
    of = rows.groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("m2").alias("m2"),
                               (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
                               F.collect_list(F.struct("n", "mean")).alias("tasks"))
    between = F.aggregate("tasks", F.lit(0.0), lambda s, t: s + t.n * (t.mean - F.col("mean")) * (t.mean - F.col("mean")))
    for r in of.withColumn("dev", F.sqrt((F.col("m2") + between) / F.col("n"))).drop("tasks").collect():
        out |= {f"{t}{numbers.columns[r.i]}": r[t] for t in ("low", "high", "mean", "dev")}
    return out


def _products(first: int, second: int, width: int, shift: np.ndarray, scale: np.ndarray):
    """Rows (i, j, sums) of a task for pairs of the first ``width`` columns with the rest, or among themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _cells(b)
            m = ~np.isnan(x)
            x = (x - shift[:, None]) / scale[:, None]
            x[~m] = 0.0
            m = m.astype(float)
            # The presence, the cells and their squares of one side, each with each of the other.
            with np.errstate(all="ignore"):
                left, right = (np.concatenate([v[s] for v in (m, x, x * x)]) for s in (
                    slice(0, width), slice(0, width) if second == first else slice(width, None)))
                new = left @ right[:2 * (len(right) // 3)].T if second == first else left @ right.T
                total = new if total is None else total + new
        if total is not None:
            w = width if second == first else total.shape[1] // 3
            def part(k: int, h: int) -> np.ndarray:
                # On one side both ways are the same products.
                return part(h, k).T if second == first and h == 2 else total[k * width:(k + 1) * width, h * w:(h + 1) * w]
            i, j = np.triu_indices(width) if second == first else (g.ravel() for g in np.indices((width, w)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i + first, pa.int32()), pa.array(j + second, pa.int32()),
                 *(pa.array(part(*s)[i, j]) for s in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)))],
                ["i", "j", "n", "si", "sj", "qi", "qj", "p"])
    return run


def _by_moments(df: DataFrame, names: Sequence[str], pairs: list[tuple[int, int]]) -> dict:
    """r of single pairs by Spark's moments, in jobs of a bounded number of aggregates."""
    out = {}
    for k in range(0, len(pairs), AGGS // 3):
        exprs = []
        for i, j in pairs[k:k + AGGS // 3]:
            both = F.col(names[i]).isNotNull() & F.col(names[j]).isNotNull()
            a, b = F.when(both, F.col(names[i])), F.when(both, F.col(names[j]))
            exprs.append(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{i},{j}"))
        for name, r in df.agg(*exprs).first().asDict().items():
            out[tuple(map(int, name.split(",")))] = r
    return out


def _sums_of_pairs(plain: DataFrame, mine: list[int], shift: np.ndarray, scale: np.ndarray) -> dict:
    """The sums of every pair (i <= j) of the columns at ``mine``: one pass for each two blocks of columns."""
    out = {}
    for a, c in itertools.combinations_with_replacement(range(0, len(mine), BLOCK_COLUMNS), 2):
        left, right = mine[a:a + BLOCK_COLUMNS], mine[c:c + BLOCK_COLUMNS]
        both = left if a == c else left + right
        rows = _listed(plain, [plain.columns[i] for i in both]).mapInArrow(
            _products(a, c, len(left), shift[both], scale[both]), f"i int, j int, {_SUMS}")
        for s in rows.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in ("n", "si", "sj", "qi", "qj", "p")]).collect():
            out[mine[s.i], mine[s.j]] = s
    return out


def _variances(s) -> tuple[float, float] | None:
    """Of both columns over the rows of a pair; None where too few digits are left."""
    out = []
    for q, x in ((s.qi / s.n, s.si / s.n), (s.qj / s.n, s.sj / s.n)):
        v = q - x * x
        if not math.isfinite(v) or v <= CANCELLED * max(q, 1e-12):
            return None
        out.append(v)
    return tuple(out)


def pearson_pairs(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, str, float | None]]:
    """Pearson r of every pair (i < j) of ``cols`` over the rows where both are present.

    NaN counts as missing.  r is null where one of the two is constant over these rows,
    or where there are none.
    """
    cols = list(cols)
    names = [f"c{i}" for i in range(len(cols))]
    numbers = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(n)
                          for c, n in zip(cols, names)])
    ship_package(df.sparkSession)
    plain = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)])
    if not cols:
        return []
    # Any shift and scale serve that leave digits enough: those of the first rows, if they do.
    size = _sizes(plain.limit(FIRST_ROWS))
    shift, scale = (np.array([v if (v := size[f"{t}{c}"]) is not None and math.isfinite(v) and (v > 0 or t == "mean") else d
                              for c in names]) for t, d in (("mean", 0.0), ("dev", 1.0)))
    sums = _sums_of_pairs(plain, list(range(len(cols))), shift, scale)
    flat = {i for i in range(len(cols)) if (i, i) not in sums or not sums[i, i].n}
    unsure, wild = [i for i in range(len(cols)) if i not in flat and _variances(sums[i, i]) is None], set()
    if unsure:
        size = _sizes(plain.select(*[names[i] for i in unsure]))
        flat |= {i for i in unsure if size[f"low{names[i]}"] == size[f"high{names[i]}"]}
        wild = {i for i in unsure if i not in flat and not (
            math.isfinite(size[f"mean{names[i]}"]) and math.isfinite(size[f"dev{names[i]}"]) and size[f"dev{names[i]}"] > 0)}
        again = [i for i in unsure if i not in flat and i not in wild]
        if again:
            for i in again:
                shift[i], scale[i] = size[f"mean{names[i]}"], size[f"dev{names[i]}"]
            sums = _sums_of_pairs(plain, [i for i in range(len(cols)) if i not in flat and i not in wild], shift, scale)
    r: dict[tuple[int, int], float | None] = {p: None for p in itertools.combinations(range(len(cols)), 2)}
    moments = [p for p in r if (p[0] in wild or p[1] in wild) and not (p[0] in flat or p[1] in flat)]
    for (i, j), s in sums.items():
        if i != j and s.n and not {i, j} & (flat | wild):
            v = _variances(s)
            if v is None:
                moments.append((i, j))
            else:
                r[i, j] = (s.p / s.n - s.si * s.sj / s.n ** 2) / math.sqrt(v[0] * v[1])
    r |= _by_moments(numbers, names, moments)
    return [(cols[i], cols[j], v) for (i, j), v in r.items()]
