"""Exact k-nearest-neighbour regression in blocks.

A bounded sample of training rows serves as pivots.  Every training and query row
belongs to its nearest pivot; a pivot's rows lie within its radius, so by the
triangle inequality the distance of a query cell to a training cell is at least
d(pivots) - both radii and at most d(pivots) + both radii.  A query cell meets
only the training cells that can hold one of its k nearest: those whose lower
bound does not exceed the smallest upper bound that covers k rows.  Cells are cut
into blocks of bounded size; a pair of blocks is one matrix product, the rows
within its rounding error of the k-th are measured exactly, and the best k win.

How much is pruned depends on the data: clustered rows meet few cells, rows that
are spread evenly in many dimensions meet nearly all of them, and the work is
then the blocked product of both sides.

Prediction = mean label of the k nearest (uniform weights, Euclidean distance,
ties by training id).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

MAX_PIVOTS = 1024
BLOCK_ROWS = 1024


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _nearest_pivot(pivots):
    """Adds the nearest pivot and the distance to it."""
    def run(batches):
        p = pivots.value
        for b in batches:
            x = _matrix(b.column("vec"), p.shape[1])
            cell, dist = np.empty(len(x), np.int64), np.empty(len(x))
            for at in range(0, len(x), 1024):
                s = slice(at, at + 1024)
                near = ((x[s] ** 2).sum(1)[:, None] + (p ** 2).sum(1) - 2 * x[s] @ p.T).argmin(1)
                cell[s], dist[s] = near, np.sqrt(((x[s] - p[near]) ** 2).sum(1))
            yield b.append_column("cell", pa.array(cell)).append_column("dist", pa.array(dist))
    return run


def _in_blocks(rows: DataFrame, cells: dict) -> DataFrame:
    """(cell, part, rows): the rows of a cell in parts of about ``BLOCK_ROWS``."""
    parts = F.create_map(*[x for c, r in cells.items() for x in (F.lit(c), F.lit(-(-r["n"] // BLOCK_ROWS)))])
    part = F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("cell")))
    return (rows.groupBy("cell", part.alias("part"))
            .agg(F.collect_list(F.struct("id", "vec", "y")).alias("rows")))


def _block_pairs(k: int, dim: int):
    """(query rows, training rows) -> the k nearest training rows of every query of the pair."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                q, t = b.column(0)[i].values, b.column(1)[i].values
                x, z = _matrix(q.field("vec"), dim), _matrix(t.field("vec"), dim)
                xx, zz = (x ** 2).sum(1), (z ** 2).sum(1)
                d2 = xx[:, None] + zz - 2 * x @ z.T
                # Every row within the rounding error of the k-th one is measured exactly, and cut by distance and id.
                slack = 4 * (dim + 4) * np.finfo(float).eps * (xx + zz.max())
                reach = np.partition(d2, min(len(z), k) - 1, axis=1)[:, min(len(z), k) - 1] + 2 * slack
                order = t.field("id").to_numpy(zero_copy_only=False)
                row, near, dist = [], [], []
                for i in range(len(x)):
                    # ~: a distance that is no number is measured too.
                    c = np.flatnonzero(~(d2[i] > reach[i]))
                    exact = np.sqrt(((x[i] - z[c]) ** 2).sum(1))
                    best = np.lexsort((order[c], exact))[:k]
                    row.append(np.full(len(best), i))
                    near.append(c[best])
                    dist.append(exact[best])
                row, near, dist = map(np.concatenate, (row, near, dist))
                yield pa.RecordBatch.from_arrays(
                    [q.field("id").take(pa.array(row)), t.field("id").take(pa.array(near)),
                     pa.array(dist), t.field("y").take(pa.array(near))], ["qid", "tid", "d", "y"])
    return run


def _cells_of(rows: DataFrame) -> dict:
    return {r["cell"]: r for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()}


def cell_pairs(pivots: np.ndarray, queries: dict, train: dict, k: int) -> list[tuple[int, int]]:
    """The (query cell, training cell) pairs that can hold one of the k nearest."""
    ts = sorted(train)
    n, radius = np.array([train[c]["n"] for c in ts]), np.array([train[c]["r"] for c in ts])
    out = []
    for c in sorted(queries):
        d = np.sqrt(((pivots[ts] - pivots[c]) ** 2).sum(1))
        upper = d + radius + queries[c]["r"]
        order = np.argsort(upper)
        enough = np.searchsorted(np.cumsum(n[order]), k)
        reach = upper[order][enough] if enough < len(ts) else math.inf
        out += [(int(c), int(t)) for t, low in zip(ts, d - radius - queries[c]["r"]) if low <= reach * (1 + 1e-9)]
    return out


def knn_regress(train: DataFrame, queries: DataFrame, id_col: str, vec_col: str, label_col: str,
                k: int = 5) -> DataFrame:
    """``(id, prediction, k_found)`` for every query row.

    Rows without a vector are left out; with fewer than k training rows all of
    them count; without training rows there is no result.
    """
    spark = train.sparkSession
    ship_package(spark)
    # Vectors of floats travel as floats, exactly half of what they would take as doubles, and are measured as doubles.
    floats = all(isinstance(x.schema[vec_col].dataType.elementType, T.FloatType) for x in (train, queries))
    cell = "float" if floats else "double"
    vec = F.col(vec_col).cast(f"array<{cell}>").alias("vec")
    t = train.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), vec, F.col(label_col).cast("double").alias("y"))
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), vec, F.lit(None).cast("double").alias("y"))
    kind = train.schema[id_col].dataType.simpleString()
    n = t.count()
    m = min(MAX_PIVOTS, max(1, math.ceil(math.sqrt(n))))
    sample = t.orderBy(F.xxhash64("id"), "id").limit(m).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], f"`{id_col}` {kind}, prediction double, k_found long")
    pivots = np.array([r["vec"] for r in sample], float)
    shared = spark.sparkContext.broadcast(pivots)
    placed = f"id {kind}, vec array<{cell}>, y double, cell long, dist double"
    t, q = (cut_lineage(x.mapInArrow(_nearest_pivot(shared), placed)) for x in (t, q))
    t_cells, q_cells = _cells_of(t), _cells_of(q)
    pairs = spark.createDataFrame(cell_pairs(pivots, q_cells, t_cells, k), "qcell long, cell long")
    near = (_in_blocks(q, q_cells).select(F.col("cell").alias("qcell"), F.col("rows").alias("q"))
            .join(pairs, "qcell").join(_in_blocks(t, t_cells), "cell").select("q", F.col("rows").alias("t")))
    found = near.mapInArrow(_block_pairs(k, pivots.shape[1]), f"qid {kind}, tid {kind}, d double, y double")
    w = Window.partitionBy("qid").orderBy("d", "tid")
    top = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return (top.groupBy("qid").agg(F.avg("y").alias("prediction"), F.count(F.lit(1)).alias("k_found"))
               .withColumnRenamed("qid", id_col))
