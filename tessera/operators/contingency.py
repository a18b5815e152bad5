"""Contingency tables of all pairs of text columns (A13) by coded blocks.

Columns with few levels are replaced by codes: the place of the value in the sorted
list of the column's levels, which one aggregation collects (at most ``FEW`` levels a
column).  A task counts the cells of a pair as one histogram over code * levels + code,
adds the histograms of its Arrow batches, and gives its non-empty cells once; Spark
sums them by cell.  No row is copied for its pairs.

Columns with more levels take the long way: one (pair, value, value) row for each row
and pair with such a column, with partial aggregation before the shuffle, over a
bounded number of pairs at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Most levels of a coded column, and most cells of the histograms that a task holds at once.
FEW, CELLS = 256, 8_000_000
#: Pairs that one row is copied for at most.
LONG_PAIRS = 60
_SCHEMA = "c1 string, c2 string, a string, b string, n long"


def few_levels(df: DataFrame, cols: Sequence[str], few: int = FEW, columns_per_job: int = 60) -> dict[str, list[str]]:
    """The sorted levels (as text, without null) of the columns that have at most ``few``."""
    def job(make, names):
        out = {}
        for k in range(0, len(names), columns_per_job):
            mine = names[k:k + columns_per_job]
            row = df.agg(*[make(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(mine)]).first()
            out |= {c: row[f"c{i}"] for i, c in enumerate(mine)}
        return out
    # The sketch keeps wide columns out of the second job; its error leaves at most a few more levels than asked for.
    about = job(lambda c: F.approx_count_distinct(c, 0.02), list(cols))
    found = job(F.collect_set, [c for c in cols if about[c] <= few * 1.1])
    return {c: sorted(v) for c, v in found.items() if len(v) <= few}


def _pair_blocks(levels: dict[str, list[str]]) -> Iterator[list[tuple[str, str]]]:
    block, cells = [], 0
    for x, y in itertools.combinations(levels, 2):
        size = len(levels[x]) * len(levels[y])
        if block and cells + size > CELLS:
            yield block
            block, cells = [], 0
        block.append((x, y))
        cells += size
    if block:
        yield block


def _histograms(pairs: list[tuple[str, str]], names: dict[str, str], levels: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = {c: pa.array(v, pa.string()) for c, v in levels.items()}
        total = {p: np.zeros(len(levels[p[0]]) * len(levels[p[1]]), np.int64) for p in pairs}
        for b in batches:
            code = {c: pc.fill_null(pc.index_in(b.column(names[c]), values[c]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    for c in values}
            for (x, y), sums in total.items():
                i, j = code[x], code[y]
                both = (i >= 0) & (j >= 0)
                sums += np.bincount(i[both] * len(levels[y]) + j[both], minlength=len(sums))
        for (x, y), sums in total.items():
            cell = np.flatnonzero(sums)
            if len(cell):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * len(cell)), pa.array([y] * len(cell)), values[x].take(pa.array(cell // len(levels[y]))),
                     values[y].take(pa.array(cell % len(levels[y]))), pa.array(sums[cell])], ["c1", "c2", "a", "b", "n"])
    return run


def contingency(df: DataFrame, cols: Sequence[str], few: int = FEW) -> DataFrame:
    """Cell counts (c1, c2, a, b, n) of every pair of columns, c1 before c2 in ``cols``; rows with a null in either are left out.

    Values are compared as text.  Columns without any value give no cells.
    """
    cols = list(cols)
    out = df.sparkSession.createDataFrame([], _SCHEMA)
    if len(cols) < 2:
        return out
    levels = {c: v for c, v in few_levels(df, cols, few).items()}
    levels = {c: levels[c] for c in cols if c in levels}
    names = {c: f"c{i}" for i, c in enumerate(cols)}
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in names.items()])
    ship_package(df.sparkSession)
    coded = {c: v for c, v in levels.items() if v}
    for pairs in _pair_blocks(coded):
        used = [c for c in coded if any(c in p for p in pairs)]
        out = out.unionByName(text.select(*[names[c] for c in used]).mapInArrow(
            _histograms(pairs, names, {c: coded[c] for c in used}), _SCHEMA))
    rest = [p for p in itertools.combinations(cols, 2) if p[0] not in levels or p[1] not in levels]
    for k in range(0, len(rest), LONG_PAIRS):
        cells = F.array(*[F.struct(F.lit(x).alias("c1"), F.lit(y).alias("c2"), F.col(names[x]).alias("a"), F.col(names[y]).alias("b"))
                          for x, y in rest[k:k + LONG_PAIRS]])
        out = out.unionByName(text.select(F.inline(cells)).where(F.col("a").isNotNull() & F.col("b").isNotNull())
                              .withColumn("n", F.lit(1).cast("long")))
    return out.groupBy("c1", "c2", "a", "b").agg(F.sum("n").alias("n"))
