"""Row numbers of a global order without a window over the whole table.

The rows are sorted across the cluster; a row's number is its place within its
partition plus the sizes of the partitions before (one count per partition
reaches the driver).  The sorted rows are written once, because the partitions
of a sort may be cut elsewhere when a lost task runs again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def number_rows(df: DataFrame, order: Sequence[Column | str], out_col: str) -> DataFrame:
    """``df`` with ``out_col`` = 0, 1, 2, ... in the given order."""
    rows = cut_lineage(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, before = [], 0
    for p in sorted(sizes):
        offsets += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += sizes[p]
    start = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return rows.withColumn(out_col, start + F.col("__at").bitwiseAND(F.lit(2**33 - 1))).drop("__at")
