"""Exact quantiles (linear interpolation) without buffering whole groups.

Spark's ``percentile`` / ``median`` keep a value→count map per group, which is
unbounded for continuous values at scale and puts a hot group's whole value
set in one task.  This operator is exact and bounded:

1. one aggregation per group: ``count`` and ``approx_percentile`` at
   ``p ± 2/accuracy`` — a first range around the target ranks;
2. the rows are counted per bucket of every target's range (and below and
   above it), combined before the shuffle; the bucket that holds the rank is
   the next range, until it holds one value.  A rank that the sketch's range
   missed lies in the bucket below or above, so no case needs a second way.

One path for every size; a group's targets are at most ``BUCKETS`` rows at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_ACCURACY = 10000
BUCKETS = 1024
# A target table of up to this many rows (about 100 bytes each) is broadcast.
BROADCAST_TARGETS = 200_000


def _bucket(v, lo, hi):
    """Bucket of ``v`` in [lo, hi], its two ends alone in theirs; -1 below, ``BUCKETS`` above."""
    share = F.try_divide(v / 4 - lo / 4, hi / 4 - lo / 4)
    inner = F.when(F.isnan(share) | share.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    return (F.when(v < lo, -1).when(v > hi, BUCKETS).when(v == lo, 0).when(v == hi, BUCKETS - 1)
            .otherwise(1 + F.floor(inner * (BUCKETS - 3)).cast("int")))


def grouped_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                      probs: Sequence[float], accuracy: int = DEFAULT_ACCURACY,
                      out_prefix: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles of ``value_col`` per group.

    Returns one row per group with ``n`` (non-null count) and one column per
    probability named ``{out_prefix}_{i}`` (i = position in ``probs``).  Nulls
    and NaN are ignored; a group with no values has no row, but without groups
    there is always one row, with null quantiles if there are no values.
    """
    g = list(group_cols)
    single = not g
    v = F.col(value_col).cast("double")
    base = df.select(*g, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if single:  # one global group: a constant key, and the target table is broadcast
        g = ["__grp"]
        base = base.withColumn("__grp", F.lit(0))
    eps = 2.0 / accuracy
    near = [min(1.0, max(0.0, p + e)) for p in probs for e in (-eps, eps)]
    stats = base.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_percentile("__v", F.array(*[F.lit(x) for x in near]), accuracy).alias("__br"))
    rank = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    wanted = F.array(*[F.struct(f(h).cast("long").alias("k"), F.get("__br", F.lit(2 * i)).alias("lo"),
                                F.get("__br", F.lit(2 * i + 1)).alias("hi"))
                       for i, h in enumerate(rank) for f in (F.floor, F.ceil)])
    stats = cut_lineage(stats.select(*g, "n", F.explode(wanted).alias("t")).groupBy(*g, "n", "t.k").agg(
        F.min("t.lo").alias("__lo"), F.max("t.hi").alias("__hi")))
    targets = stats.select(*g, "k", "__lo", "__hi", F.lit(0).cast("long").alias("__below"), F.lit(None).cast("double").alias("__val"))
    few = single or stats.count() <= BROADCAST_TARGETS
    first = True
    while True:
        todo = targets.where(F.col("__val").isNull())
        if not first and todo.isEmpty():
            break
        joined = base.join(F.broadcast(todo) if few else todo, g)
        if not first:
            joined = joined.where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
        first = False
        keys = [*g, "k"]
        counts = (joined.groupBy(*keys, "__below", _bucket(F.col("__v"), F.col("__lo"), F.col("__hi")).alias("__b"))
                  .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__x"), F.max("__v").alias("__y")))
        # At most BUCKETS + 2 rows per target.
        along = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        picked = (counts.withColumn("__end", F.col("__below") + F.sum("__c").over(along))
                  .where((F.col("k") < F.col("__end")) & (F.col("k") >= F.col("__end") - F.col("__c"))))
        new = picked.select(*keys, F.col("__x").alias("__lo"), F.col("__y").alias("__hi"),
                            (F.col("__end") - F.col("__c")).alias("__below"),
                            F.when(F.col("__x") == F.col("__y"), F.col("__x")).alias("__val"))
        targets = cut_lineage(targets.where(F.col("__val").isNotNull()).unionByName(new))
    found = stats.select(*g, "k", "n").join(targets.select(*g, "k", "__val"), [*g, "k"])
    at = found.groupBy(*g, "n").agg(F.map_from_entries(F.collect_list(F.struct("k", "__val"))).alias("__m"))

    def between(h):
        low, high = (F.element_at("__m", f(h).cast("long")) for f in (F.floor, F.ceil))
        return low + (h - F.floor(h)) * (high - low)
    out = at.select(*g, "n", *[between(h).alias(f"{out_prefix}_{i}") for i, h in enumerate(rank)])
    if single:
        empty = df.sparkSession.range(1).select(F.lit(0).alias("__grp"))
        out = empty.join(out, "__grp", "left").select(
            F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[f"{out_prefix}_{i}" for i in range(len(probs))])
    return out


def quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
              accuracy: int = DEFAULT_ACCURACY) -> list[float | None]:
    """Global exact quantiles of one column, returned to the driver (a few numbers)."""
    row = grouped_quantiles(df, [], value_col, probs, accuracy).first()
    if row is None:  # no non-null values
        return [None] * len(probs)
    return [row[f"q_{i}"] for i in range(len(probs))]
