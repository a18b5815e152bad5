"""Positional splits without a global window: W1-W4, A9, V1, V5.

The reference splits a sorted table by row position.  A global
``row_number()`` would pull every row into one task, so instead we find the
*boundary rows* — the rows at positions ``b`` of the ordering — and assign each
row by a lexicographic comparison with those boundaries, a pure column
expression (no shuffle).

Boundaries come from bucket histograms: one job counts the rows of every bucket
of the current value ranges of *all* boundaries together; the bucket that holds
a boundary's rank becomes its next range, until the range holds one value.  A
range of a few months ends after one job, a 64-bit hash order of any number of
rows after three.  What reaches the driver is at most ``BUCKETS`` counts per
boundary.  Ordering keys must be unique in their last column (the tie-break)
for positions to be well defined (Q14).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NumericType, ShortType, StringType

BUCKETS = 4096
_CHUNK = 6  # bytes of a string that one 48-bit key holds
_LAST = 2 ** 63 - 1  # stands for null, after every other value


def order_keys(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Numeric expressions whose lexicographic order is that of ``cols``.

    Integers and floating-point numbers stand for themselves, dates and
    timestamps for their microseconds, strings for their bytes, six at a time.
    Nulls (and NaN) come last.
    """
    out = []
    for c in cols:
        t = df.schema[c].dataType
        if isinstance(t, (ByteType, ShortType, IntegerType, LongType)):
            out.append(F.coalesce(F.col(c).cast("long"), F.lit(_LAST)))
        elif isinstance(t, NumericType):
            v = F.col(c).cast("double")
            out.append(F.coalesce(F.when(~F.isnan(v), v), F.lit(sys.float_info.max)))
        elif isinstance(t, StringType):
            raw = F.encode(F.col(c), "UTF-8")
            longest = df.agg(F.max(F.octet_length(c))).first()[0] or 0
            out += [F.when(F.col(c).isNull(), F.lit(_LAST)).otherwise(F.conv(F.rpad(F.hex(F.substring(raw, 1 + i, _CHUNK)), 2 * _CHUNK, "0"), 16, 10).cast("long"))
                    for i in range(0, max(1, longest), _CHUNK)]
        else:
            out.append(F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(_LAST)))
    return out


def _bucket(v: Column, lo, hi) -> Column:
    """A bucket number that never falls when ``v`` grows; ``lo <= v <= hi``."""
    if isinstance(lo, int) and hi - lo < 2 ** 62:
        width = (hi - lo) // BUCKETS + 1
        return F.floor((v - F.lit(lo)) / F.lit(float(width)))
    span = float(hi) / BUCKETS - float(lo) / BUCKETS
    return F.floor((v.cast("double") - F.lit(float(lo))) / F.lit(span)).cast("long")


def boundaries(df: DataFrame, keys: Sequence[Column], positions: Sequence[int]) -> dict:
    """For each 0-based position, the ordering tuple of the row at that position (all positions at once)."""
    todo = {int(p): [(), int(p), None] for p in positions}
    if not todo:
        return {}
    rows = df.select(*[k.alias(f"k{j}") for j, k in enumerate(keys)])
    ends = rows.agg(*[f(f"k{j}").alias(f"{n}{j}") for j in range(len(keys)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    while todo:
        ranges = sorted({(prefix, r or (ends[f"lo{len(prefix)}"], ends[f"hi{len(prefix)}"]))
                         for prefix, _, r in todo.values()})
        part, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (prefix, (lo, hi)) in enumerate(ranges):
            v = F.col(f"k{len(prefix)}")
            inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
            for j, x in enumerate(prefix):
                inside = inside & (F.col(f"k{j}") == F.lit(x))
            part = F.when(inside, F.lit(i)).otherwise(part)
            bucket = F.when(inside, F.lit(0).cast("long") if lo == hi else _bucket(v, lo, hi).cast("long")).otherwise(bucket)
        value = [f"k{j}" for j in sorted({len(p) for p, _ in ranges})]
        counted = (rows.select(part.alias("part"), bucket.alias("bucket"), *value).where(F.col("part").isNotNull())
                   .groupBy("part", "bucket")
                   .agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{m}_{v}") for v in value
                                                        for m, f in (("lo", F.min), ("hi", F.max))]).collect())
        by_part: dict = {}
        for r in sorted(counted, key=lambda r: (r["part"], r["bucket"])):
            by_part.setdefault(ranges[r["part"]], []).append(r)
        for p, (prefix, k, r) in list(todo.items()):
            j = len(prefix)
            for b in by_part[prefix, r or (ends[f"lo{j}"], ends[f"hi{j}"])]:
                if k < b["n"]:
                    break
                k -= b["n"]
            lo, hi = b[f"lo_k{j}"], b[f"hi_k{j}"]
            todo[p] = [(*prefix, lo), k, None] if lo == hi else [prefix, k, (lo, hi)]
            if len(todo[p][0]) == len(keys):
                out[p] = todo.pop(p)[0]
    return out


def before(keys: Sequence[Column], tup: tuple) -> Column:
    """Row ordering tuple < ``tup`` (lexicographic)."""
    expr = None
    for k, x in list(zip(keys, tup))[::-1]:
        lt = k < F.lit(x)
        expr = lt if expr is None else (lt | ((k == F.lit(x)) & expr))
    return expr


def block_index(keys: Sequence[Column], bounds: dict) -> Column:
    """How many of the boundary positions lie at or before the row's position."""
    expr = F.lit(0)
    for p in sorted(bounds):
        expr = expr + F.when(before(keys, bounds[p]), F.lit(0)).otherwise(F.lit(1))
    return expr


# --------------------------------------------------------------------------- W1/W2
def temporal_key(year: str, month: str) -> Column:
    """year*12 + month; missing → after every real month (pandas sorts NaN last)."""
    return F.coalesce(F.col(year).cast("long") * 12 + F.col(month).cast("long"),
                      F.lit(2 ** 62))


@dataclass
class SplitSizes:
    n: int
    train: int
    val: int
    test: int


def temporal_sizes(n: int, test_size: float, val_size: float) -> SplitSizes:
    """test_idx = int(n(1-t)), val_idx = int(test_idx(1-v)) (Q15: v is a share of train+val)."""
    test_idx = int(n * (1 - test_size))
    val_idx = int(test_idx * (1 - val_size))
    return SplitSizes(n, val_idx, test_idx - val_idx, n - test_idx)


def temporal_split(df: DataFrame, year: str, month: str, tiebreak: str,
                   test_size: float = 0.1, val_size: float = 0.22,
                   split_col: str = "split") -> DataFrame:
    """Exact-fraction split by position in (year*12+month, tiebreak) order."""
    keyed = df.withColumn("__tk", temporal_key(year, month))
    n = keyed.count()
    s = temporal_sizes(n, test_size, val_size)
    cols = order_keys(keyed, ["__tk", tiebreak])
    pos = [p for p in (s.train, s.train + s.val) if p < n]
    bnd = boundaries(keyed, cols, pos)
    expr = F.lit("test")
    if s.train + s.val < n:
        expr = F.when(before(cols, bnd[s.train + s.val]), F.lit("val")).otherwise(expr)
    else:
        expr = F.lit("val")
    if s.train < n:
        expr = F.when(before(cols, bnd[s.train]), F.lit("train")).otherwise(expr)
    else:
        expr = F.lit("train")
    return keyed.withColumn(split_col, expr).drop("__tk")


# --------------------------------------------------------------------------- W3
def random_sizes(n: int, test_size: float, val_size: float) -> SplitSizes:
    """Two-stage sizes: test = ceil(t n); val = ceil(v/(1-t) · (n - test)) (Q15)."""
    n_test = math.ceil(test_size * n)
    rest = n - n_test
    n_val = math.ceil(val_size / (1 - test_size) * rest)
    return SplitSizes(n, rest - n_val, n_val, n_test)


def random_order(key: str, seed: int) -> Column:
    """Seeded pseudo-random order value of a key (reproducible, no state)."""
    return F.xxhash64(F.col(key), F.lit(seed))


def random_split(df: DataFrame, key: str, seed: int = 42, test_size: float = 0.1,
                 val_size: float = 0.2, order: Column | None = None,
                 split_col: str = "split") -> DataFrame:
    """Exact-size random split — test, then val, in seeded hash order."""
    ordered = df.withColumn("__ro", order if order is not None else random_order(key, seed))
    n = ordered.count()
    s = random_sizes(n, test_size, val_size)
    cols = order_keys(ordered, ["__ro", key])
    b = [s.test, s.test + s.val]
    pos = [p for p in b if p < n]
    bnd = boundaries(ordered, cols, pos)
    expr = F.lit("train") if s.test + s.val < n else F.lit("val")
    if s.test + s.val < n:
        expr = F.when(before(cols, bnd[s.test + s.val]), F.lit("val")).otherwise(expr)
    if s.test < n:
        expr = F.when(before(cols, bnd[s.test]), F.lit("test")).otherwise(expr)
    else:
        expr = F.lit("test")
    return ordered.withColumn(split_col, expr).drop("__ro")


# --------------------------------------------------------------------------- W4
def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, order: Column | None = None,
          fold_col: str = "fold", rows: Column | None = None) -> DataFrame:
    """Shuffled K-fold: the first n mod k folds have one more row (positions in hash order).

    With ``rows`` only the rows for which it is true have folds; the others get null.
    """
    ordered = df.withColumn("__ro", order if order is not None else random_order(key, seed))
    keys = order_keys(ordered, ["__ro", key])
    folded = ordered if rows is None else ordered.where(rows)
    n = folded.count()
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    starts, acc = [], 0
    for sz in sizes[:-1]:
        acc += sz
        starts.append(acc)
    block = block_index(keys, boundaries(folded, keys, [p for p in starts if p < n]))
    return ordered.withColumn(fold_col, block if rows is None else F.when(rows, block)).drop("__ro")


def timeseries_blocks(df: DataFrame, order_cols: Sequence[str], k: int = 5,
                      block_col: str = "block") -> DataFrame:
    """Expanding folds: s = n // (k+1); fold i tests positions
    [n-(k-i)s, n-(k-i-1)s) and trains on everything before.  ``block`` = number
    of fold starts at or before the row: fold i trains on block <= i and tests
    on block == i + 1."""
    n = df.count()
    s = n // (k + 1)
    starts = [n - (k - i) * s for i in range(k)]
    keys = order_keys(df, order_cols)
    return df.withColumn(block_col, block_index(keys, boundaries(df, keys, [p for p in starts if 0 <= p < n])))


def fold_table(df: DataFrame, block_col: str = "block", k: int = 5) -> DataFrame:
    """Long (fold, role) membership for expanding folds, one row per (row, fold)
    the row takes part in — k rows per input row at most."""
    folds = F.array(*[F.lit(i) for i in range(k)])
    return (df.withColumn("fold", F.explode(folds))
              .where(F.col(block_col) <= F.col("fold") + 1)
              .withColumn("role", F.when(F.col(block_col) == F.col("fold") + 1, F.lit("test"))
                          .otherwise(F.lit("train"))))


# --------------------------------------------------------------------------- A9
def split_moments(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """Target mean / sample std / min / max / count per split."""
    return df.groupBy(split_col).agg(
        F.count(target).alias("n"), F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"), F.min(target).alias("min"), F.max(target).alias("max"))


def mean_drift(df: DataFrame, target: str, split_col: str = "split") -> float | None:
    """max(|val−train|, |test−train|) / train mean (three numbers to the driver)."""
    m = {r[split_col]: r["mean"] for r in split_moments(df, target, split_col).collect()}
    tr = m.get("train")
    if not tr:
        return None
    return max(abs(m.get("val", tr) - tr), abs(m.get("test", tr) - tr)) / tr


# --------------------------------------------------------------------------- V1
def temporal_gaps(df: DataFrame, key: Column, split_col: str = "split") -> DataFrame:
    """V1 input: min / max month key per split."""
    return df.groupBy(split_col).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def temporal_validity(df: DataFrame, year: str, month: str, min_gap_months: int = 1,
                      split_col: str = "split") -> dict:
    """V1: gaps min(val) − max(train) and min(test) − max(val) must be ≥ min_gap."""
    key = F.col(year).cast("long") * 12 + F.col(month).cast("long")
    g = {r[split_col]: r for r in temporal_gaps(df, key, split_col).collect()}
    gv = g["val"]["min_key"] - g["train"]["max_key"]
    gt = g["test"]["min_key"] - g["val"]["max_key"]
    return {"gap_train_val": gv, "gap_val_test": gt,
            "valid": gv >= min_gap_months and gt >= min_gap_months}


# --------------------------------------------------------------------------- V5
def allclose(df: DataFrame, a: str, b: str, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Aggregate: every row has |a − b| ≤ atol + rtol·|b| (the numpy ``allclose`` rule)."""
    bad = F.abs(F.col(a) - F.col(b)) > (F.lit(atol) + F.lit(rtol) * F.abs(F.col(b)))
    return F.count_if(bad) == 0


def drift_df(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """A9 as a one-row table: train/val/test means and the relative mean drift."""
    m = (df.groupBy().pivot(split_col, ["train", "val", "test"]).agg(F.avg(target)))
    tr, va, te = F.col("train"), F.col("val"), F.col("test")
    return m.select(tr.alias("mean_train"), va.alias("mean_val"), te.alias("mean_test"),
                    F.try_divide(F.greatest(F.abs(va - tr), F.abs(te - tr)), tr).alias("drift"))


def temporal_validity_df(df: DataFrame, key: Column, min_gap_months: int = 1,
                         split_col: str = "split") -> DataFrame:
    """V1 as a one-row table of month gaps between consecutive splits."""
    g = (df.withColumn("__k", key).groupBy().pivot(split_col, ["train", "val", "test"])
           .agg(F.min("__k").alias("lo"), F.max("__k").alias("hi")))
    gv = F.col("val_lo") - F.col("train_hi")
    gt = F.col("test_lo") - F.col("val_hi")
    return g.select(gv.alias("gap_train_val"), gt.alias("gap_val_test"),
                    ((gv >= min_gap_months) & (gt >= min_gap_months)).alias("valid"))
