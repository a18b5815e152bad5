"""One-pass column profiles: null census (A5), value-frequency profile (A6),
numeric conversion rates (F2), Pearson pairs (A12), Cramér's V pairs (A13),
correlation with a target (A14).

All of them return small long-form DataFrames (one row per column or per
column pair) computed by aggregations that combine map-side before the
shuffle, so a value or key holding a third of the rows is pre-aggregated in
every task instead of landing in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import parse_number
from ..session import cut_lineage
from .contingency import contingency
from .gram import pearson_pairs

# Aggregate expressions per job: hundreds of expressions in one ``agg`` exceed
# the JVM method-size limits of whole-stage codegen.
MAX_AGGS_PER_JOB = 240

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _unpivot(df: DataFrame, cols: Sequence[str], value_type: str) -> DataFrame:
    """(column, value) rows, one per input cell of ``cols`` (nulls kept)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(value_type).alias("value"))
                      for c in cols])
    return df.select(F.inline(pairs))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every floating-point column as null: one kind of missing value."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def _chunked_agg(df: DataFrame, exprs: list, per_job: int = MAX_AGGS_PER_JOB) -> dict:
    """Run a long list of named aggregate expressions in bounded-size jobs."""
    out = {}
    for i in range(0, len(exprs), per_job):
        row = df.agg(*exprs[i:i + per_job]).first()
        out.update(row.asDict())
    return out


# --------------------------------------------------------------------------- A5
def null_census(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column: ``(column, n_missing, n_rows)``.

    NaN counts as missing, as in pandas.  One aggregation job, unpivoted after
    the aggregation (the stack runs on a single row).
    """
    cols = list(cols or df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}

    def missing(c):
        cond = F.col(c).isNull()
        if isinstance(fields[c], (T.FloatType, T.DoubleType)):
            cond = cond | F.isnan(c)
        return F.count_if(cond)
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[missing(c).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                        F.col(f"m{i}").cast("long").alias("n_missing"))
                               for i, c in enumerate(cols)]))
    return agg.select(stack, F.col("__rows").alias("n_rows"))


# --------------------------------------------------------------------------- A6
NULL_TOKEN = "\u0000<null>"


def value_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: share of the most frequent value (null counts as a value),
    number of distinct values (null included) and the modal value as text.

    All columns go through one ``groupBy(column, value).count()`` over the
    unpivoted cells — a single shuffle of distinct cells whatever the width.
    Ties for the modal value pick the smallest text (nulls sort first); NaN is null.
    """
    cols = list(cols or df.columns)
    cells = _unpivot(nan_to_null(df), cols, "string").withColumn(
        "value", F.coalesce(F.col("value"), F.lit(NULL_TOKEN)))
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    prof = counts.groupBy("column").agg(
        F.max("n").alias("top_count"),
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"))
    return prof.select(
        "column",
        (F.col("top_count") / F.col("n_rows")).alias("top_share"),
        "n_distinct",
        F.when(F.col("top_value") != NULL_TOKEN, F.col("top_value")).alias("top_value"),
        "n_rows")


#: Items that a frequency sketch tracks; a share above a few thousandths is never missed.
TRACKED = 1024


def frequent_values(df: DataFrame, cols: Sequence[str] | None = None, least_share: float = 0.5,
                    columns_per_job: int = 60) -> DataFrame:
    """Columns whose most frequent value covers at least ``least_share`` of the rows, without a shuffle of cells.

    (column, top_count, top_share, top_value, n_rows); null counts as a value, NaN is
    null, and of equally frequent values the smallest text wins (null first).  A
    mergeable frequency sketch over the hashes of the values proposes candidates, its
    estimates never fall below the truth; one pass then counts the candidates exactly.
    """
    cols = list(cols or df.columns)
    least_share = max(least_share, 8 / TRACKED)
    text = nan_to_null(df).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_TOKEN)).alias(f"v{i}")
                                    for i, c in enumerate(cols)])
    text = text.select("*", *[F.xxhash64(f"v{i}").alias(f"h{i}") for i in range(len(cols))])
    jobs = [range(k, min(len(cols), k + columns_per_job)) for k in range(0, len(cols), columns_per_job)]
    found = []
    for mine in jobs:
        most = int(1 / least_share) + 1
        row = text.agg(F.count(F.lit(1)).alias("n"),
                       *[F.expr(f"approx_top_k(h{i}, {most}, {TRACKED})").alias(f"k{i}") for i in mine]).first()
        asked = [(i, item[0]) for i in mine for item in row[f"k{i}"] if item["count"] >= least_share * row.n]
        if not asked:
            continue
        hit = {k: F.col(f"h{i}") == h for k, (i, h) in enumerate(asked)}
        exact = text.agg(*[f(F.when(hit[k], F.col(f"v{i}"))).alias(f"{n}{k}") for k, (i, _) in enumerate(asked)
                           for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
        best: dict[int, tuple] = {}
        for k, (i, _) in enumerate(asked):
            n, value = exact[f"n{k}"], exact[f"low{k}"]
            if value != exact[f"high{k}"]:  # two values with one hash
                r = value_profile(df, [cols[i]]).first()
                n, value = round(r.top_share * r.n_rows), NULL_TOKEN if r.top_value is None else r.top_value
            if n >= least_share * row.n:
                best[i] = min(best.get(i, (-n, value)), (-n, value))
        found += [(cols[i], -n, -n / row.n, None if value == NULL_TOKEN else value, row.n) for i, (n, value) in sorted(best.items())]
    return df.sparkSession.createDataFrame(found, "column string, top_count long, top_share double, top_value string, n_rows long")


def constant_columns(df: DataFrame, threshold: float = 0.95, exclude: Sequence[str] = ()) -> DataFrame:
    """C2 fit: columns whose most frequent value covers ``>= threshold`` of rows."""
    return frequent_values(df, [c for c in df.columns if c not in exclude], threshold)


# --------------------------------------------------------------------------- F2
def conversion_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of non-null text values that parse as numbers, per string column.

    ``(column, n_non_null, n_numeric, rate)``; rate is null for an all-null column.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    exprs = []
    for i, c in enumerate(cols):
        exprs.append(F.count(c).alias(f"nn{i}"))
        exprs.append(F.count(parse_number(c)).alias(f"ok{i}"))
    agg = df.agg(*exprs)
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"nn{i}").alias("n_non_null"),
                                        F.col(f"ok{i}").alias("n_numeric"))
                               for i, c in enumerate(cols)]))
    return agg.select(stack).withColumn(
        "rate", F.try_divide(F.col("n_numeric").cast("double"), F.col("n_non_null").cast("double")))


# --------------------------------------------------------------------------- A12
def pearson_pairs_df(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = pearson_pairs(df, cols)
    return df.sparkSession.createDataFrame(
        rows, "column1 string, column2 string, r double")


def pearson_drop_list(pairs: list[tuple[str, str, float | None]], order: Sequence[str],
                      threshold: float) -> list[str]:
    """C5 (literal one-pass rule): drop column j when any earlier column i has
    |r| > threshold — even if i itself is dropped."""
    pos = {c: k for k, c in enumerate(order)}
    drop = set()
    for a, b, r in pairs:
        if r is None or r != r:
            continue
        if abs(r) > threshold:
            later = b if pos[b] > pos[a] else a
            drop.add(later)
    return [c for c in order if c in drop]


# --------------------------------------------------------------------------- A13
def cramers_v_from_cells(cells: DataFrame) -> DataFrame:
    """Bias-corrected Cramér's V per pair from cell counts.

    χ² = n (Σ n_ab² / (n_a n_b) − 1) over non-zero cells (no continuity
    correction); φ²c = max(0, χ²/n − (k−1)(r−1)/(n−1)); r̃ = r − (r−1)²/(n−1),
    k̃ likewise; V = √(φ²c / min(k̃−1, r̃−1)), null when the denominator is not
    positive or either side has fewer than two levels.
    """
    pair = ["c1", "c2"]
    ra = cells.groupBy(*pair, "a").agg(F.sum("n").alias("na"))
    rb = cells.groupBy(*pair, "b").agg(F.sum("n").alias("nb"))
    terms = (cells.join(ra, pair + ["a"]).join(rb, pair + ["b"])
                  .withColumn("t", F.col("n").cast("double") * F.col("n")
                              / (F.col("na").cast("double") * F.col("nb"))))
    # Levels per side = rows of the margin tables (no count-distinct Expand).
    levels = (ra.groupBy(*pair).agg(F.count(F.lit(1)).cast("double").alias("r"))
                .join(rb.groupBy(*pair).agg(F.count(F.lit(1)).cast("double").alias("k")), pair))
    per = terms.groupBy(*pair).agg(F.sum("n").cast("double").alias("n"),
                                   F.sum("t").alias("s")).join(levels, pair)
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    chi2 = n * (F.col("s") - 1.0)
    phi2c = F.greatest(F.lit(0.0), F.try_divide(chi2, n) - F.try_divide((k - 1) * (r - 1), n - 1))
    rc = r - F.try_divide((r - 1) * (r - 1), n - 1)
    kc = k - F.try_divide((k - 1) * (k - 1), n - 1)
    den = F.least(kc - 1, rc - 1)
    v = F.when((r >= 2) & (k >= 2) & (den > 0), F.sqrt(F.try_divide(phi2c, den)))
    return per.select("c1", "c2", chi2.alias("chi2"), v.alias("cramers_v"),
                      n.cast("long").alias("n"))


def cramers_v_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    # The cells are read four times; they are counted once.
    return cramers_v_from_cells(cut_lineage(contingency(df, cols)))


def recommended_removals(pairs: list, n_unique: dict, threshold: float,
                         include_perfect: bool = False) -> list[str]:
    """For each pair above the threshold (below 1 unless ``include_perfect``),
    drop the column with fewer distinct values (ties: the first by name)."""
    out = []
    for c1, c2, v in pairs:
        if v is None:
            continue
        if v > threshold and (include_perfect or v < 1.0):
            a, b = sorted([c1, c2])
            drop = a if n_unique[a] <= n_unique[b] else b
            if drop not in out:
                out.append(drop)
    return out


# --------------------------------------------------------------------------- A14
def target_correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pearson r of each feature (nulls read as 0) with the target.

    ``(feature, r)``; r is null for a constant feature.
    """
    y = F.col(target).cast("double")
    exprs = []
    for i, c in enumerate(cols):
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        exprs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r{i}"))
    agg = df.agg(*exprs)
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"))
                               for i, c in enumerate(cols)]))
    return agg.select(stack)
