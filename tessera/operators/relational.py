"""Relational operators of the retrieval and dataset-construction steps.

A1 coherent groups, A2 proportional redistribution, A3/A4 category list and
counts, J1 star join, J2 state-conditioned join, J5 long→wide counts,
J6/J7 group coefficient merge and semi join, P2 row predicate, P3 null-aware
exclusion of whole groups.

Scale notes.  Per-group values are computed with ``groupBy().agg()`` (partial
aggregation before the shuffle) and joined back on the group key instead of a
``Window.partitionBy(key)``: a window sends every row of a hot key to one task,
while the aggregate side is tiny per key and the join side is split by AQE's
skew-join handling (inner / left / semi / anti are all splittable).  No
operator here broadcasts by hint; AQE turns a join into a broadcast join once
the measured size of one side is under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cols(c: str | Sequence[str]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


# --------------------------------------------------------------------------- A1
def coherent_groups(df: DataFrame, group_col: str, declared_col: str) -> DataFrame:
    """Keep rows of groups whose row count equals the group's declared count.

    The declared count is read per group as its smallest non-null value (the
    column is a group attribute, so any non-null value is the same one and no
    row order is needed).  Groups with a null key or a null declared count are
    dropped, as are groups whose rows were lost or fanned out upstream.
    """
    valid = (df.where(F.col(group_col).isNotNull())
               .groupBy(group_col)
               .agg(F.count(F.lit(1)).alias("__n"), F.min(declared_col).alias("__declared"))
               .where(F.col("__n") == F.col("__declared"))
               .select(group_col))
    return df.join(valid, on=group_col, how="left_semi")


# --------------------------------------------------------------------------- A2
def redistribute_total(df: DataFrame, group_col: str, total_col: str,
                       unit_min_col: str, unit_max_col: str, size_col: str,
                       out_col: str = "redistributed_price") -> DataFrame:
    """Apportion a group total over its rows in proportion to an estimate.

    estimate = (unit_min + unit_max) / 2 * size; coefficient = total / sum of
    the group's non-null estimates; out = estimate * coefficient.  A row with a
    null estimate gets null; a group whose estimates are all null or sum to
    zero gets null (``try_divide``) instead of an ANSI error.
    """
    est = ((F.col(unit_min_col) + F.col(unit_max_col)) / F.lit(2.0)) * F.col(size_col)
    with_est = df.withColumn("__est", est.cast("double"))
    coef = (with_est.groupBy(group_col)
                    .agg(F.try_divide(F.min(total_col).cast("double"), F.sum("__est"))
                         .alias("__coef")))
    return (with_est.join(coef, on=group_col, how="left")
                    .withColumn(out_col, F.col("__est") * F.col("__coef"))
                    .drop("__est", "__coef"))


# --------------------------------------------------------------------------- A3/A4
def category_list(categories: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Distinct (id, name) pairs in name order."""
    return categories.select(id_col, name_col).distinct().orderBy(name_col, id_col)


def category_counts(df: DataFrame, entity_col: str, category_col: str,
                    count_col: str = "n") -> DataFrame:
    """Long counts per (entity, category); rows with a null category are not counted."""
    return (df.groupBy(entity_col, category_col)
              .agg(F.count(category_col).alias(count_col)))


# --------------------------------------------------------------------------- F6 / J5
def safe_name(name: str) -> str:
    """Column-name sanitising for generated columns: '-', ' ', '.' → '_'."""
    return str(name).replace("-", "_").replace(" ", "_").replace(".", "_")


def distinct_categories(df: DataFrame, category_col: str) -> list:
    """The sorted distinct category values (each becomes a column of the wide form)."""
    vals = df.where(F.col(category_col).isNotNull()).select(category_col).distinct().collect()
    return sorted(v[0] for v in vals)


def counts_long(df: DataFrame, entity_col: str, category_col: str, entities: DataFrame) -> DataFrame:
    """The wide counts as rows (entity, category, n) for any number of categories, without the zeros of absent pairs."""
    counts = df.where(F.col(category_col).isNotNull()).groupBy(entity_col, category_col).agg(F.count(F.lit(1)).alias("n"))
    return (entities.select(entity_col).distinct().join(counts, entity_col, "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def count_names(categories: list, prefix: str, suffix: str) -> dict:
    """The column of each category; categories that only differ in replaced characters get a number."""
    names: dict = {}
    for c in categories:
        name = f"{prefix}_{safe_name(c)}_{suffix}"
        names[str(c)] = name if name not in names.values() else f"{name}_{sum(n.startswith(name) for n in names.values())}"
    return names


def counts_wide(df: DataFrame, entity_col: str, category_col: str, categories: list,
                prefix: str = "POI", suffix: str = "count",
                entities: DataFrame | None = None) -> DataFrame:
    """Long → wide counts: one ``{prefix}_{category}_{suffix}`` column per category.

    One ``groupBy(entity).pivot(category, values)`` job replaces N left joins.
    Spark limits a pivot to ``spark.sql.pivotMaxValues`` only when it looks for the
    values itself; for more categories than a schema should have, ``counts_long``.
    With ``entities`` every entity is kept and missing counts are 0 (the
    entity × category grid without materialising it).
    """
    wide = (df.where(F.col(category_col).isin(*categories))
              .groupBy(entity_col)
              .pivot(category_col, categories)
              .agg(F.count(F.lit(1))))
    names = count_names(categories, prefix, suffix)
    wide = wide.select(entity_col, *[F.col(f"`{str(c)}`").alias(names[str(c)]) for c in categories])
    if entities is not None:
        wide = entities.select(entity_col).join(wide, on=entity_col, how="left")
    return wide.fillna(0, subset=list(names.values()))


# --------------------------------------------------------------------------- J1
def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, Column | str | list]],
              how: str = "inner") -> DataFrame:
    """Chain of equi-joins from a fact table to its dimensions.

    ``dims`` is a list of (dimension DataFrame, join condition).  Dimension
    sizes are measured at runtime by AQE; small ones become broadcast joins.
    """
    out = fact
    for dim, cond in dims:
        out = out.join(dim, on=cond, how=how)
    return out


# --------------------------------------------------------------------------- P2
def equal_and_present(df: DataFrame, left: str, right: str, present: Sequence[str]) -> DataFrame:
    """Row predicate ``left = right AND present... IS NOT NULL``."""
    cond = F.col(left) == F.col(right)
    for c in present:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


# --------------------------------------------------------------------------- J2
#: Rows of one key up to which they are held as one array; a crowded key is joined state by state.
KEY_ROWS = 10_000


def state_conditioned_join(facts: DataFrame, values: DataFrame, keys: Sequence[str],
                           state_col: str, required: tuple[str, str],
                           optional: Sequence[tuple[str, str]], value_cols: Sequence[str],
                           prefix: str = "OV", key_rows: int = KEY_ROWS) -> DataFrame:
    """Join one value row per state: the required state inner, the others left.

    ``required`` / ``optional`` are (state value, column suffix) pairs; each
    value column comes out as ``{prefix}_{col}_{suffix}``.  One aggregation holds
    the rows of each state of a key as arrays, one join brings them to the facts, and
    the arrays are opened one after the other (the optional ones keep a fact without
    rows), so duplicate (keys, state) rows fan out exactly as a join for each state.
    Arrays hold at most ``key_rows`` rows of a key; the few keys with more are joined
    state by state, where Spark splits them.  A null key matches nothing.
    """
    keys, states = list(keys), [required, *optional]
    used = values.where(F.col(state_col).isin(*[v for v, _ in states])).select(*keys, state_col, *value_cols)
    crowded = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > key_rows).select(*keys)
    row = F.struct(*value_cols)
    rest = used if (plain := crowded.isEmpty()) else used.join(F.broadcast(crowded), keys, "left_anti")
    packed = rest.groupBy(*keys).agg(*[F.collect_list(F.when(F.col(state_col) == F.lit(v), row)).alias(f"__s{i}")
                                       for i, (v, _) in enumerate(states)])
    out = facts.join(packed.where(F.size("__s0") > 0), on=keys, how="inner")
    for i, (_, suffix) in enumerate(states):
        opened = F.explode(f"__s{i}") if i == 0 else F.explode_outer(f"__s{i}")
        out = out.withColumn(f"__r{i}", opened).drop(f"__s{i}")
    out = out.select(*_all(out, without=[f"__r{i}" for i in range(len(states))]),
                     *[F.col(f"__r{i}").getField(c).alias(f"{prefix}_{c}_{s}") for i, (_, s) in enumerate(states) for c in value_cols])
    if plain:
        return out
    few = facts.join(F.broadcast(crowded), keys, "left_semi")
    for (state, suffix), how in [(required, "inner")] + [(o, "left") for o in optional]:
        side = (used.where(F.col(state_col) == F.lit(state)).join(F.broadcast(crowded), keys, "left_semi")
                .select(*keys, *[F.col(c).alias(f"{prefix}_{c}_{suffix}") for c in value_cols]))
        few = few.join(side, on=keys, how=how)
    return out.unionByName(few.select(*out.columns))


def _all(df: DataFrame, without: Sequence[str]) -> list:
    return [F.col(f"`{c}`") for c in df.columns if c not in without]


# --------------------------------------------------------------------------- P3
def exclude_groups(df: DataFrame, key_col: str, bad: DataFrame, bad_key_col: str) -> DataFrame:
    """``key NOT IN (SELECT bad_key FROM bad)`` with SQL's null semantics.

    Spark plans a null-aware anti join that always broadcasts the subquery;
    at scale the bad side can be large, so we first run one small aggregate
    (row count, null-key count) and then use an ordinary, shuffle-able
    ``left_anti`` join:
      * empty subquery → every row is kept (null keys too);
      * a null among the subquery keys → no row is kept;
      * otherwise rows with a null key are dropped and the rest anti-joined.
    """
    stats = bad.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col(bad_key_col).isNull()).alias("n_null")).first()
    if stats["n"] == 0:
        return df
    if stats["n_null"] > 0:
        return df.where(F.lit(False))
    bad_keys = bad.select(F.col(bad_key_col).alias(key_col)).distinct()
    return df.where(F.col(key_col).isNotNull()).join(bad_keys, on=key_col, how="left_anti")


# --------------------------------------------------------------------------- J6/J7
def merge_group_values(df: DataFrame, group_values: DataFrame, group_col: str) -> DataFrame:
    """Left merge of per-group values back onto rows."""
    return df.join(group_values, on=group_col, how="left")


def keep_ids(df: DataFrame, ids: DataFrame, key_col: str) -> DataFrame:
    """Semi join: rows whose key is in the id set."""
    return df.join(ids.select(key_col), on=key_col, how="left_semi")
