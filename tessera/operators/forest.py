"""O3: isolation forest (Liu, Ting & Zhou 2008) as a Spark job.

* sample: a Bernoulli pool of about ``2·ψ·T`` rows (one pass, no shuffle),
  then ψ rows per tree by seeded hash rank within the pool (trees may share
  rows, as independent draws do);
* grow: ``groupBy(group, block of trees).applyInPandas`` — every tree grows from
  at most ψ rows (random feature, uniform split in the node's range, depth
  limit ceil(log2 ψ)) and comes out as one binary row;
* score: s = 2^(-E[h(x)] / c(ψ)) with h = edges to the leaf + c(leaf size), in
  Arrow batches.  One forest (T·(2ψ-1) nodes at most) is broadcast.  Forests of
  groups never pass the driver: rows and forests meet by co-grouping on (group,
  salt), where a group has one salt for every ``SALT_ROWS`` rows, so a task holds
  one forest and a bounded number of rows whatever the group's size;
* threshold: rows whose score is above the exact (1 − contamination)
  quantile of the scores are outliers (``grouped_quantiles``, distributed).

``group_col`` grows and scores one forest per group (per-category detection).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .quantiles import grouped_quantiles, quantiles

EULER = 0.5772156649015329
TREE_SCHEMA = "grp string, psi long, tree int, nodes binary"
#: A node in a tree's binary row.
NODE = np.dtype([("feature", "<i4"), ("threshold", "<f8"), ("left", "<i4"), ("right", "<i4"), ("size", "<f8")])
#: Trees that one task grows, and rows of a group that one task scores.
TREE_BLOCK, SALT_ROWS = 25, 20_000


def avg_path_length(n):
    """c(n): average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list:
    """One isolation tree as node rows (feature, threshold, left, right, size)."""
    nodes = []

    def build(idx, depth):
        nid = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return nid
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if len(candidates) == 0:
            return nid
        f = int(rng.choice(candidates))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        if len(left) == 0 or len(right) == 0:
            return nid
        nodes[nid][0], nodes[nid][1] = f, thr
        nodes[nid][2] = build(left, depth + 1)
        nodes[nid][3] = build(right, depth + 1)
        return nid

    build(np.arange(len(x)), 0)
    return nodes


def _grow_udf(features: Sequence[str], max_depth: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        grp, psi, rows = pdf["__grp"].iloc[0], int(pdf["__psi"].iloc[0]), []
        salt = zlib.crc32(str(grp).encode())
        for tree, mine in pdf.groupby("__tree", sort=True):
            x = mine[list(features)].to_numpy(dtype=float)
            nodes = _grow(x, np.random.default_rng([seed, int(tree), salt]), max_depth)
            rows.append((grp, psi, int(tree), pack_tree(nodes)))
        return pd.DataFrame(rows, columns=["grp", "psi", "tree", "nodes"])
    return grow


def pack_tree(nodes: Sequence) -> bytes:
    """(feature, threshold, left, right, size) nodes, the root first; feature -1 is a leaf."""
    return np.array([tuple(n) for n in nodes], NODE).tobytes()


def _forest(trees: Sequence[bytes]) -> tuple:
    """Dense (trees, nodes) tables of the five fields."""
    each = [np.frombuffer(t, NODE) for t in trees]
    table = np.zeros((len(each), max(map(len, each))), NODE)
    for row, t in zip(table, each):
        row[:len(t)] = t
    return tuple(np.ascontiguousarray(table[f]) for f in NODE.names)


def _depths(forest) -> tuple[np.ndarray, int]:
    """The depth of every node, and of the deepest."""
    feat, _, left, right, _ = forest
    depth, level = np.zeros(feat.shape), 0
    tree, node = np.arange(len(feat)), np.zeros(len(feat), dtype=np.int64)
    while True:
        depth[tree, node] = level
        inner = feat[tree, node] >= 0
        tree, node = tree[inner], node[inner]
        if not len(tree):
            return depth, level
        node = np.concatenate([left[tree, node], right[tree, node]])
        tree, level = np.concatenate([tree, tree]), level + 1


def _score(x: np.ndarray, forest, psi: int) -> np.ndarray:
    feat, thr, left, right, size = forest
    n, inner = len(x), feat >= 0
    # A leaf is its own child, so all rows go down as often as the deepest tree has levels.
    own = np.broadcast_to(np.arange(feat.shape[1]), feat.shape)
    child = np.stack([np.where(inner, left, own), np.where(inner, right, own)], axis=2).reshape(len(feat), -1)
    asked = np.where(inner, feat, 0).astype(np.int64)
    depth, levels = _depths(forest)
    height = depth + avg_path_length(size)
    total, cells, first = np.zeros(n), np.ascontiguousarray(x).ravel(), np.arange(n) * x.shape[1]
    for t in range(len(feat)):
        node = np.zeros(n, dtype=np.int64)
        for _ in range(levels):
            go_right = ~(cells.take(first + asked[t].take(node)) < thr[t].take(node))
            node = child[t].take(2 * node + go_right)
        total += height[t].take(node)
    mean_h = total / feat.shape[0]
    return np.power(2.0, -mean_h / avg_path_length([psi])[0])


def isolation_scores(df: DataFrame, features: Sequence[str], key_cols: Sequence[str],
                     group_col: str | None = None, n_trees: int = 100, psi: int = 256,
                     seed: int = 42) -> DataFrame:
    """Anomaly score in (0, 1] per row (higher = more isolated).

    Returns ``key_cols`` (+ group) and ``score``.  Nulls in features read as 0; rows
    without a group have no forest and no score (null).
    """
    features = list(features)
    spark = df.sparkSession
    ship_package(spark)
    grp = F.col(group_col).cast("string") if group_col else F.lit("")
    base = df.select(*key_cols, grp.alias("__grp"),
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    # Per-group sampling parameters: one row per group, joined by key (a
    # size-checked broadcast), so any number of groups costs no extra code.
    counts = base.groupBy("__grp").agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n").cast("double")
    frac = F.least(F.lit(1.0), F.lit(2.0 * psi * n_trees) / n)
    params = cut_lineage(counts.select(
        "__grp", "__n", frac.alias("__frac"),
        F.least(F.lit(psi).cast("long"), F.col("__n")).alias("__psi"),
        F.least(F.lit(1.0), F.lit(2.0 * psi) / F.greatest(F.lit(1.0), frac * n)).alias("__cand")))

    def unit(h):
        return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)
    keyc = [F.col(c) for c in key_cols]
    from .encoding import sized_broadcast
    with_p = base.join(sized_broadcast(params), "__grp")
    pool = with_p.where(unit(F.xxhash64(*keyc, F.lit(seed))) < F.col("__frac"))
    rank_key = F.xxhash64(*keyc, F.col("__tree"), F.lit(seed + 1))
    from pyspark.sql import Window
    w = Window.partitionBy("__grp", "__tree").orderBy(rank_key, *key_cols)
    samples = (pool.withColumn("__tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
                   .where(unit(F.xxhash64(*keyc, F.col("__tree"), F.lit(seed + 2))) < F.col("__cand"))
                   .withColumn("__rk", F.row_number().over(w))
                   .where(F.col("__rk") <= F.col("__psi"))
                   .drop("__rk", "__frac", "__cand", "__n"))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    trees = (samples.withColumn("__block", F.floor(F.col("__tree") / TREE_BLOCK)).groupBy("__grp", "__block")
                    .applyInPandas(_grow_udf(features, max_depth, seed), TREE_SCHEMA))
    if not group_col:
        return score_rows(base.drop("__grp"), features, key_cols, [(t.psi, t.nodes) for t in trees.collect()])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("tree", "nodes"))), lambda t: t.nodes)  # n_trees at most
    forests = cut_lineage(trees.groupBy("grp").agg(F.max("psi").alias("psi"), ordered.alias("trees")))
    scored = _score_groups(with_p.select(*key_cols, "__grp", "__n", *features), forests, features, key_cols)
    none = base.where("__grp is null").select(*key_cols, "__grp", F.lit(None).cast("double").alias("score"))
    return scored.unionByName(none).withColumnRenamed("__grp", group_col).select(*key_cols, group_col, "score")


def score_rows(df: DataFrame, features: Sequence[str], key_cols: Sequence[str], trees: Sequence[tuple[int, bytes]]) -> DataFrame:
    """``key_cols`` and the ``score`` of every row by one given forest: (sample size, packed nodes) of its trees.

    Nulls in features read as 0; without trees there is no score (null).
    """
    ship_package(df.sparkSession)
    psi = max((p for p, _ in trees), default=0)
    forest = df.sparkSession.sparkContext.broadcast(_forest([t for _, t in trees]) if trees else None)
    features, key_cols = list(features), list(key_cols)
    rows = df.select(*key_cols, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(features)])

    def score(batches):
        for pdf in batches:
            x = pdf[[f"__f{i}" for i in range(len(features))]].to_numpy(dtype=float)
            found = np.full(len(pdf), np.nan) if forest.value is None else _score(x, forest.value, psi)
            yield pdf[key_cols].assign(score=found)
    return rows.mapInPandas(score, _schema(df.select(*key_cols)) + ", score double")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _score_groups(rows: DataFrame, forests: DataFrame, features: list[str], key_cols: Sequence[str]) -> DataFrame:
    """Scores by the forest of the row's group; a group without a forest (no sampled row) gives null."""
    keys = list(key_cols)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.floor(F.col("__n") / SALT_ROWS) + 1))
    sizes = salted.groupBy(F.col("__grp").alias("grp"), F.col("__salt").alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    placed = forests.join(sizes, "grp")

    def score(pdf: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        found = np.full(len(pdf), np.nan)
        if len(forest) and len(pdf):
            found = _score(pdf[features].to_numpy(dtype=float), _forest(forest["trees"].iloc[0]), int(forest["psi"].iloc[0]))
        return pdf[keys + ["__grp"]].assign(score=found)
    return (salted.groupBy("__grp", "__salt").cogroup(placed.groupBy("grp", "salt"))
            .applyInPandas(score, _schema(rows.select(*keys)) + ", __grp string, score double"))


def isolation_flags(df: DataFrame, features: Sequence[str], key_cols: Sequence[str],
                    contamination: float = 0.1, group_col: str | None = None,
                    n_trees: int = 100, psi: int = 256, seed: int = 42) -> DataFrame:
    """Rows whose score exceeds the exact (1 − contamination) score quantile
    (per group when ``group_col``).  Returns keys (+group), score, is_outlier."""
    # Scored once: the quantile and the flags read the written scores.
    scored = cut_lineage(isolation_scores(df, features, key_cols, group_col, n_trees, psi, seed))
    if not group_col:
        cut = quantiles(scored, "score", [1.0 - contamination])[0]
        flag = F.col("score") > F.lit(cut) if cut is not None else F.lit(False)
        return scored.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))
    cut = grouped_quantiles(scored, [group_col], "score", [1.0 - contamination]).select(
        group_col, F.col("q_0").alias("__cut"))
    # One row per group: broadcast after a size check.
    from .encoding import sized_broadcast
    out = scored.join(sized_broadcast(cut), on=group_col, how="left")
    return out.withColumn("is_outlier", F.coalesce(F.col("score") > F.col("__cut"), F.lit(False))).drop("__cut")
