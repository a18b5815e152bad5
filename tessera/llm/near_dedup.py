"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check.

1. Every document becomes its set of word shingles (64-bit hashes); documents
   with the same set form one class, so exact copies are never paired.
2. ``n_hashes`` MinHash values per class are cut into bands; a class meets one
   class of each of its buckets (a star, never all pairs): the one that meets the
   most others over all its buckets, which most copies of one text are near to.
3. Each candidate pair compares its signatures batch by batch and is dropped as
   soon as the posterior probability of reaching the threshold falls below
   ``miss`` (uniform prior: P(J >= t | m of n agree) = P(Binomial(n + 1, t) <= m)).
4. Survivors are verified exactly on their full shingle sets and linked.
5. Classes of buckets that still hold several components are joined exactly by
   prefix filtering: the shingles of a set are ordered from the rarest among
   these classes on, and two sets of the threshold's similarity share one of
   their first n - ceil(t n) + 1, with enough shingles left after the first
   shared one (prefix and positional filter).  First the classes that share such
   a shingle meet the one of them whose shingles are the most common; what is
   left, mostly pairs of which one end differs too much from its group, is then
   joined except inside a component.  So this pairs neither whole buckets nor
   classes already connected, and no two texts that share a band stay unchecked.

The only loss is the chosen one: a pair at the threshold shares no band with
probability at most ``miss``, or is pruned by step 3 with that probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, join_one, ship_package
from .components import connected_components

#: Up to this many ids a document filter is broadcast (about 32 MB); beyond it, Spark joins by shuffle.
BROADCAST_IDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit word hashes, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h
        return h


def shingle_set(text: bytes, k: int, seen: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a UTF-8 text.

    A-Z is lower-cased; words are runs without ASCII white space.  Fewer than k
    words, but not none, make one shingle of the whole sequence.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, n)
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i:n - width + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def hash_parameters(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, n, np.uint64)[:, None]


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signature of a set: the smallest of each hash function, in blocks of bounded memory."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(best, (shingles[None, i:i + 4096] * a + b).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def band_shape(n_hashes: int, threshold: float, miss: float) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at the threshold with probability <= miss."""
    for r in range(n_hashes, 1, -1):
        if (1 - threshold ** r) ** (n_hashes // r) <= miss:
            return r, n_hashes // r
    return 1, n_hashes


def posterior_bounds(n_hashes: int, threshold: float, miss: float, step: int) -> list[tuple[int, int]]:
    """(compared, fewest agreements that keep a pair) after each batch."""
    out = []
    for n in range(step, n_hashes + 1, step):
        total, m = 0.0, -1
        while m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append((n, m))
    return out


def _signatures(k: int, n_hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (a, b) = WordHash(), hash_parameters(n_hashes)
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column(0).cast(pa.binary()):
                s = shingle_set(text.as_py() or b"", k, seen)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(minhash(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.binary())], [*batch.schema.names[1:], "n_shingles", "node", "sig"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                keys, sets = [], []
                for text in batch.column(0).slice(i, 256).cast(pa.binary()):
                    s = shingle_set(text.as_py() or b"", k, seen)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                                                 ["node", "shingles"])
    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) -> one row (node, n, shingle) for every shingle."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            sizes = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes))), pa.array(np.repeat(sizes, sizes), pa.int64()),
                 pa.array(np.concatenate(sets), pa.int64())], ["node", "n", "shingle"])


def _bayes(bounds: list[tuple[int, int]], n_hashes: int):
    """(a, b, sig_a, sig_b) -> (a, b, matches) of the pairs that no batch of the comparison pruned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, n_hashes)
                    for i in (2, 3))
            alive, agree, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in bounds:
                agree[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[agree[alive] >= least], n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)),
                 pa.array(agree[alive], pa.int64())], ["a", "b", "matches"])
    return run


def _exact(percent: int):
    """(a, b, shingles_a, shingles_b) -> the pairs with 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


class _Verifier:
    """Signature and set checks of candidate pairs; keeps the links found so far."""

    def __init__(self, docs, classes, scratch, shingle_words, percent, n_hashes, miss):
        self.docs, self.classes, self.scratch = docs, classes, scratch
        self.k, self.percent, self.n_hashes = shingle_words, percent, n_hashes
        self.bounds = posterior_bounds(n_hashes, percent / 100, miss, max(1, n_hashes // 5))

    def survivors(self, pairs: DataFrame) -> DataFrame:
        sig = self.classes.select("node", "sig")
        both = (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
                .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
                .select("a", "b", "sig_a", "sig_b"))
        return both.mapInArrow(bounded(_bayes(self.bounds, self.n_hashes), 4096), "a binary, b binary, matches long")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """The full shingle sets of some classes, made anew from their texts."""
        ids = self.scratch.write(nodes.join(self.classes, "node").select(F.col("row_key").alias("_key")), "ids")
        few = ids.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(ids) if few else ids, "_key", "left_semi").select("text")
        # Documents that only share a key give further sets; the joins by node leave them out.
        sets = self.scratch.write(
            texts.mapInArrow(bounded(_sets(self.k)), "node binary, shingles binary").dropDuplicates(["node"]), "sets")
        self.scratch.drop(ids)
        return sets

    def prefixes(self, named: DataFrame) -> DataFrame:
        """The rarest shingles of some classes, those that several share: node, n, left, shingle, common.

        ``left`` counts the shingles from this one on: no pair whose first common shingle this is has more in
        common.  ``common`` is the mean number of classes that hold a shingle of this class.
        """
        rows = self.scratch.write(
            self.sets(named).mapInArrow(bounded(_shingle_rows), "node binary, n long, shingle long"), "shingles")
        often = rows.groupBy("shingle").agg(F.count("*").alias("df"))
        # A shingle of one class only takes a place in its class's prefix but joins nothing.
        one = Window.partitionBy("node")
        head = (rows.join(often, "shingle").withColumn("common", F.avg("df").over(one))
                .withColumn("nth", F.row_number().over(one.orderBy("df", "shingle")))
                .where(100 * (F.col("nth") - 1) <= (100 - self.percent) * F.col("n")).where("df > 1"))
        head = head.join(named, "node", "left_semi")
        head = self.scratch.write(head.select("node", "n", (F.col("n") - F.col("nth") + 1).alias("left"), "shingle", "common"),
                                  "prefixes")
        self.scratch.drop(rows)
        return head

    def _centres(self, head: DataFrame) -> DataFrame:
        """For every shingle with classes of several components, the class whose shingles are the most common."""
        return (head.groupBy("shingle").agg(
            F.max_by(F.struct("node", "label", "n", "left"), F.struct("common", "node")).alias("centre"),
            F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows"))
            .where("x <> y").select("shingle", "centre", "rows"))

    def _enough(self, left: tuple, n: tuple):
        return (100 + self.percent) * F.least(*left) >= self.percent * (n[0] + n[1])

    def central_pairs(self, head: DataFrame) -> DataFrame:
        """Pairs (a, b): the centre of each shingle with the classes of other components that share it."""
        rows = join_one(head, self._centres(head), "shingle", "rows", head.count())
        return (rows.where((F.col("label") != F.col("centre.label"))
                           & self._enough(("left", "centre.left"), (F.col("n"), F.col("centre.n"))))
                .select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct())

    def prefix_pairs(self, head: DataFrame) -> DataFrame:
        """All pairs (a, b) of different components that share a shingle of their rarest."""
        head = self.scratch.write(
            join_one(head, self._centres(head), "shingle", "rows", head.count())
            .select("shingle", "node", "label", "n", "left", (F.col("label") == F.col("centre.label")).alias("main")), "open")
        x, y = (head.select("shingle", *(F.col(c).alias(f"{c}_{e}") for c in ("node", "label", "n", "left", "main"))) for e in "xy")
        # The classes around the centre are one component: each pair has at least one end outside it.
        return (x.where("not main_x").join(y, "shingle")
                .where(((F.col("main_y")) | (F.col("node_x") < F.col("node_y"))) & (F.col("label_x") != F.col("label_y"))
                       & self._enough(("left_x", "left_y"), (F.col("n_x"), F.col("n_y"))))
                .select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct())

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full shingle sets reach the threshold."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = (pairs.select("a", "b")
                .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
                .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
                .select("a", "b", "set_a", "set_b"))
        out = self.scratch.write(both.mapInArrow(bounded(_exact(self.percent)), "a binary, b binary"), "links")
        self.scratch.drop(sets)
        return out


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, n_hashes: int = 100,
                    miss: float = 1e-5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, component_key.

    Documents are linked when 100 * |intersection| >= ``percent`` * |union| of
    their sets of ``shingle_words``-word shingles; ``component_id`` is the
    smallest doc_id reachable by links and ``kept`` says doc_id = component_id.
    ``component_key`` names the component also where ids are null or repeated
    (null without shingles).  The ``keep`` columns are carried along.

    Null, empty and blank texts have no shingles, are linked with nothing and
    kept.  Repeated rows give repeated results.  A null doc_id is never the
    smallest of a component that has another; alone, its component is null and
    it is kept.  An empty table gives an empty table; further columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep)
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[1:])
    sigs = scratch.write(docs.mapInArrow(bounded(_signatures(shingle_words, n_hashes)),
                                         f"{carried}, n_shingles long, node binary, sig binary"), "signatures")
    # The text of a class is found again by its smallest doc_id, or, for a null id, by the null.
    classes = scratch.write(
        sigs.where("n_shingles > 0").groupBy("node")
        .agg(F.min("doc_id").alias("min_id"), F.any_value("sig").alias("sig"))
        .withColumn("row_key", F.coalesce("min_id", F.lit(-1))), "classes")
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-1)))
    rows, bands = band_shape(n_hashes, percent / 100, miss)
    v = _Verifier(keyed, classes, scratch, shingle_words, percent, n_hashes, miss)

    keys = [F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * rows * i, 4 * rows)) for i in range(bands)]
    banded = classes.select("node", F.explode(F.array(*keys)).alias("key"))
    buckets = scratch.write(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = scratch.write(join_one(banded, buckets, "key", "size", bands * classes.count()), "members")

    # A star per bucket around the member that meets the most others over all its buckets: the one with the fewest
    # changes, which most copies of a text are near to.  Each class is checked with its likeliest leader, then with the rest.
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    leaders = scratch.write(members.join(met, "node").groupBy("key").agg(
        F.max_by("node", F.struct("met", "node")).alias("leader"), F.count("*").alias("n")), "leaders")
    star = (join_one(members, leaders, "key", "n", members.count()).where("node <> leader")
            .select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    alive = scratch.write(v.survivors(star), "alive")
    best = alive.groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a")).select("a", "b")
    links = v.links(best)
    labels = scratch.write(connected_components(links, scratch), "labels")
    rest = scratch.write(_across(alive.select("a", "b").exceptAll(best), labels), "rest")
    if not rest.isEmpty():
        labels = _merge(labels, v.links(rest), scratch)

    # The rest of the buckets that still hold several components.
    named = members.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = scratch.write(named.join(open_, "key", "left_semi").select("node").distinct(), "open")
    if not rest.isEmpty():
        head = v.prefixes(rest)
        for pairs_of in (v.central_pairs, v.prefix_pairs):
            labelled = head.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            pairs = scratch.write(v.survivors(pairs_of(labelled)), "rest")
            if not pairs.isEmpty():
                labels = _merge(labels, v.links(pairs), scratch)

    named = classes.select("node", "min_id").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("min_id").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id", F.lower(F.hex("label")).alias("component_key"))
    out = sigs.drop("sig").join(named, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "component_key", *keep)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of every component: the smallest doc_id; columns as they were.

    Of rows with that doc_id the one with the smallest text hash stays, and of
    repeated rows one.  Documents without shingles all stay.
    """
    scratch = Scratch(docs.sparkSession)
    # The whole row travels as one column, so no name of it meets a name used here.
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text.alias("text"), F.xxhash64(text).alias("th"))
    marks = scratch.write(near_duplicates(rows, keep=("th",), **options).where("n_shingles > 0")
                          .select("doc_id", "th", "component_key"), "marks")
    place = F.struct("doc_id", "th")
    stays = marks.groupBy("component_key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    lost = scratch.write(
        marks.join(stays, "component_key").groupBy("doc_id", "th")
        .agg(F.count("*").alias("n"), F.bool_or(F.col("first").eqNullSafe(place)).alias("stays"))
        .where("n > 1 or not stays").select(F.col("doc_id").alias("lost_id"), F.col("th").alias("lost_th"), "stays"), "lost")
    few = lost.count() <= BROADCAST_IDS
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("th") == F.col("lost_th"))

    def against(table: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(table) if few else table, same, how)
    out = against(lost, "left_anti").select("row")
    repeated = lost.where("stays")
    if not repeated.isEmpty():  # one of each set of repeated rows
        out = out.unionByName(against(repeated, "left_semi").groupBy("doc_id", "th").agg(F.any_value("row").alias("row"))
                              .select("row"))
    return out.select("row.*")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    for end in ("a", "b"):
        pairs = (pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
                 .withColumn(f"label_{end}", F.coalesce(f"label_{end}", end)))
    return pairs.where("label_a <> label_b").select("a", "b")


def _merge(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after further links: components of the graph whose nodes are the old components."""
    old = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return scratch.write(connected_components(old.unionByName(links), scratch), "labels")
