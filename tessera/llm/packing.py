"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents are tokenised where they lie.  A document longer than the capacity is
cut into full pieces and one shorter first piece; full pieces are sequences of
their own.  The other pieces are dealt by hash into shards of a bounded number of
pieces.  Each shard is packed by several islands: a population of packings, whose
crossover injects whole well-filled bins of one parent into the other, removes
the bins that then hold duplicates and best-fits the displaced pieces.  Between
epochs the best packing of each island migrates to the next one of its shard.
The pieces of a shard's loosely filled bins meet those of other shards in the
next level, until one shard is left.
"""

from __future__ import annotations

import base64
import json
import math
import os
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package

#: Characters outside these ranges go through the reference encoder of ``tokenizers`` itself.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")


def _resolve(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of a byte-level BPE vocabulary file of ``tokenizers``.

    The rank file beside it (the same vocabulary) gives equal ids for ordinary
    Latin text several times faster; all else is encoded by ``tokenizers``.
    """

    def __init__(self, vocabulary: str):
        self.path = path = _resolve(vocabulary)
        self.slow = self.fast = None
        # Texts that hold an added token (its id stands for the whole of it) go through ``tokenizers``.
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.unusual = re.compile("|".join([_UNUSUAL.pattern, *map(re.escape, added)]))
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs,
                                          special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and not self.unusual.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:  # only where it is needed: it takes more memory
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def _tokenise(vocabulary: str, capacity: int, end_id: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for batch in batches:
            take, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array(encode(text.as_py() or "") + [end_id], "<u4")
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    take.append(i)
                    rows.append((piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64()))]
                + [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), (), ()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


class Packer:
    """Grouping genetic algorithm over the items of one shard; sizes descend."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)
        big = [s for s in sizes if 2 * s > capacity]
        #: No packing has fewer bins: total volume, and items of more than half a bin that share none.
        self.least = max(math.ceil(sum(sizes) / capacity), len(big))

    def best_fit(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Each item, largest first, to the fullest bin that still has room, or to a new one."""
        sizes, cap = self.sizes, self.capacity
        order = sorted((cap - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
        room, at = [x[0] for x in order], [x[1] for x in order]
        for i in sorted(items):
            s = sizes[i]
            j = bisect_left(room, s)
            if j < len(room):
                left, k = room.pop(j) - s, at.pop(j)
                bins[k].append(i)
            else:
                left, k = cap - s, len(bins)
                bins.append([i])
            if left:
                j = bisect_left(room, left)
                room.insert(j, left)
                at.insert(j, k)
        return bins

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first; of equally many, the more unevenly filled (squares of the loads)."""
        return len(bins), -sum(sum(self.sizes[i] for i in b) ** 2 for b in bins)

    def crossover(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """Inject well-filled bins of ``b`` into ``a``; best-fit what the removed bins held besides."""
        full = [x for x in b if sum(self.sizes[i] for i in x) >= 0.995 * self.capacity] or b
        inject = [x for x in full if self.rng.random() < 0.5]
        placed = {i for x in inject for i in x}
        child, displaced = [list(x) for x in inject], []
        for x in a:
            if placed.isdisjoint(x):
                child.append(list(x))
            else:
                displaced += [i for i in x if i not in placed]
        return self.best_fit(child, displaced)

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Dissolve the loosest bins and a few others; their items are best-fitted in again."""
        order = sorted(range(len(bins)), key=lambda k: sum(self.sizes[i] for i in bins[k]))
        n = max(2, len(bins) // 50)
        out = set(order[:n]) | set(self.rng.sample(range(len(bins)), min(n, len(bins))))
        return self.best_fit([list(b) for k, b in enumerate(bins) if k not in out],
                             [i for k in out for i in bins[k]])

    def evolve(self, elites: list[list[list[int]]], population: int, generations: int, patience: int = 3):
        n = len(self.sizes)
        pool = list(elites)
        if not pool:
            pool.append(self.best_fit([], list(range(n))))
        if len(pool[0]) <= self.least or n < 3:
            return min(pool, key=self.fitness)
        while len(pool) < population:
            # A random part is placed first, the rest best-fitted around it.
            seedlings = self.best_fit([], self.rng.sample(range(n), n // 3))
            placed = {i for b in seedlings for i in b}
            pool.append(self.best_fit(seedlings, [i for i in range(n) if i not in placed]))
        pool.sort(key=self.fitness)
        idle = 0
        for _ in range(generations):
            if len(pool[0]) <= self.least or idle >= patience:
                break
            best = self.fitness(pool[0])
            for _ in range(population // 2):
                a, b = self.rng.sample(pool[:max(2, population // 2 + 1)], 2)
                child = self.mutate(self.crossover(a, b))
                pool.append(child)
            pool = sorted(pool, key=self.fitness)[:population]
            idle = 0 if self.fitness(pool[0]) < best else idle + 1
        return pool[0]


def _islands(capacity: int, population: int, generations: int):
    """(shard, island, sizes, elites) -> (shard, island, n_bins, bins): the island's best packing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, island, sizes, elites in zip(*(c.to_pylist() for c in batch.columns)):
                packer = Packer(sizes, capacity, seed=shard * 1009 + island * 31 + len(elites))
                start = []
                for of in elites:
                    bins: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
                    for i, k in enumerate(of):
                        bins[k].append(i)
                    start.append(bins)
                best = packer.evolve(start, population, generations)
                of = np.empty(len(sizes), np.int32)
                for k, b in enumerate(best):
                    of[b] = k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([island], pa.int32()), pa.array([len(best)], pa.int32()),
                     pa.array([of], pa.list_(pa.int32()))], ["shard", "island", "n_bins", "bins"])
    return run


_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32", "pid")


def _place(capacity: int, loose: int):
    """Explodes a shard's packing: each piece with its bin, offset and whether its bin is loose."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, items, bins in zip(*(batch.column(i) for i in range(3))):
                table = items.values
                length = table.field("length").to_numpy()
                of = bins.values.to_numpy()
                order = np.argsort(of, kind="stable")
                ends = np.cumsum(length[order])
                load = np.bincount(of, weights=length, minlength=of.max() + 1).astype(np.int64)
                offset = np.empty(len(of), np.int64)
                offset[order] = ends - length[order] - np.concatenate(([0], np.cumsum(load)[:-1]))[of[order]]
                yield pa.RecordBatch.from_arrays(
                    [table.field(c) for c in _PIECE]
                    + [pa.array(shard.as_py() * 65536 + of.astype(np.int64), pa.int64()), pa.array(offset, pa.int64()),
                       pa.array(capacity - load[of] > loose, pa.bool_())],
                    [*_PIECE, "bin", "offset", "loose"])
    return run


def pack(docs: DataFrame, *, capacity: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k.json",
         shard_items: int = 2000, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 6,
         loose: int = 4, levels: int = 3) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: empty) and ``end_id``.  Pieces count
    from 0, ``start`` is the number of the document's ids before the piece, and
    ``offset`` its place in its sequence, gapless from 0.  Repeated rows, equal or
    null ids are packed as rows of their own; an empty table gives no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(bounded(_tokenise(vocabulary, capacity, end_id, pa.int64())),
                             "doc_id long, piece long, start long, length long, ids_crc32 long")
    # Written once: row numbers taken here stay the same when a later task is run again.
    pieces = scratch.write(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity)
    done = [full.select(*columns, (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo = pieces.where(F.col("length") < capacity)
    for level in range(levels):
        n = todo.count()
        if not n:
            break
        shards = math.ceil(n / shard_items)
        last = shards == 1 or level == levels - 1
        dealt = (todo.groupBy(F.pmod(F.xxhash64("pid"), F.lit(shards)).alias("shard"))
                 .agg(F.sort_array(F.collect_list(F.struct(
                     F.col("length"), *[c for c in _PIECE if c != "length"])), asc=False).alias("items")))
        dealt = scratch.write(dealt, f"shards-{level}")
        best = None
        for _ in range(epochs):
            base = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                                F.col("items.length").alias("sizes"))
            if best is None:
                base = base.withColumn("elites", F.array().cast("array<array<int>>"))
            else:
                # An island starts from its own best packing and from that of its neighbour in the ring.
                guests = (best.select("shard", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))
                                                         ).alias("island"), "n_bins", "bins")
                          .groupBy("shard", "island")
                          .agg(F.sort_array(F.collect_set(F.struct("n_bins", "bins"))).alias("g"))
                          .select("shard", "island", F.col("g.bins").alias("elites")))
                base = base.join(guests, ["shard", "island"])
            # Little data and much work: a stated number of tasks, which is not merged by size.
            tasks = min(shards * islands, 4 * spark.sparkContext.defaultParallelism)
            base = base.select("shard", "island", "sizes", "elites").repartition(tasks, "shard", "island")
            best = scratch.write(base.mapInArrow(bounded(_islands(capacity, population, generations)),
                                                 "shard long, island int, n_bins int, bins array<int>"), f"best-{level}")
        won = best.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"))
        placed = scratch.write(
            dealt.join(won, "shard").select("shard", "items", "bins")
            .mapInArrow(bounded(_place(capacity, 0 if last else loose)), ", ".join(f"{c} long" for c in _PIECE)
                        + ", bin long, offset long, loose boolean"), f"placed-{level}")
        stay = placed if last else placed.where("not loose")
        done.append(stay.select(*columns, (F.lit(level * 2**60) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        todo = placed.where("loose").select(*_PIECE)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
