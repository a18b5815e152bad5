"""Exact BM25 top-k search: sharded inverted index with block-max pruning.

Documents are indexed where they lie, in shards of a bounded number of documents
and words: for every term its postings in document order, cut into blocks of
``BLOCK`` neighbouring documents.  Document frequencies and the mean length are
summed over all shards, so every shard scores with the global statistics.

Queries run block by block of a stated query set, a few dozen of them at a time in a
shard.  Terms that most pairs of a query and a document share are the columns of two
matrices; all others are added posting by posting.  A query's upper bound for each block
of documents is the product of its weights with the blocks' maxima of the common terms,
and the highest sum of the others in the block.  Only blocks whose bound reaches the
threshold of a query are multiplied, in single precision; what comes near the k-th score
is worked out again in double precision, so rounding never decides.  A task keeps the
best k of all its shards for each query, starts the next shard from their k-th score,
and gives them once; the tasks are merged: a document is left out only if k others score
at least as high.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package
from .decontaminate import words_of
from .near_dedup import WordHash

#: Bounds of a shard, neighbouring documents of a block, and words of the queries that run at once.
SHARD_DOCS, SHARD_WORDS, BLOCK, QUERY_WORDS = 4096, 2_000_000, 64, 2_000_000
_INDEX = "docs binary, lengths binary, nulls binary, terms binary, starts binary, post_doc binary, post_tf binary"
_TYPES = (np.int64, np.int64, np.bool_, np.uint64, np.int64, np.uint16, np.int32)


def build_shard(ids: list[int | None], texts: list[np.ndarray]) -> list[bytes]:
    """The index of some documents, given the hashes of their words."""
    lengths = np.array([len(t) for t in texts], np.int64)
    term = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    order = np.lexsort((doc, term))
    term, doc = term[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(term)))
    term, doc = term[at], doc[at]
    terms, starts = np.unique(term, return_index=True)
    parts = (np.array([i or 0 for i in ids], np.int64), lengths, np.array([i is None for i in ids], bool), terms,
             np.append(starts, len(term)), doc, tf)
    return [x.astype(t).tobytes() for x, t in zip(parts, _TYPES)]


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = WordHash()
    ids, texts, words = [], [], 0

    def shard() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in build_shard(ids, texts)],
                                          [c.split()[0] for c in _INDEX.split(", ")])
    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            w = words_of(text.as_py() or b"")
            ids.append(i.as_py())
            texts.append(np.fromiter(map(seen.__getitem__, w), np.uint64, len(w)))
            words += len(w)
            if len(ids) >= SHARD_DOCS or words >= SHARD_WORDS:
                yield shard()
                ids, texts, words = [], [], 0
    if ids:
        yield shard()


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = WordHash()
    for batch in batches:
        rows = []
        for text in batch.column(1).cast(pa.binary()):
            w = words_of(text.as_py() or b"")
            rows.append(np.unique(np.fromiter(map(seen.__getitem__, w), np.uint64, len(w)), return_counts=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([t.tobytes() for t, _ in rows], pa.binary()),
             pa.array([c.astype(np.int32).tobytes() for _, c in rows], pa.binary()),
             pa.array([len(t) for t, _ in rows], pa.int64())], ["query_id", "terms", "counts", "n"])


def _loaded(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate(_TYPES)]


def _frequencies(shared):
    """Documents of a task's shards that hold each term of the queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, starts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((0, np.uint64), (1, np.int64)))
                place = np.searchsorted(vocabulary, terms)
                here = np.flatnonzero(place < len(vocabulary))
                here = here[vocabulary[place[here]] == terms[here]]
                df[place[here]] += starts[here + 1] - starts[here]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], ["term", "df"])
    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of some ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


#: Queries whose scores are worked out together, and what a rounded sum of positive numbers may be off by.
CHUNK, SLACK = 64, 2e-4
#: A term is common, and multiplied as a column, from this share of (query, document) pairs on; at most so many terms are.
COMMON_SHARE, COMMON_TERMS = 1 / 300, 1024


#: Tasks of a search, so that each has shards enough to reach high scores.
TASKS_PER_CORE = 4


class Queries:
    """Queries that run together: weights of common terms as a matrix, those of all others as a list by query.

    Terms are places in the sorted ``vocabulary``; ``at`` has where each query's begin.
    """

    def __init__(self, at: np.ndarray, place: np.ndarray, weights: np.ndarray, vocabulary: np.ndarray, common: np.ndarray):
        self.n, self.vocabulary, self.common = len(at) - 1, vocabulary, common
        slot = np.full(len(vocabulary), -1)
        slot[common] = np.arange(len(common))
        row, column = np.repeat(np.arange(self.n), np.diff(at)), slot[place]
        often = column >= 0
        self.matrix = np.zeros((self.n, len(common)))
        self.matrix[row[often], column[often]] = weights[often]
        self.rounded = self.matrix.astype(np.float32)
        self.row, self.place, self.weight = row[~often], place[~often], weights[~often]
        self.at = np.searchsorted(self.row, np.arange(self.n + 1))


class Shard:
    """One shard ready to be searched: impacts of postings, and of common terms as a matrix with its block maxima."""

    def __init__(self, parts: list[np.ndarray], k1: float, b: float, mean_length: float):
        self.ids, lengths, self.null, self.terms, self.starts, self.doc, tf = parts
        norm = k1 * (1 - b + b * lengths / mean_length)
        self.impact = tf * (k1 + 1) / (tf + norm[self.doc])
        self.n_blocks = -(-len(self.ids) // BLOCK)

    def prepare(self, queries: Queries) -> None:
        """Where the terms of the queries have their postings here."""
        place = np.searchsorted(queries.vocabulary, self.terms)
        here = np.flatnonzero(place < len(queries.vocabulary))
        here = here[queries.vocabulary[place[here]] == self.terms[here]]
        self.first, self.count = np.zeros(len(queries.vocabulary), np.int64), np.zeros(len(queries.vocabulary), np.int64)
        self.first[place[here]], self.count[place[here]] = self.starts[here], self.starts[here + 1] - self.starts[here]
        size = self.count[queries.common]
        post = _ranges(self.first[queries.common], size)
        # The last block is filled up with documents that have no words.
        self.matrix = np.zeros((self.n_blocks * BLOCK, len(queries.common)))
        self.matrix[self.doc[post], np.repeat(np.arange(len(size)), size)] = self.impact[post]
        self.rounded = np.ascontiguousarray(self.matrix.T.astype(np.float32))
        self.maxima = self.rounded.reshape(len(size), self.n_blocks, BLOCK).max(axis=2)

    def best(self, queries: Queries, a: int, b: int, k: int, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, documents, scores) of at least the shard's best k of the queries from ``a`` to ``b``.

        ``reached`` has for each of them a score that k others have already.
        """
        n, wide = b - a, self.n_blocks * BLOCK
        mine = slice(queries.at[a], queries.at[b])
        size = self.count[queries.place[mine]]
        found = np.flatnonzero(size)
        size = size[found]
        post = _ranges(self.first[queries.place[mine][found]], size)
        rare = np.bincount(np.repeat((queries.row[mine][found] - a) * wide, size) + self.doc[post],
                           np.repeat(queries.weight[mine][found], size) * self.impact[post], n * wide).astype(float, copy=False).reshape(n, wide)
        least = (reached * (1 - SLACK)).astype(np.float32)
        bound = queries.rounded[a:b] @ self.maxima + rare.reshape(n, self.n_blocks, BLOCK).max(axis=2).astype(np.float32)
        blocks = np.flatnonzero(((bound >= least[:, None]) & (bound > 0)).any(axis=0))
        if len(blocks) == self.n_blocks:
            total = queries.rounded[a:b] @ self.rounded
            docs = np.arange(wide)
        else:
            docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            total = queries.rounded[a:b] @ self.rounded[:, docs]
            rare = rare[:, docs]
        total += rare
        take = (total >= least[:, None]) & (total > 0)
        many = np.flatnonzero(np.count_nonzero(take, axis=1) > 4 * k)
        if len(many):
            kth = np.partition(total[many], total.shape[1] - k, axis=1)[:, -k].astype(float)
            take[many] &= total[many] >= np.maximum(least[many], (kth * (1 - SLACK) - 1e-6) * (1 - SLACK))[:, None]
        q, at = np.nonzero(take)
        scores = rare[q, at]
        for i in range(0, len(q), 1024):
            some = slice(i, i + 1024)
            scores[some] += np.einsum("ij,ij->i", queries.matrix[a + q[some]], self.matrix[docs[at[some]]])
        return a + q, docs[at], scores

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least the shard's best k above a threshold already reached by k others."""
        queries = Queries(np.array([0, len(terms)]), np.arange(len(terms)), weights, terms, np.arange(0, len(terms), 2))
        self.prepare(queries)
        _, docs, scores = self.best(queries, 0, 1, k, np.array([threshold]))
        return docs, scores


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first ``k`` of each query's (query, document, null id, score) rows: by score, then known ids in order."""
    q, d, null, s = rows
    order = np.lexsort((d, null, -s, q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return [x[order[place < k]] for x in rows]


def _search(shared, k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, place, weights, vocabulary, common, mean_length = shared.value
        queries = Queries(at, place, weights, vocabulary, common)
        reached = np.zeros(len(ids))  # what k documents of this task's shards have scored at least
        number = {int(q): i for i, q in enumerate(ids)}
        # The best of all shards of the task so far: k rows a query, whatever the number of shards.
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0)]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(_loaded(batch, i), k1, b, mean_length)
                shard.prepare(queries)
                rows = [kept]
                for a in range(0, queries.n, CHUNK):
                    end = min(a + CHUNK, queries.n)
                    q, docs, scores = shard.best(queries, a, end, k, reached[a:end])
                    rows.append([ids[q], shard.ids[docs], shard.null[docs].astype(bool), np.round(scores, 6)])
                kept = _best([np.concatenate(x) for x in zip(*rows)], k)
                found, first, count = np.unique(kept[0], return_index=True, return_counts=True)
                for q, last in zip(found[count == k], (first + k - 1)[count == k]):
                    reached[number[int(q)]] = max(reached[number[int(q)]], kept[3][last] - 1e-6)
        q, d, null, s = kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(d, pa.int64(), mask=null), pa.array(s, pa.float64())],
            ["query_id", "doc_id", "score"])
    return run


def search(docs: DataFrame, is_query: Column, *, k: int = 10, k1: float = 1.2, b: float = 0.75,
           query_words: int = QUERY_WORDS) -> DataFrame:
    """The ``k`` best documents for every query: query_id, rank, doc_id, score.

    Every row of ``docs`` (doc_id, text) is indexed; the rows where ``is_query``
    is true are the queries, each with its whole text (a term counts as often as
    it occurs).  Score is BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)),
    rounded to 6 places; ties rank by doc_id, nulls last.  Words are runs of 0-9,
    a-z and non-ASCII characters after A-Z is lower-cased.  Null and empty texts
    are documents without words: never found, and as queries without results.
    Repeated rows are documents and queries of their own; queries with one doc_id
    and different texts share their ranks.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    index = scratch.write(docs.select("doc_id", "text").mapInArrow(bounded(_index_rows), _INDEX), "index")
    queries = scratch.write(docs.where(is_query & F.col("doc_id").isNotNull()).select("doc_id", "text").dropDuplicates()
                            .mapInArrow(bounded(_query_rows), "query_id long, terms binary, counts binary, n long"), "queries")
    sizes = index.select(F.octet_length("lengths").alias("n"), "lengths").mapInArrow(bounded(_lengths), "n long, words long").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    words = queries.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(words / query_words))
    found = None
    # A task gives k rows a query whatever its shards, and the later ones start from what the first reach.
    shards = index.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    for i in range(blocks if sizes.words else 0):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).where("n > 0").orderBy("query_id").collect()
        if not mine:
            continue
        terms = [np.frombuffer(r.terms, np.uint64) for r in mine]
        counts = np.concatenate([np.frombuffer(r.counts, np.int32) for r in mine])
        flat = np.concatenate(terms)
        vocabulary, place = np.unique(flat, return_inverse=True)
        df = (shards.select("terms", "starts").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)),
                                                         "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).toPandas())
        seen = np.zeros(len(vocabulary))
        seen[df.term.to_numpy(np.int64)] = df.df.to_numpy(float)
        weights = np.log(1 + (sizes.n - seen + 0.5) / (seen + 0.5))[place] * counts
        pairs = seen / sizes.n * np.bincount(place, minlength=len(vocabulary)) / len(mine)
        common = np.argsort(-pairs, kind="stable")[:COMMON_TERMS]
        common = np.sort(common[pairs[common] >= COMMON_SHARE])
        shared = spark.sparkContext.broadcast(
            (np.array([r.query_id for r in mine]), np.cumsum([0, *map(len, terms)]), place, weights, vocabulary, common,
             sizes.words / sizes.n))
        part = shards.mapInArrow(bounded(_search(shared, k, k1, b)), "query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([x.as_py() // 8 for x in batch.column(0)], pa.int64()),
                                          pa.array(words, pa.int64())], ["n", "words"])


#: The same result by scoring every document that shares a word with a query.
ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n,
              (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT doc_id AS query_id, term, tf AS qtf FROM tf WHERE doc_id % 100 = 0),
s AS (SELECT query_id, tf.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5))
             * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st
      GROUP BY query_id, tf.doc_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
             doc_id, score FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
