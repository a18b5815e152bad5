"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item gives its windows of ``window`` consecutive words.  For each
window length a shift table says, for the block of two words that ends at the
current position, how far the search may jump because no window can end nearer;
at shift 0 the block picks a bucket of windows (keyed by their first word as
well) which are compared word by word.  Most positions are never looked at.

The documents are scanned where they lie: no shuffle.  The tables are broadcast
in parts of a checked size; a benchmark too large for one part is searched part
by part, each pass adding to the hits of the one before.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package

#: Bytes of benchmark text whose tables are broadcast at once.
PART_BYTES = 16_000_000
#: Word bytes (0-9, a-z, all of a non-ASCII character) stay, A-Z is lower-cased, the rest becomes a space.
_WORD_BYTES = bytes(b if chr(b).isdecimal() and b < 128 or 97 <= b <= 122 or b >= 128
                    else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a UTF-8 text: runs of 0-9, a-z and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All windows of ``size`` words; of fewer words, but not none, the one window of all."""
    size = min(size, len(words))
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)] if size else []


class ShiftTable:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.length = len(next(iter(windows)))
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict] = defaultdict(lambda: defaultdict(list))
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                key = window[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), self.length - end)
            self.bucket[window[-self.block:]][window[0]].append((list(window), items))
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence of every window."""
        i, n, jump, shift = self.length - 1, len(words), self.jump, self.shift.get
        pair = self.block == 2
        while i < n:
            key = (words[i - 1], words[i]) if pair else (words[i],)
            if step := shift(key, jump):
                i += step
                continue
            start = i - self.length + 1
            for window, items in self.bucket[key].get(words[start], ()):
                if words[start:i + 1] == window:
                    yield start, items
            i += 1


def shift_tables(items: list[tuple[str | None, bytes]], size: int) -> list[ShiftTable]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for window in windows_of(words_of(text), size):
            by_length[len(window)][window].update([] if item is None else [item])
    return [ShiftTable(dict(v)) for _, v in sorted(by_length.items())]


def _scan(shared):
    """Adds to ``hits`` (one byte a word) and ``items`` what the shared tables find in ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            names = batch.schema.names
            at = {c: names.index(c) for c in ("_text", "_hits", "_items")}
            hits, found = [], []
            for text, old, known in zip(batch.column(at["_text"]).cast(pa.binary()), batch.column(at["_hits"]),
                                        batch.column(at["_items"])):
                words = words_of(text.as_py() or b"")
                marks, items = None, set(known.as_py() or ())
                for table in tables:
                    for start, ids in table.search(words):
                        if marks is None:
                            marks = bytearray(old.as_py() or bytes(len(words)))
                        marks[start:start + table.length] = b"\x01" * table.length
                        items |= ids
                hits.append(old.as_py() or bytes(len(words)) if marks is None else bytes(marks))
                found.append(sorted(items))
            columns = list(batch.columns)
            columns[at["_hits"]] = pa.array(hits, pa.binary())
            columns[at["_items"]] = pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        hits = batch.column(names.index("_hits")).to_pylist()
        items = batch.column(names.index("_items")).to_pylist()
        keep = [c for c in names if c not in ("_text", "_hits", "_items")]
        counts = [h.count(1) for h in hits]
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index(c)) for c in keep]
            + [pa.array([len(h) for h in hits], pa.int64()), pa.array(counts, pa.int64()),
               pa.array([len(x) for x in items], pa.int64()),
               pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
               pa.array([c > 0 for c in counts], pa.bool_())],
            keep + ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, keep: tuple[str, ...] = ("doc_id",),
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated.

    A word counts as hit when it lies inside an occurrence of any window of
    ``benchmark`` (item_id, text).  Null texts have no words; an item without
    words has no window; repeated items count once by item_id and an item with a
    null id marks words but is not listed.  Empty tables give no rows or no hits.
    Rows of ``docs`` are never merged or dropped.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    kept: list[Column | str] = list(keep)
    state = docs.select(*kept, F.col("text").cast("string").alias("_text"), F.lit(None).cast("binary").alias("_hits"),
                        F.lit(None).cast("array<string>").alias("_items"))
    scratch, old = Scratch(spark), None
    for k in range(parts):
        mine = [(r.item_id, (r.text or "").encode()) for r in items.where(part == k).collect()]
        scan = _scan(spark.sparkContext.broadcast(shift_tables(mine, window)))
        if k + 1 < parts:
            state = scratch.write(state.mapInArrow(bounded(scan), state.schema), "hits")
            scratch.drop(old)
            old = state
    # The last search and the digest share a worker: one Python process a task, and the rows cross to it once.
    return state.mapInArrow(bounded(lambda batches: _digest(scan(batches))), ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name not in ("_text", "_hits", "_items"))
        + ", " + RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold any benchmark window; columns as they were."""
    marked = contamination(docs.select(F.struct(*docs.columns).alias("_row"), "text"), benchmark, window=window,
                           keep=("_row",))
    return marked.where("not contaminated").select("_row.*")


ORACLE = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS win
       FROM (SELECT item_id, ws, least(10, len(ws)) AS m,
             unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
             FROM d, (SELECT DISTINCT m FROM bw))),
hits AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
