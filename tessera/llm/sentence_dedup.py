"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after closing punctuation or a line end, and before
a capitalised word that follows an uncapitalised one without punctuation (where
passages have been pasted into running text).  From every sentence the shortest
span of several consecutive sentences with enough words is hashed forwards, and
likewise backwards to every sentence, so both ends of a repeated passage are
reached.  Spans are joined over the whole corpus through one aggregated row per
hash; sentences under any span that occurs earlier are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package

#: Where a sentence starts: after .!? and white space, after a line end, or at a capital after a word without end mark.
#: A run of blanks is tried once, from its start, so its length counts once.
_START = re.compile(r"(?<=[.!?])\s++|(?<!\s)(?=[^\S\n]*+\n)\s++|(?<=[^\W\d_A-ZÀ-ÖØ-Þ])[ \t]++(?=[A-ZÀ-ÖØ-Þ])")
#: Up to this many rows a table of hashes or spans is broadcast (about 32 MB); beyond it, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without the white space between them."""
    out, at = [], 0
    for m in _START.finditer(text):
        if text[at:m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def spans(words: np.ndarray, least_sentences: int, least_words: int, enough_words: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the shortest spans from every sentence on and up to every sentence.

    A span has ``least_sentences`` sentences and ``least_words`` words, or
    ``enough_words`` words in any number of sentences.
    """
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    start = np.arange(n)
    ahead = np.minimum(np.maximum(start + least_sentences, np.searchsorted(total, total[:-1] + least_words)),
                       np.searchsorted(total, total[:-1] + enough_words))
    stop = np.arange(1, n + 1)
    back = np.maximum(np.minimum(stop - least_sentences, np.searchsorted(total, total[1:] - least_words, "right") - 1),
                      np.searchsorted(total, total[1:] - enough_words, "right") - 1)
    out = {(int(i), int(j)) for i, j in zip(start, ahead) if j <= n}
    out.update((int(i), int(j)) for i, j in zip(back, stop) if i >= 0)
    return sorted(out)


def _parts(text: str) -> tuple[list[tuple[int, int]], list[bytes]]:
    cut = sentences(text)
    return cut, [b" ".join(text[a:b].encode("utf-8", "replace").split()) for a, b in cut]


def _span_rows(limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                take, first, last, keys = [], [], [], []
                for row, text in enumerate(part.column(2)):
                    _, said = _parts(text.as_py())
                    if not said:
                        continue
                    count = np.fromiter((s.count(b" ") + 1 for s in said), np.int64, len(said))
                    for i, j in spans(count, *limits):
                        take.append(row)
                        first.append(i)
                        last.append(j)
                        keys.append(xxhash.xxh3_64_intdigest(b" ".join(said[i:j])) - 2**63)
                take = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(first, pa.int32()),
                     pa.array(last, pa.int32()), pa.array(keys, pa.int64())], ["_id", "_th", "first", "last", "key"])
    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sentences under the listed spans out of ``text``."""
    for batch in batches:
        names = batch.schema.names
        texts, counts, gone = [], [], []
        for text, runs in zip(batch.column(names.index("text")), batch.column(names.index("_runs"))):
            text, runs = text.as_py(), runs.as_py()
            cut = sentences(text or "")
            out = np.zeros(len(cut) + 1, bool)
            for r in runs or ():
                out[r["first"]:r["last"]] = True
            if out.any():
                kept, k = [], 0
                while k < len(cut):  # neighbouring sentences that stay keep the white space between them
                    if not out[k]:
                        e = k
                        while e + 1 < len(cut) and not out[e + 1]:
                            e += 1
                        kept.append(text[cut[k][0]:cut[e][1]])
                        k = e
                    k += 1
                text = "\n".join(kept)
            texts.append(text)
            counts.append(len(cut))
            gone.append(int(out.sum()))
        keep = [i for i, c in enumerate(names) if c != "_runs"]
        columns = [pa.array(texts, pa.string()) if names[i] == "text" else batch.column(i) for i in keep]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                                         [*(names[i] for i in keep), "n_sentences", "n_removed"])


def dedup_sentences(docs: DataFrame, *, least_sentences: int = 3, least_words: int = 20,
                    enough_words: int = 40) -> DataFrame:
    """``docs`` with ``text`` freed of repeated sentence spans, and n_sentences, n_removed.

    Sentences are compared with runs of white space as one space.  The occurrence
    of a span that stays is the one in the smallest doc_id, and there the first;
    a null doc_id comes first.  Rows with the same doc_id and text are one
    document with one result; rows with one doc_id and different texts are
    ordered by a hash of the text.  Null and blank texts have no sentences and
    stay; no row is dropped, and a text of which all is removed is empty.  Columns
    named n_sentences or n_removed are replaced; others stay.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    docs = docs.drop("n_sentences", "n_removed")
    # The whole row travels as one column, so no name of it meets a name used here.
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"),
                       F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_th"))
    found = scratch.write(
        rows.where("text is not null").select("_id", "_th", "text")
        .mapInArrow(bounded(_span_rows((least_sentences, least_words, enough_words))),
                    "_id long, _th long, first int, last int, key long"), "spans")
    place = F.struct("_id", "_th", "first")
    keys = scratch.write(
        found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("z"))
        .where(~F.col("a").eqNullSafe(F.col("z"))).select("key", "a"), "keys")
    few = keys.count() <= BROADCAST_ROWS
    later = found.join(F.broadcast(keys) if few else keys, "key").where(~F.col("a").eqNullSafe(place))
    runs = scratch.write(later.groupBy("_id", "_th").agg(F.collect_set(F.struct("first", "last")).alias("_runs")), "runs")
    scratch.drop(found, keys)
    few = runs.agg(F.sum(F.size("_runs") + 4)).first()[0] or 0
    runs = runs.select(F.col("_id").alias("_rid"), F.col("_th").alias("_rth"), "_runs")
    marked = rows.join(F.broadcast(runs) if few <= BROADCAST_ROWS else runs,
                       F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")), "left")
    kind = rows.schema["row"].dataType.simpleString()
    out = marked.select("row", "text", "_runs").mapInArrow(
        bounded(_remove), f"row {kind}, text string, n_sentences long, n_removed long")
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns),
                      "n_sentences", "n_removed")
