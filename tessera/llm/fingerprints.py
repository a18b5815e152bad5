"""Document fingerprints: SimHash, and a radius search over permuted block tables.

A text's terms are its runs of three consecutive words (two start marks stand before
the first word).  A term that occurs n times weighs 1 + floor(log2 n).  Every term is
hashed to ``BITS`` signed bits and votes with its weight; the signs of the sums are the
fingerprint, written in hex.  Equal texts have equal fingerprints, and the share of
equal bits of two fingerprints is their likeness: 1 for equal texts, about 1/2 for
texts without common terms.

*Neighbours in id order* (``fingerprint_pairs``): texts are compressed, dealt by ranges
of the order and sorted; each sorted partition is read once as a stream that knows the
row before.  Only the first and last row of a partition, at most two texts for each,
are matched in a second, small join.

*Radius search* (``within_radius``): fingerprints are cut into radius + 1 blocks.  Two
that differ in at most ``radius`` bits agree in one block at least, so the table of
block j (the fingerprints with block j moved to the front) holds them under one key.
All tables are one join on (block number, block); a pair counts in its first common
block only.  Copies meet as one fingerprint with a number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package

BITS = 256
#: Consecutive words that make a term.
TERM_WORDS = 3
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FINISH = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: One stream of bits for each 64 of the fingerprint.
_STREAMS = (np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (a 64-bit finisher)."""
    x = (x ^ (x >> np.uint64(30))) * _FINISH[0]
    x = (x ^ (x >> np.uint64(27))) * _FINISH[1]
    return x ^ (x >> np.uint64(31))


def _votes(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each bit, the sum of the weights of the terms that have it set."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(terms), 4096):
        mine, heavy = terms[at:at + 4096], weights[at:at + 4096]
        bits = np.unpackbits(_mixed(mine[:, None] + _STREAMS).view(np.uint8), axis=1)
        while len(bits):
            # Sums of at most 255 rows fit a byte.
            for k in range(0, len(bits), 255):
                total += bits[k:k + 255].sum(axis=0, dtype=np.uint8)
            heavy = heavy - 1
            bits, heavy = bits[heavy > 0], heavy[heavy > 0]
    return total


def simhash(word_hashes: np.ndarray) -> bytes:
    """The fingerprint of a text whose words have these 64-bit hashes; all zero bits without words."""
    if not len(word_hashes):
        return bytes(BITS // 8)
    marked = np.concatenate([np.zeros(TERM_WORDS - 1, np.uint64), word_hashes])
    n = len(word_hashes)
    terms = np.zeros(n, np.uint64)
    for k in range(TERM_WORDS):
        terms = _mixed(terms ^ (marked[k:k + n] * _MULTIPLY[k]))
    terms, times = np.unique(terms, return_counts=True)
    weights = np.frexp(times)[1]  # 1 + floor(log2 n)
    return np.packbits(2 * _votes(terms, weights) > weights.sum()).tobytes()


def fingerprints_of(texts: list[bytes]) -> list[bytes]:
    """The fingerprints of UTF-8 texts; words are runs without ASCII white space."""
    words = [t.split() for t in texts]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in dict.fromkeys(chain.from_iterable(words))}
    return [simhash(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))) for ws in words]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1.0 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following`` (or all of it)."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


# ---- Neighbours in id order ------------------------------------------------

RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_COLUMNS = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                      ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGE = pa.schema([("_part", pa.int64()), ("_first", pa.bool_()), ("_z", pa.binary()), ("_fp", pa.binary())])
_PACK, _UNPACK = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        at = names.index("_text")
        columns = list(batch.columns)
        columns[at] = pa.array([_PACK.compress(t or b"") for t in columns[at].cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(columns, [*names[:at], "_z", *names[at + 1:]])


def _results(texts: list[str], prints: list[bytes], following: list[tuple[str, bytes]]) -> list[pa.Array]:
    """The result columns of texts with fingerprints, given the text and fingerprint that follow each."""
    new = [edited(t, f).encode() for t, (f, _) in zip(texts, following)]
    new_prints = fingerprints_of(new)
    return [pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in new], pa.string()),
            pa.array([p.hex() for p in prints], pa.string()),
            pa.array([p.hex() for p in new_prints], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(prints, new_prints)], pa.float64()),
            pa.array([likeness(a, b) for a, (_, b) in zip(prints, following)], pa.float64())]


def _nulls(schema: pa.Schema, n: int) -> list[pa.Array]:
    return [pa.nulls(n, f.type) for f in schema]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition but its last; first and last row come as edges with their text."""
    part = TaskContext.get().partitionId()
    held = None  # the last row so far: its columns, text, fingerprint and compressed text
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        packed = batch.column(names.index("_z")).to_pylist()
        kept = batch.drop_columns(["_z"])
        raw = [_UNPACK.decompress(z) for z in packed]
        texts, prints = [t.decode() for t in raw], fingerprints_of(raw)
        if held is None:
            yield _edges(kept.slice(0, 1), part, True, packed[0], prints[0])
        rows = pa.Table.from_batches(([held[0]] if held else []) + [kept]).combine_chunks()
        all_texts = ([held[1]] if held else []) + texts
        all_prints = ([held[2]] if held else []) + prints
        done = len(all_texts) - 1
        if done:
            ready = rows.slice(0, done).to_batches()[0]
            yield pa.RecordBatch.from_arrays(
                [*ready.columns, *_results(all_texts[:done], all_prints[:done], list(zip(all_texts[1:], all_prints[1:]))),
                 *_nulls(_EDGE, done)], kept.schema.names + _COLUMNS.names + _EDGE.names)
        held = kept.slice(kept.num_rows - 1, 1), texts[-1], prints[-1], packed[-1]
    if held:
        yield _edges(held[0], part, False, held[3], held[2])


def _edges(row: pa.RecordBatch, part: int, first: bool, packed: bytes, fingerprint: bytes) -> pa.RecordBatch:
    edge = [pa.array([v], f.type) for v, f in zip((part, first, packed, fingerprint), _EDGE)]
    return pa.RecordBatch.from_arrays([*row.columns, *_nulls(_COLUMNS, 1), *edge],
                                      row.schema.names + _COLUMNS.names + _EDGE.names)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        text = {c: [_UNPACK.decompress(z).decode() for z in batch.column(names.index(c)).to_pylist()] for c in ("_z", "_next_z")}
        print_ = {c: batch.column(names.index(c)).to_pylist() for c in ("_fp", "_next_fp")}
        kept = batch.select([c for c in names if c not in (*text, *print_)])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, *_results(text["_z"], print_["_fp"], list(zip(text["_next_z"], print_["_next_fp"])))],
            kept.schema.names + _COLUMNS.names)


def _fields(df: DataFrame, without: tuple[str, ...] = ()) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def fingerprint_pairs(docs: DataFrame, row: Column, scratch: Scratch) -> DataFrame:
    """``row`` (of each row of ``docs``, as ``_row``) with the fingerprints of its text and of its edited text.

    The rows follow each other by descending doc_id (null last; rows of one doc_id by
    the hash of their text, copies in any order) and the first follows the last; a
    single row follows itself.  The edited text has its last floor(n_chars / 3) code
    points replaced by the first as many, or all, of the next row's text.  Null texts
    are empty.  n_chars, edited_sha256, fingerprint and edited_fingerprint (hex),
    near_edited and near_next (share of equal bits) are the results.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.col("_id").desc_nulls_last(), F.col("_tie"), F.col("_at")]
    rows = docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_tie"),
                       F.monotonically_increasing_id().alias("_at"), text.alias("_text"))
    packed = rows.mapInArrow(bounded(_compressed), _fields(rows, ("_text",)) + ", _z binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (packed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("_row", "_z")
               .mapInArrow(bounded(_in_order), f"{_fields(packed.select('_row'))}, {RESULT}, "
                           "_part long, _first boolean, _z binary, _fp binary"))
    done = scratch.write(ordered, "fingerprints")
    edges = done.where("_part is not null")
    # At most one number for each partition of the sort.
    filled = sorted(r["_part"] for r in edges.where("_first").select("_part").collect())
    follows = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "_part long, _to long")
    firsts = edges.where("_first").select(F.col("_part").alias("_to"), F.col("_z").alias("_next_z"), F.col("_fp").alias("_next_fp"))
    lasts = edges.where("not _first").select("_row", "_part", "_z", "_fp")
    pairs = lasts.join(follows, "_part").join(firsts, "_to").select("_row", "_z", "_fp", "_next_z", "_next_fp")
    closing = pairs.mapInArrow(bounded(_at_edges), f"{_fields(pairs.select('_row'))}, {RESULT}")
    return done.where("_part is null").select(closing.columns).unionByName(closing)


# ---- Radius search ---------------------------------------------------------

def _blocks(fingerprint: Column, bits: int, radius: int) -> list[Column]:
    """The hex digits of a fingerprint in radius + 1 blocks of almost equal size."""
    digits, n = bits // 4, radius + 1
    if n > digits:
        raise ValueError(f"a radius of {radius} needs fingerprints of {4 * n} bits at least")
    cuts = [digits * k // n for k in range(n + 1)]
    return [F.substring(fingerprint, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]


def _numbers(fingerprint: Column, bits: int) -> list[Column]:
    """A hex fingerprint as 64-bit numbers."""
    return [F.conv(F.substring(fingerprint, k // 4 + 1, 16), 16, -10).cast("long") for k in range(0, bits, 64)]


def _table(df: DataFrame, name: str, bits: int, radius: int) -> DataFrame:
    """One row for each block of each fingerprint: (j, block, <name>)."""
    fp = F.col(name)
    blocks = F.array(*[F.xxhash64(b) for b in _blocks(fp, bits, radius)])
    return (df.select("*", blocks.alias("_b"), F.array(*_numbers(fp, bits)).alias(f"_{name}"))
            .select("*", F.posexplode("_b").alias("_j", "_block")))


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 7, bits: int = BITS) -> DataFrame:
    """(query, fingerprint, distance) for all fingerprints at most ``radius`` bits from a query, itself included.

    Both tables have hex strings of ``bits`` bits (a multiple of 64) in their column
    ``fingerprint``; repeated and null ones count once and not at all.  Pairs are
    exact: the blocks only propose, all bits are compared.
    """
    q = queries.where("fingerprint is not null").select(F.col("fingerprint").alias("query")).distinct()
    f = fingerprints.where("fingerprint is not null").select("fingerprint").distinct()
    a, b = _table(q, "query", bits, radius), _table(f, "fingerprint", bits, radius)
    a = a.select("query", "_query", F.col("_b").alias("_bq"), "_j", "_block")
    apart = sum((F.bit_count(F.col("_query")[k].bitwiseXOR(F.col("_fingerprint")[k])) for k in range(bits // 64)), F.lit(0))
    # The first block they share: the pair is counted in this table alone.
    first = F.array_position(F.zip_with("_bq", "_b", lambda x, y: x == y), True) - 1
    return (a.join(b, ["_j", "_block"]).withColumn("distance", apart).where((F.col("distance") <= radius) & (first == F.col("_j")))
            .select("query", "fingerprint", F.col("distance").cast("int").alias("distance")))


def fingerprint_documents(docs: DataFrame, queried: Column, *, radius: int = 7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fingerprints of all rows of ``docs``, and for the ``queried`` ones how many rows are near.

    The columns of ``fingerprint_pairs`` after the ``keep`` columns; n_near is the
    number of other rows whose fingerprint differs in at most ``radius`` bits, null
    for rows that are not queried.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    row = F.struct(F.struct(*keep).alias("keep"), queried.alias("queried"))
    pairs = fingerprint_pairs(docs, row, scratch)
    rows = scratch.write(pairs.select(F.col("_row.keep").alias("_keep"), F.col("_row.queried").alias("_queried"),
                                      *_COLUMNS.names), "rows")
    copies = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_n"))
    asked = rows.where("_queried")
    near = (within_radius(asked, rows, radius).join(copies, "fingerprint")
            .groupBy(F.col("query").alias("fingerprint")).agg((F.sum("_n") - 1).alias("n_near")))
    rest = rows.where("_queried is null or not _queried").withColumn("n_near", F.lit(None).cast("long"))
    return asked.join(near, "fingerprint").unionByName(rest).select("_keep.*", *_COLUMNS.names, "n_near")
