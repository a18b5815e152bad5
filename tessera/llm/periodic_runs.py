"""Periodic runs of words by online dyadic square catching.

A text is read as an array of word numbers.  For every power of two b the words are
cut into completed blocks of b, and the last completed block at a distance of b to
2b - 1 words is the *catcher* of that level: each appended word ends one suffix of b
words, and where this suffix equals the catcher's block, the distance q between the
two is the half length of a possible square.  (The smallest level also catches the
distances below b, with the block that holds the start of the suffix.)  A run with
period q and at least max(``least_words``, 3q) words repeats at distance q over so
many words that it holds a completed block of its level, so no run escapes.

A caught square is compared word by word to both sides as far as period q reaches;
squares of one stretch merge into one run.  Suffixes are compared by fingerprints
that double from level to level (two halves make a whole), so a level costs one pass
over the words; equal fingerprints are only candidates, the extension compares words.

Texts are scanned where they lie: no shuffle, and nothing of one row meets another.
The texts of a batch are laid one after the other, longest first and a mark that
equals nothing between them, so that a level works on the whole batch at once and
leaves out the texts too short for it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, ship_package

#: Words that are laid out together; a longer text is laid out alone.
BATCH_WORDS = 200_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)

Run = tuple[int, int, int]  # start, length, period


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprints of two halves laid together."""
    x = left * _A + right * _B
    x ^= x >> _SHIFT
    x *= _B
    return x


def first_level(least_words: int) -> int:
    """The largest block b = 2^k that every run of a period below 2b holds completely.

    A run of period q repeats at distance q over max(least_words - q, 2q) words, which
    is smallest at a third of ``least_words``; any 2b - 1 words hold a block.
    """
    shortest = min(max(least_words - q, 2 * q) for q in range(1, least_words + 1))
    b = 1
    while 4 * b - 1 <= shortest and max(least_words, 3) >= 4 * b:
        b *= 2
    return b


def _stretch(w: np.ndarray, at: int, size: int, q: int) -> tuple[int, int]:
    """The longest [lo, hi) around [at, at + size) with w[i] == w[i + q] throughout; empty if that does not hold inside."""
    if not np.array_equal(w[at:at + size], w[at + q:at + q + size]):
        return at, at
    n, step, hi = len(w) - q, 64, at + size
    while hi < n:
        end = min(n, hi + step)
        differs = w[hi:end] != w[hi + q:end + q]
        k = int(differs.argmax())
        if differs[k]:
            hi += k
            break
        hi, step = end, step * 2
    step, lo = 64, at
    while lo > 0:
        start = max(0, lo - step)
        differs = (w[start:lo] != w[start + q:lo + q])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            lo -= k
            break
        lo, step = start, step * 2
    return lo, hi


@lru_cache(4096)
def _prime_factors(q: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return (*out, q) if q > 1 else tuple(out)


def _is_smallest(w: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period too (a run of three periods has no other smaller period)."""
    return not any(np.array_equal(w[start:start + q - q // f], w[start + q // f:start + q]) for f in _prime_factors(q))


def _suspects(w: np.ndarray, ids: np.ndarray, b: int, smallest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of all suffixes of b words that equal their catcher's block."""
    here = np.arange(len(ids))
    block = here - here % b
    found = []
    for back in ((0, b) if smallest else (b,)):
        a = block - back
        ok = a >= 0
        hit = np.flatnonzero(ok & (ids[np.maximum(a, 0)] == ids) & (a < here))
        found.append((a[hit], hit - a[hit]))
    return np.concatenate([x for x, _ in found]), np.concatenate([q for _, q in found])


def find_runs(w: np.ndarray, ends: np.ndarray, least_words: int = 24) -> list[Run]:
    """All runs in ``w``, texts of descending length that end before ``ends`` (one mark closes each text).

    A run is a longest stretch with smallest period q and at least
    max(least_words, 3q) words.  Marks must differ from every other number.
    """
    runs: list[Run] = []
    lengths = np.diff(ends, prepend=-1) - 1
    ids, span, b = w.astype(np.uint64), 1, first_level(least_words)
    smallest = True
    while True:
        texts = int(np.searchsorted(-lengths, -max(least_words, 3 * b if not smallest else 0), side="right"))
        if not texts:
            return sorted(runs)
        total = int(ends[texts - 1]) + 1
        ids = ids[:total]
        while span < b:
            ids = _joined(ids[:len(ids) - span], ids[span:])
            span *= 2
        runs += _caught(w[:total], *_suspects(w, ids, b, smallest), b, least_words, runs)
        smallest, b = False, 2 * b


def _outside(at: np.ndarray, gap: np.ndarray, b: int, runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """The squares that do not lie inside the last run before them with a period that divides theirs."""
    if not runs or not len(at):
        return at, gap
    start, length, period = np.array(sorted(runs)).T
    i = np.searchsorted(start, at, side="right") - 1
    new = (i < 0) | (at + b + gap > start[i] + length[i]) | (gap % period[i] != 0)
    return at[new], gap[new]


def _caught(w: np.ndarray, at: np.ndarray, gap: np.ndarray, b: int, least_words: int, known: list[Run]) -> list[Run]:
    """Runs of the squares caught at one level; those inside a known run of a period that divides theirs are its own."""
    new: list[Run] = []
    at, gap = _outside(at, gap, b, known)
    order = np.lexsort((at, gap))
    at, gap = at[order], gap[order]
    firsts = np.flatnonzero(np.diff(gap, prepend=-1)) if len(gap) else []
    for k, lo in enumerate(firsts):
        hi = firsts[k + 1] if k + 1 < len(firsts) else len(gap)
        q, starts = int(gap[lo]), at[lo:hi]
        starts = _outside(starts, gap[lo:hi], b, [r for r in new if q % r[2] == 0])[0]
        i = 0
        while i < len(starts):
            a = int(starts[i])
            lo_, hi_ = _stretch(w, a, b, q)
            if hi_ - lo_ + q >= max(least_words, 3 * q) and _is_smallest(w, lo_, q):
                new.append((lo_, hi_ - lo_ + q, q))
            i = max(i + 1, int(np.searchsorted(starts, hi_)))
    return new


def retold(words: list, doc_id: int | None) -> list:
    """The rule that makes texts periodic: one in ten ids, by CRC-32, repeats its words from a place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = words[a:a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (period * ((n - a) // len(period) + 1))[:n - a]


def _summary(words: list[bytes], runs: list[Run]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of one text."""
    best = None
    for r in sorted(runs):
        # Exact comparison of length / period; the earlier start, then the shorter period stays on a tie.
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs))
    kept, at = [], 0
    for s, e in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:s]
        at = max(at, e)
    kept += words[at:]
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def runs_of_texts(texts: list[list[bytes]], least_words: int = 24) -> list[list[Run]]:
    """The runs of each text (a list of words), found together."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number = dict(zip(dict.fromkeys(chain.from_iterable(texts)), count()))
    w = np.empty(sum(map(len, texts)) + len(texts), np.int64)
    ends, at = np.empty(len(texts), np.int64), 0
    for k, i in enumerate(order):
        words = texts[i]
        w[at:at + len(words)] = list(map(number.__getitem__, words))
        at += len(words)
        w[at], ends[k] = -1 - k, at
        at += 1
    out: list[list[Run]] = [[] for _ in texts]
    for s, n, q in find_runs(w, ends, least_words):
        k = int(np.searchsorted(ends, s, side="right"))
        out[order[k]].append((s - (int(ends[k - 1]) + 1 if k else 0), n, q))
    return out


RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


def _scan(least_words: int, retell: bool) -> Callable:
    schema = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                        ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = [(t or b"").split() for t in batch.column(names.index("_text")).cast(pa.binary()).to_pylist()]
            if retell:
                texts = [retold(t, i) for t, i in zip(texts, batch.column(names.index("_id")).to_pylist())]
            rows, at = [], 0
            while at < len(texts):
                upto, words = at + 1, len(texts[at])
                while upto < len(texts) and words + len(texts[upto]) <= BATCH_WORDS:
                    words += len(texts[upto])
                    upto += 1
                rows += map(_summary, texts[at:upto], runs_of_texts(texts[at:upto], least_words))
                at = upto
            kept = [c for c in names if c not in ("_text", "_id")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in kept]
                + [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], kept + schema.names)
    return run


def periodic_runs(docs: DataFrame, *, least_words: int = 24, retell: bool = False,
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with the periodic runs of its whole text.

    Words are stretches without ASCII white space (``[^\\x20\\x09-\\x0D]+``).  A run is a
    longest stretch with smallest period q and at least max(least_words, 3q) words.
    n_runs counts them; start, length, period and exponent_milli (floor of 1000 *
    length / period) are those of the run with the greatest length / period (ties: the
    smallest start, then period), null without a run; runs_sha256 is the digest of all
    runs as ``start,length,period`` lines, collapsed_sha256 that of the words that no
    run holds after its first period, joined by one space.

    ``retell`` first makes one text in ten periodic by the CRC-32 of its integer
    ``doc_id`` (see ``retold``); a null doc_id leaves the text as it is.  Null and
    empty texts have no words.  Rows are never merged or dropped, so repeated rows give
    repeated results and an empty table gives no rows; further columns do no harm.
    """
    ship_package(docs.sparkSession)
    kept: list[Column | str] = list(keep)
    source = docs.select(*kept, F.col("doc_id").cast("long").alias("_id") if retell else F.lit(None).cast("long").alias("_id"),
                         F.col("text").cast("string").alias("_text"))
    fields = [f for f in source.schema if f.name not in ("_id", "_text")]
    return source.mapInArrow(bounded(_scan(least_words, retell)), ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + RESULT)
