"""Toxicity scores over text restored by a noisy-channel decoder.

1. A character trigram model is counted over the words of every document.
2. Words that look disguised (signs or digits among letters, letters repeated
   three times and more, single letters spelled out with gaps) become a lattice:
   every sign may stand for the letters it resembles or for nothing, every long
   repetition for one or two letters.  Viterbi decoding takes the path of the
   highest probability under the character model and the channel's costs.
3. Features are the distinct words, plain and restored, and their beginnings.
   Their log-odds of toxic against other documents come from the labelled rows;
   the logistic regression over a document's strongest log-odds learns from the
   same rows, each by the log-odds of the folds it is not in.  Rows held out by
   the caller train nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package
from .quality import fit_logistic

#: The letters that a sign of a disguised word may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
_SIGNS = "".join(map(re.escape, LEET))
#: A letter next to a sign inside a word, or a letter three times.
_SUSPECT = re.compile(rf"[^\W\d_][.\-_]*[{_SIGNS}][{_SIGNS}.\-_]*[^\W\d_]|^[{_SIGNS}]+[^\W\d_]{{2}}"
                      rf"|[^\W\d_]{{2}}[@$013457]+$|([^\W\d_])\1\1|[^\W\d_][.\-_*][^\W\d_][.\-_*][^\W\d_]")
#: Single letters (or signs for letters) spelled out: at least three, one gap between each.
_SPELLED = re.compile(rf"(?<!\S)(?:[^\W\d_]|[{_SIGNS}])(?:[ .\-_*](?:[^\W\d_]|[{_SIGNS}])){{2,}}(?=[.,;:?!]*(?:\s|$))")
#: Log-odds from which a feature is kept, and from which a further word counts besides the strongest.
LEAN, SURE = 1.5, 3.5
_EDGE = ".,;:?\"'()[]{}<>!"
#: A longer repetition stands for the same letters as three.
_LONG = re.compile(r"(.)\1{3,}", re.S)
#: What may stand between spelled-out letters, and every white space, by code point.
_GAP, _SPACE = np.zeros(0x3001, bool), np.zeros(0x3001, bool)
_GAP[[ord(c) for c in " .-_*"]] = True
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
#: Longest word that the decoder remembers.
MAX_SEEN = 40

#: The character model's alphabet: 0 is the edge of a word and every other character.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
N_CODES = len(_LETTERS) + 1
_TABLE = np.zeros(0x250, np.int64)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
    if _c.upper() != _c and len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _TABLE[ord(_c.upper())] = _i


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the character trigrams of a task's texts: one row for each that occurs."""
    total = np.zeros(N_CODES ** 3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            for at in range(0, len(text), 1 << 20):
                u = np.frombuffer(text[at:at + (1 << 20)].encode("utf-32-le", "replace"), "<u4")
                c = np.concatenate(([0, 0], np.where(u < 0x250, _TABLE[np.minimum(u, 0x24F)], 0), [0, 0]))
                # Within a word; a word's first letter sees two edges.
                c = c[(c != 0) | np.concatenate(([True], c[:-1] != 0))]
                c = np.insert(c, np.flatnonzero(c == 0), 0)
                total += np.bincount((c[:-2] * N_CODES + c[1:-1]) * N_CODES + c[2:], minlength=N_CODES ** 3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probability of each character after two others, counted over all texts (bounded by the alphabet)."""
    counts = (docs.where("text is not null").select("text").mapInArrow(bounded(_trigrams), "gram long, n long")
              .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    tri = np.zeros(N_CODES ** 3)
    tri[counts.gram.to_numpy(np.int64)] = counts.n.to_numpy(float)
    tri = tri.reshape(N_CODES, N_CODES, N_CODES)
    uni = tri.sum(axis=(0, 1)) + 1
    bi = tri.sum(axis=0) + 0.5 * uni / uni.sum() * N_CODES
    bi /= bi.sum(axis=1, keepdims=True)
    smooth = tri + 2.0 * bi[None, :, :]
    return np.log(smooth / smooth.sum(axis=2, keepdims=True))


def _signs_of_disguise(low: str) -> tuple[list[str], bool]:
    """The letters that a text holds three times in a row, and whether single characters with gaps may be spelled out in it."""
    u = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(u) < 3:
        return [], False
    same = u[1:] == u[:-1]
    letters = map(chr, set(u[2:][same[1:] & same[:-1]].tolist()))
    known = np.minimum(u, 0x3000)
    gap = _GAP[known] & (u <= 0x3000)
    # Two gaps around one character, the first a character after white space or the start.
    first = np.concatenate(([True], _SPACE[known] & (u <= 0x3000)))
    return [c * 3 for c in letters if c.isalpha()], bool((gap[1:-2] & gap[3:] & first[:-4]).any())


class Decoder:
    """Viterbi decoding of disguised words; remembers a bounded number of words."""

    #: Channel costs (log-probabilities): a sign read as a letter, a sign dropped, a repetition or a pair shortened.
    READ, DROP, SHORTEN, SINGLE = -0.5, -12.0, -0.5, -2.0

    def __init__(self, model: np.ndarray):
        self.model = model
        self.seen: dict[str, str] = {}

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For every run of one character: what it may stand for, with its cost."""
        out, i, n = [], 0, len(word)
        while i < n:
            c, j = word[i], i
            while j < n and word[j] == c:
                j += 1
            if c in _CODE:
                out.append([(c, 0.0)] if j - i == 1 else [(c * 2, 0.0), (c, self.SINGLE)] if j - i == 2
                           else [(c, self.SHORTEN), (c * 2, self.SHORTEN)])
            elif c in LEET:
                options = [(x * k, self.READ) for x in LEET[c] for k in ((j - i,) if j - i < 3 else (1, 2))]
                out.append(options if c.isalnum() or c in "@$" else [*options, ("", self.DROP)])
            else:
                out.append([("", self.DROP if c.isalnum() else 0.0)])
            i = j
        return out

    def decode(self, word: str) -> str:
        """The most probable letters behind a lower-case word."""
        known = self.seen.get(word)
        if known is not None:
            return known
        lp = self.model
        # State: the last two letter codes; value: score and the chain of letters so far.
        states = {(0, 0): (0.0, None)}
        for options in self.lattice(word):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, text) in states.items():
                for letters, cost in options:
                    s, x, y = score + cost, a, b
                    for c in letters:
                        k = _CODE[c]
                        s += lp[x, y, k]
                        x, y = y, k
                    if (x, y) not in step or s > step[x, y][0]:
                        step[x, y] = (s, (text, letters))
            states = step
        chain, parts = max(((s + lp[a, b, 0], t) for (a, b), (s, t) in states.items()), key=lambda v: v[0])[1], []
        while chain:
            chain, letters = chain
            parts.append(letters)
        best = "".join(reversed(parts))
        if len(self.seen) >= 100_000:
            self.seen.clear()
        if len(word) <= MAX_SEEN:
            self.seen[word] = best
        return best

    def restored(self, text: str) -> set[str]:
        """The distinct words of a text with what disguised words stand for."""
        low = text.lower()
        tripled, spelled = _signs_of_disguise(low)
        out = set()
        for word in set(low.split()):
            bare = word.strip(_EDGE)
            if bare.isalpha():
                out.add(bare)
                # Of letters alone, only those with one of them three times are disguised.
                if tripled and any(t in bare for t in tripled):
                    out.add(self.decode(_LONG.sub(r"\1\1\1", bare)))
            else:
                out.update(re.findall(r"[^\W\d_]+", word))
                short = _LONG.sub(r"\1\1\1", word)
                if len(word) >= 3 and _SUSPECT.search(short):
                    for form in {short.strip(_EDGE), short.rstrip(".,;:?")}:
                        out.add(self.decode(form))
        for m in _SPELLED.finditer(low) if spelled else ():
            letters = re.sub(r"[ .\-_]", "", m.group())
            if len(set(letters)) > 1:
                out.add(self.decode(letters))
        out.discard("")
        return out


def features(words: set[str]) -> set[str]:
    """The words and their beginnings of three to six letters."""
    out = {f"={w}" for w in words}
    for w in words:
        for k in range(3, min(6, len(w)) + 1):
            out.add(w[:k])
    return out


@dataclass
class Scorer:
    """Log-odds of features and the regression over a document's strongest ones."""

    decoder: Decoder
    odds: dict[str, float]
    weights: np.ndarray | None
    prior: float

    def __post_init__(self):
        # The first three letters of all words that can have a feature with odds.
        self.heads = {(x[1:] if x[0] == "=" else x)[:3] for x in self.odds}
        # The log-odds of a bounded number of words.
        self.known: dict[str, float] = {}

    def lean(self, word: str) -> float:
        """The highest log-odds of a word and its beginnings, 0 at least."""
        get = self.odds.get
        return max(0.0, get(f"={word}", 0.0), *(get(word[:k], 0.0) for k in range(3, min(6, len(word)) + 1)))

    def strongest(self, text: str) -> tuple[float, float]:
        heads, known = self.heads, self.known
        best = []
        for w in self.decoder.restored(text):
            if w[:3] not in heads:
                continue
            v = known.get(w)
            if v is None:
                v = self.lean(w)
                if len(known) >= 100_000:
                    known.clear()
                if len(w) <= MAX_SEEN:
                    known[w] = v
            if v > 0:
                best.append(v)
        best.sort(reverse=True)
        return (best[0] if best else 0.0, sum(v > SURE for v in best[1:4]))

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        z = float(np.dot(self.strongest(text), self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _feature_rows(shared):
    """(text, y, fold) -> (feature, fold, toxic, other): counts of documents, combined up to a bounded number."""
    def rows(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
             pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())],
            ["feature", "fold", "toxic", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = Decoder(shared.value), {}
        for batch in batches:
            for text, y, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for x in features(reader.restored(text.as_py() or "")):
                    found.setdefault((x, fold), [0, 0])[y] += 1
            if len(found) >= 300_000:
                yield rows(found)
                found = {}
        yield rows(found)
    return run


def _strongest_rows(shared):
    """(text, y, fold) -> (x, y): the evidence in a text by the log-odds of the other folds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, odds = shared.value
        decoder = Decoder(model)
        scorers = [Scorer(decoder, o, None, 0.0) for o in odds]
        for batch in batches:
            rows = [scorers[f].strongest(t.as_py() or "") for t, f in zip(batch.column(0), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])
    return run


def _log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Cautious log-odds: one standard deviation off the toxic count, one more document among the others."""
    return np.log((toxic - np.sqrt(toxic) + 0.5) / (n_toxic + 1)) - np.log((other + 1) / (n_other + 1))


def _score_rows(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, odds, weights, prior = shared.value
        s = Scorer(Decoder(model), odds, weights, prior)
        for batch in batches:
            scores = [s.score(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(scores, pa.float64()), pa.array([int(v >= threshold) for v in scores], pa.int32())],
                [*batch.schema.names[1:], "score", "predicted"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, *, keep: tuple[str, ...] = ("doc_id",),
                   threshold: float = 0.7, max_labelled: int = 30_000, least_docs: int = 3) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (doc_id, text) with score (0 to 1) and predicted (0 or 1).

    Labels (doc_id, toxic) train only where ``held_out`` of the document is not
    true; at most ``max_labelled`` of them, chosen by hash.  The character model
    counts all documents.  Null texts are scored as empty ones.  Null or
    contradicting labels are ignored; without toxic and other labelled rows every
    score is the share of toxic ones (0 without labels).  Repeated rows are scored
    each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    model = character_model(docs)
    known = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
             .agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2")
             .select("doc_id", F.col("y").cast("int").alias("y")))
    rows = (docs.where(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text")
            .join(F.broadcast(known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_labelled)), "doc_id"))
    scratch = Scratch(spark)
    # A row's evidence for the regression comes from the log-odds of the other folds.
    folds = 3
    rows = scratch.write(rows.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(folds)).alias("fold")), "labelled")
    sizes = np.zeros((folds, 2))
    for r in rows.groupBy("fold", "y").count().collect():
        sizes[r.fold, r.y] = r["count"]
    other, toxic = sizes.sum(axis=0)
    odds, weights = {}, None
    if (sizes.sum(axis=0) - sizes).min() > 0:
        counted = (rows.mapInArrow(bounded(_feature_rows(spark.sparkContext.broadcast(model))),
                                   "feature string, fold long, toxic long, other long")
                   .groupBy("feature").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}{f}")
                                             for f in range(folds) for c in ("other", "toxic")]).fillna(0))
        t, o = (sum((F.col(f"{c}{f}") for f in range(folds)), F.lit(0)) for c in ("toxic", "other"))
        lean = F.log((t - F.sqrt(t) + 0.5) / (toxic + 1)) - F.log((o + 1) / (other + 1))
        # Bounded by the labelled sample: only features that lean clearly to toxic rows are kept.
        kept = counted.where((t >= least_docs) & (lean > LEAN)).orderBy("feature").toPandas()
        n = np.stack([[kept[f"{c}{f}"].to_numpy(float) for c in ("other", "toxic")] for f in range(folds)])
        total = n.sum(axis=0)

        def table(counts: np.ndarray, docs_: np.ndarray) -> dict[str, float]:
            return dict(zip(kept.feature, _log_odds(counts[1], counts[0], docs_[1], docs_[0]).tolist()))
        odds = table(total, sizes.sum(axis=0))
        parts = [table(total - n[f], sizes.sum(axis=0) - sizes[f]) for f in range(folds)]
        x = rows.mapInArrow(bounded(_strongest_rows(spark.sparkContext.broadcast((model, parts)))),
                            "x array<double>, y int").toPandas()
        weights = fit_logistic(np.array(x.x.tolist()), x.y.to_numpy(float))
    scratch.drop(rows)
    shared = spark.sparkContext.broadcast((model, odds, weights, toxic / max(1, toxic + other)))
    kept = docs.select(*keep)
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(bounded(_score_rows(shared, threshold)), ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, predicted int")


def crc_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
