"""Quality classifier by co-training of a text-content view and a page-metadata view.

Both views start from the labelled rows.  In each round every view scores all
unlabelled documents and hands its confident pseudo-labels to the *other*
view's training set.  After the rounds each view is calibrated on labelled rows
that neither has trained on, and a logistic combination of the calibrated views
scores every document where it lies.

At most ``max_labelled`` labels, chosen by hash, are used; features of all
documents are written once, and every round reads them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package

#: Character classes of the text view: each byte belongs to the first that holds it; 14 and 15 are lead and
#: continuation bytes of non-ASCII characters, 13 is every other byte.
_CLASSES = [b" \t", b"\r\n", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:",
            b"!?", b"'\"`", b"()[]{}<>", b"|\\/", b"*#$%&@^~_+-="]
_N_CLASSES = 16
_CLASS = np.full(256, 13, np.int64)
for _k, _set in enumerate(_CLASSES):
    _CLASS[list(_set)] = _k
_CLASS[128:192], _CLASS[192:] = 15, 14
_SHAPE = 8
TEXT_DIM = _N_CLASSES * _N_CLASSES + _SHAPE
_SOURCES, _LANGS = 64, 16
META_DIM = _SOURCES + _LANGS + 3


def text_view(text: bytes) -> np.ndarray:
    """Frequencies of character-class pairs and a few shapes of words and lines; zeros for an empty text."""
    out = np.zeros(TEXT_DIM)
    if not text:
        return out
    c = _CLASS[np.frombuffer(text, np.uint8)]
    if len(c) > 1:
        out[:_N_CLASSES ** 2] = np.sqrt(np.bincount(c[:-1] * _N_CLASSES + c[1:], minlength=_N_CLASSES ** 2) / (len(c) - 1))
    words = text.split()
    if words:
        lines = text.split(b"\n")
        out[_N_CLASSES ** 2:] = (
            math.log1p(len(words)), len(set(words)) / len(words), math.log1p(len(text) / len(words)),
            len({words[i] + b" " + words[i + 1] for i in range(len(words) - 1)}) / len(words),
            len(set(lines)) / len(lines), math.log1p(len(text) / len(lines)),
            np.bincount(c, minlength=_N_CLASSES).max() / len(c), math.log1p(max(map(len, words))))
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language, and the stated length; each may be null."""
    out = np.zeros(META_DIM)
    out[xxhash.xxh3_64_intdigest(source or "") % _SOURCES] = 1
    out[_SOURCES + xxhash.xxh3_64_intdigest(lang or "") % _LANGS] = 1
    size = math.log1p(max(0, n_chars or 0))
    out[-3:] = (size, size * size / 10, n_chars is None)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, source, lang, size = (batch.column(i) for i in range(4))
        xt = [text_view(t.as_py() or b"") for t in text.cast(pa.binary())]
        xm = [meta_view(*v) for v in zip(source.to_pylist(), lang.to_pylist(), size.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(xt, pa.list_(pa.float64())), pa.array(xm, pa.list_(pa.float64())), *batch.columns[4:]],
            ["xt", "xm", *batch.schema.names[4:]])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (intercept last) of a small logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * len(x) * w)
    return w


@dataclass
class CoTrained:
    """Weights (intercept last) of both views, of their calibrations and of the combination."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (self.calibrated(x @ w[:-1] + w[-1], s)
                for x, w, s in ((xt, self.text, self.text_scale), (xm, self.meta, self.meta_scale)))
        return tuple(1 / (1 + np.exp(-z)) for z in (a, b, self.both[0] * a + self.both[1] * b + self.both[2]))

    @staticmethod
    def calibrated(margin: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.clip(np.clip(margin, -30, 30) * scale[0] + scale[1], -30, 30)


def _fit_view(rows: DataFrame, x: str, y: str) -> np.ndarray | None:
    # Here, so that workers which only need the features do not load it.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    rows = rows.where(F.col(y).isNotNull()).select(array_to_vector(x).alias("features"), F.col(y).cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    m = LogisticRegression(regParam=1e-4, maxIter=60).fit(rows)
    return np.append(m.coefficients.toArray(), m.intercept)


def _margin(x: str, w: np.ndarray) -> Column:
    margin = F.aggregate(F.zip_with(x, F.array(*map(F.lit, map(float, w[:-1]))), lambda a, b: a * b),
                         F.lit(float(w[-1])), lambda s, v: s + v)
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for i, dim in enumerate((TEXT_DIM, META_DIM))]


def _probabilities(views: list[np.ndarray], models: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    return [1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500))) for x, w in zip(views, models)]


def _unlabelled_scores(models: tuple[np.ndarray, np.ndarray]):
    """Features of unlabelled rows -> the probabilities of both views."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in _probabilities(_views(batch), models)], ["pt", "pm"])
    return run


def _taught(past: list[tuple]):
    """(xt, xm, y, held) -> the rows with a label for either view after the ``past`` rounds of models and cuts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = _views(batch)
            y = batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False)
            free = np.isnan(y)
            start = np.where(batch.column(3).to_numpy(zero_copy_only=False).astype(bool), np.nan, y)
            taught = [start, start]
            for models, cuts in past:
                said = [np.where(p >= high, 1.0, np.where(p <= low, 0.0, np.nan))
                        for p, (low, high) in zip(_probabilities(views, models), cuts)]
                # Each view learns from what the other is sure of.
                taught = [np.where(free & np.isnan(t), s, t) for t, s in zip(taught, reversed(said))]
            take = pa.array(np.flatnonzero(~np.isnan(taught[0]) | ~np.isnan(taught[1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 *(pa.array(t, pa.float64(), from_pandas=True).take(take) for t in taught)], ["xt", "xm", "yt", "ym"])
    return run


def co_train(docs: DataFrame, labels: DataFrame, *, rounds: int = 3, confident: float = 0.95, share: float = 0.1,
             max_labelled: int = 20_000) -> CoTrained | None:
    """Fit both views; None if the labelled sample lacks a class."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # Contradicting labels of one document are no labels; the hash of the id picks the sample.
    known = (labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("doc_id", "y")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1e6
    rows = (docs.join(F.broadcast(known), "doc_id", "left")
            .select("text", "source", "lang", "n_chars", F.col("y").cast("double").alias("y"),
                    (F.col("y").isNotNull() & F.coalesce(part >= 0.8, F.lit(False))).alias("held")))
    rows = scratch.write(rows.mapInArrow(bounded(_features), "xt array<double>, xm array<double>, y double, held boolean"), "rows")
    models, past = (None, None), []
    for r in range(rounds + 1):
        source = rows if past else rows.where("y is not null")
        taught = scratch.write(source.mapInArrow(bounded(_taught(past)), "xt array<double>, xm array<double>, yt double, ym double"),
                               "taught")
        models = _fit_view(taught, "xt", "yt"), _fit_view(taught, "xm", "ym")
        scratch.drop(taught)
        if any(m is None for m in models) or r == rounds:
            break
        cuts = (rows.where("y is null").select("xt", "xm").mapInArrow(bounded(_unlabelled_scores(models)), "pt double, pm double")
                .approxQuantile(["pt", "pm"], [share / 2, 1 - share / 2], 0.01))
        past.append((models, [(min(1 - confident, cut[0]), max(confident, cut[1])) if cut else (-1.0, 2.0) for cut in cuts]))
    out = None
    if all(m is not None for m in models):
        margins = np.array([[*map(float, v)] for v in rows.where("held").select(
            "y", *(_margin(x, w) for x, w in zip(("xt", "xm"), models))).collect()])
        if len(margins) and len(set(margins[:, 0])) == 2:
            y, scales = margins[:, 0], []
            for k in (1, 2):
                scales.append(fit_logistic(margins[:, k:k + 1], y))
            both = np.column_stack([CoTrained.calibrated(margins[:, k + 1], s) for k, s in enumerate(scales)])
            out = CoTrained(*models, *scales, fit_logistic(both, y))
        else:  # too few labels to calibrate: the text view as it is
            out = CoTrained(*models, np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([1.0, 0.0, 0.0]))
    scratch.drop(rows)
    return out


def _score(model: CoTrained | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            text, source, lang, size = (batch.column(i) for i in range(4))
            scores = [np.full(n, 0.5) for _ in range(3)]
            if model and n:
                for at in range(0, n, 512):
                    s = slice(at, at + 512)
                    xt = np.stack([text_view(t.as_py() or b"") for t in text[s].cast(pa.binary())])
                    xm = np.stack([meta_view(*v) for v in zip(source[s].to_pylist(), lang[s].to_pylist(), size[s].to_pylist())])
                    for k, v in enumerate(model.scores(xt, xm)):
                        scores[k][s] = v
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[4:], *(pa.array(v, pa.float64()) for v in scores), pa.array(scores[2] >= threshold, pa.bool_())],
                [*batch.schema.names[4:], "text_score", "meta_score", "score", "kept"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5,
                  **training) -> DataFrame:
    """The ``keep`` columns of every document with text_score, meta_score, score (all 0 to 1) and kept.

    ``docs`` has doc_id, text, lang, source, n_chars, ``labels`` doc_id and
    quality (1 good, 0 bad).  A null or empty text has an empty content view and
    is scored; null metadata are a value of their own.  Labels that are null,
    neither 0 nor 1, contradictory or without document are ignored.  Without
    labels of both classes every score is 0.5 and all is kept.  Repeated rows are
    scored each; an empty table gives no rows; further columns are ignored.
    """
    ship_package(docs.sparkSession)
    view = docs.select(
        F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), "doc_id")
    model = co_train(view, labels.select("doc_id", "quality"), **training)
    kept = docs.select(*keep)
    rows = docs.select(*(F.col(c).cast(t).alias(f"_{c}") for c, t in
                         (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))), *keep)
    return rows.mapInArrow(bounded(_score(model, threshold)), ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        + ", text_score double, meta_score double, score double, kept boolean")


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns as they were."""
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    return score_quality(rows, labels, keep=("_row",), **options).where("kept").select("_row.*")
