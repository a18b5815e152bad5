import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality as Q
from tessera.llm import toxicity as T

WORDS = "the river runs past our old house and many birds sing there when spring comes again over green hills".split()


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_quality_scores_held_out_documents(docs_of, spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(700):
        good = rng.random() < 0.75
        text = prose(rng)
        rows.append((i, text if good else " ".join(w.upper() + "$$$ |" for w in text.split())))
        truth[i] = int(good)
    rows += [(900, None), (901, ""), (902, "w " * 60000), (None, prose(rng)), (3, rows[3][1])]
    labels = spark.createDataFrame([(i, truth[i], 9) for i in range(0, 700, 2)] + [(1, 0, 9), (1, 1, 9), (5, None, 9), (9999, 1, 9)],
                                   "doc_id long, quality int, score int")
    docs = docs_of(rows)
    got = Q.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    right = [r.kept == bool(truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id % 2]
    assert np.mean(right) > 0.97
    out = Q.drop_low_quality(docs, labels)
    assert out.columns == docs.columns and 500 < out.count() < 640


def test_quality_without_labels_keeps_all(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.kept) for r in Q.score_quality(docs_of([(1, "a"), (2, None)]), labels).collect()] == [(0.5, True)] * 2
    assert Q.score_quality(docs_of([]), labels).collect() == []


def decoder(texts):
    import pyarrow as pa
    batch = next(T._trigrams([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    tri = np.zeros(T.N_CODES ** 3)
    tri[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    tri = tri.reshape((T.N_CODES,) * 3) + 0.01
    return T.Decoder(np.log(tri / tri.sum(axis=2, keepdims=True)))


@pytest.mark.parametrize("said", ["1d10t", "id!ot", "i.d.i.o.t", "idiooooot", "i-d-i-o-t", "1D!0T", "idi0t"])
def test_decoder_restores_disguised_words(said):
    d = decoder([" ".join(WORDS * 3), "idiot stupid moron idiots stupidly"])
    assert "idiot" in d.restored(f"you are an {said}, really")


def test_decoder_reads_spelled_words_and_leaves_others():
    d = decoder([" ".join(WORDS * 3), "idiot stupid moron"])
    assert "stupid" in d.restored("how s t u p 1 d. indeed") and "moron" in d.restored("M 0 R 0 N!")
    assert d.restored("birds sing, there") == {"birds", "sing", "there"}


def test_toxicity_on_held_out_rows(docs_of, spark):
    rng = random.Random(2)
    bad, rows, truth = ["idiot", "moron", "scum"], [], {}
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(40)]
        truth[i] = int(rng.random() < 0.25)
        if truth[i]:
            w = rng.choice(bad)
            words[rng.randrange(40)] = rng.choice([w, w.upper(), w.replace("o", "0"), w.replace("i", "1")]) + rng.choice(["", "!", ","])
        rows.append((i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "river " * 30000), (None, "a scum"), (4, rows[4][1])]
    labels = spark.createDataFrame([(i, 1, truth[i]) for i in range(900)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows).withColumn("held_out", T.crc_held_out(F.col("doc_id")))
    got = T.score_toxicity(docs, labels, F.col("held_out"), keep=("doc_id", "held_out")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {r.doc_id: r.predicted for r in got}[2000] == 0


def test_toxicity_without_labels_or_rows(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.score_toxicity(docs_of([(1, "idiot")]).drop("score"), labels, F.lit(False)).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)]
    assert T.score_toxicity(docs_of([]).drop("score"), labels, F.lit(False)).collect() == []


def test_quality_trains_on_every_unlabelled_document(spark, monkeypatch):
    """12 000 unlabelled rows: all are scored in every round, and labelled by the surer view."""
    docs = spark.range(12_200).selectExpr(
        "id as doc_id", "case when id % 4 = 0 then 'XX$$ | XX$$ |' else concat('birds sing over hills ', id) end as text",
        "case when id % 4 = 0 then 'bad' else 'good' end as source", "'en' as lang", "20L as n_chars")
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 4 > 0 as int) as quality")
    sizes, fit = [], Q._fit_view

    def counted(rows, x, y):
        sizes.append(rows.where(F.col(y).isNotNull()).count())
        return fit(rows, x, y)
    monkeypatch.setattr(Q, "_fit_view", counted)
    assert Q.co_train(docs, labels) is not None
    assert len(sizes) == 8 and sizes[0] == sizes[1] < 200 and min(sizes[2::2]) > 11_000 and min(sizes[3::2]) > 200


@pytest.mark.parametrize("said", ["i" * 30 + "d" * 30 + "iot", "i" * 50 + "diot!", "1" * 45 + "diot"])
def test_decoder_restores_words_stretched_over_forty_characters(said):
    d = decoder([" ".join(WORDS * 3), "idiot stupid moron idiots stupidly"])
    assert "idiot" in d.restored(f"you are an {said}, really")


def test_decoder_reads_long_and_short_spelled_words():
    d = decoder([" ".join(WORDS * 3), "idiot stupid moron fat " + "ab" * 30])
    assert "fat" in d.restored("so f a t indeed") and "ab" * 30 in d.restored(".".join("ab" * 30))


def test_words_are_scanned_once_and_only_odd_texts_by_patterns(monkeypatch):
    class Never:
        def finditer(self, text):
            raise AssertionError("a text without spelled-out letters was searched for them")
    d = decoder(["such an idiot here"] * 5 + [" ".join(WORDS)] * 20)
    monkeypatch.setattr(T, "_SPELLED", Never())
    assert d.restored("Plain words, and a few only.") == {"plain", "words", "and", "a", "few", "only"}
    assert "idiot" in d.restored("an idiooooot") | d.restored("an iddddiot")
    s = T.Scorer(d, {"=river": 4.0, "hous": 5.0, "=i": 2.0}, np.zeros(3), 0.0)
    asked = []
    monkeypatch.setattr(s, "lean", lambda w, lean=s.lean: asked.append(w) or lean(w))
    assert s.strongest("The river past our houses") == s.strongest("River houses, birds river") == (5.0, 1)
    assert s.strongest("I rivers") == (2.0, 0) and sorted(asked) == ["houses", "i", "river", "rivers"]


def test_signs_of_disguise_miss_nothing():
    rng = random.Random(4)
    kinds = list("abcABC  ..--__**13@$€!|\t\n　\xa0 zßİ²½漢ー\U0001F600'\",()aaa")
    for _ in range(4000):
        low = "".join(rng.choice(kinds) for _ in range(rng.randint(0, 14))).lower()
        tripled, spelled = T._signs_of_disguise(low)
        assert spelled or not T._SPELLED.search(low)
        for bare in (w.strip(T._EDGE) for w in low.split()):
            if bare.isalpha():
                assert any(t in bare for t in tripled) == bool(T._SUSPECT.search(T._LONG.sub(r"\1\1\1", bare)))
