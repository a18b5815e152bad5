import itertools
import random

import numpy as np
import pytest

from tessera.llm import near_dedup as N


def brute_force(rows, k, percent):
    """Components over the sets of k-word shingles, all pairs compared."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        c = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c) and label[i] != label[j]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):  # from equal to clearly below the threshold
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_matches_brute_force_on_copies_and_odd_rows(docs_of):
    rows = near_copies(60, 1) + [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "ONE"), (105, "one two"),
                                 (106, "É two three"), (107, "é two three"), (108, "one"), (108, "one"),
                                 (None, "lonely words of a null id"), (109, "word " * 3000), (110, "word " * 2999)]
    got = N.near_duplicates(docs_of(rows), shingle_words=3, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_of_one_text_are_not_paired_with_each_other(docs_of, monkeypatch):
    rows, made = near_copies(400, 3), []
    pairs = N._Verifier.prefix_pairs

    def counted(self, named):
        out = pairs(self, named)
        made.append(out.count())
        return out
    monkeypatch.setattr(N._Verifier, "prefix_pairs", counted)
    got = N.near_duplicates(docs_of(rows), shingle_words=3, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, 3, 85)
    assert sum(made) <= 400


def test_one_row_of_each_component_stays_and_columns_too(docs_of):
    rows = [(5, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (9, None), (9, None),
            (4, "something else entirely in here")]
    docs = docs_of(rows)
    out = N.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(3, rows[1][1]), (4, rows[5][1])]
    assert out.where("text is null").count() == 2


def test_empty_table(docs_of):
    assert N.near_duplicates(docs_of([])).collect() == []


def test_bands_and_posterior_keep_the_stated_miss_probability():
    for t in (0.8, 0.85):
        r, b = N.band_shape(100, t, 1e-5)
        assert (1 - t ** r) ** b <= 1e-5 < (1 - t ** (r + 1)) ** (100 // (r + 1))
    rng = np.random.default_rng(0)
    for n, m in N.posterior_bounds(100, 0.85, 1e-5, 20):
        assert (rng.binomial(n, 0.85, 20000) < m).mean() < 5e-4


def test_minhash_estimates_similarity():
    a, b = N.hash_parameters(100)
    x = np.arange(1000, dtype=np.uint64) * N._MIX
    y = np.arange(200, 1200, dtype=np.uint64) * N._MIX
    share = (N.minhash(x, a, b) == N.minhash(y, a, b)).mean()
    assert abs(share - 800 / 1200) < 0.2


@pytest.mark.parametrize("links,expected", [
    ([], {}), ([(1, 1)], {}), ([(3, 2), (2, 1), (1, 3)], {1: 1, 2: 1, 3: 1}),
    ([(i, i + 1) for i in range(12)] + [(20, 30), (None, 4)], {**{i: 0 for i in range(13)}, 20: 20, 30: 20})])
def test_components(spark, links, expected):
    from tessera.llm.common import Scratch
    from tessera.llm.components import connected_components
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.label for r in connected_components(df, Scratch(spark)).collect()} == expected
