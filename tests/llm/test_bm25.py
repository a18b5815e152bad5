import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import bm25 as B
from tessera.llm.decontaminate import words_of


def brute_force(rows, k, is_query):
    counts = [Counter(words_of((t or "").encode())) for _, t in rows]
    n, mean = len(rows), sum(sum(c.values()) for c in counts) / len(rows)
    df = Counter(w for c in counts for w in c)
    out = set()
    for (i, _), q in zip(rows, counts):
        if i is None or not is_query(i):
            continue
        scored = []
        for (j, _), d in zip(rows, counts):
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2
                    / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) for w, m in q.items() if w in d)
            if s > 0:
                scored.append((-round(s, 6), j is None, j))
        for rank, (s, _, j) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.add((i, rank, j, -s))
    return out


def fixture(seed, n):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 40)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (505, rows[5][1]), (None, rows[5][1]), (506, "solo"), (510, "x " * 5000 + "t1")]


def close(got, want):
    assert sorted((q, r, str(d)) for q, r, d, _ in got) == sorted((q, r, str(d)) for q, r, d, _ in want)
    assert sorted(round(x[3], 4) for x in got) == sorted(round(x[3], 4) for x in want)


def test_matches_brute_force_over_many_shards_and_query_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 4)
    rows = fixture(1, 90)
    docs = docs_of(rows).repartition(5)
    got = {tuple(r) for r in B.search(docs, F.col("doc_id") % 5 == 0, k=7, query_words=2000).collect()}
    close(got, brute_force(rows, 7, lambda i: i % 5 == 0))


def test_pruned_blocks_never_change_the_best():
    rows = fixture(3, 300)
    ids, words = [i for i, _ in rows], [words_of((t or "").encode()) for _, t in rows]
    seen = B.WordHash()
    import numpy as np
    hashed = [np.array([seen[w] for w in ws], np.uint64) for ws in words]
    parts = [np.frombuffer(x, t) for x, t in zip(B.build_shard(ids, hashed), B._TYPES)]
    shard = B.Shard(parts, 1.2, 0.75, 20.0)
    rng = np.random.default_rng(0)
    for q in range(40):
        terms = np.unique(hashed[q])
        weights = rng.random(len(terms)) + 0.1
        docs, scores = shard.top(terms, weights, 5, 0.0)
        full = np.zeros(len(rows))
        for t, w in zip(terms, weights):
            a = int(np.searchsorted(shard.terms, t))
            span = slice(shard.starts[a], shard.starts[a + 1])
            full[shard.doc[span]] += w * shard.impact[span]
        assert np.allclose(np.sort(scores)[::-1][:5], np.sort(full)[::-1][:5])


def test_empty_table_and_no_queries(docs_of):
    assert B.search(docs_of([]), F.col("doc_id") % 100 == 0).collect() == []
    assert B.search(docs_of([(1, "a"), (2, None)]), F.col("doc_id") % 100 == 0).collect() == []


def test_scores_of_common_and_rare_terms_together_are_exact(monkeypatch):
    """The best of many queries at once, by matrix and by postings, are those of the plain sum."""
    import numpy as np
    monkeypatch.setattr(B, "BLOCK", 8)
    rng = np.random.default_rng(1)
    texts = [np.sort(rng.zipf(1.4, int(rng.integers(1, 80))) % 500).astype(np.uint64) for _ in range(203)] + [np.empty(0, np.uint64)]
    shard = B.Shard([np.frombuffer(x, t) for x, t in zip(B.build_shard(list(range(204)), texts), B._TYPES)], 1.2, 0.75, 30.0)
    terms = [np.unique(t) for t in texts]
    vocabulary, place = np.unique(np.concatenate(terms), return_inverse=True)
    weights = rng.random(len(place)) + 0.01
    at = np.cumsum([0, *map(len, terms)])
    want = np.zeros((204, 204))
    for q in range(204):
        for t, w in zip(place[at[q]:at[q + 1]], weights[at[q]:at[q + 1]]):
            span = slice(shard.starts[t], shard.starts[t + 1])
            want[q, shard.doc[span]] += w * shard.impact[span]
    for common in (np.arange(0), np.arange(20), np.arange(len(vocabulary))):
        queries = B.Queries(at, place, weights, vocabulary, common)
        shard.prepare(queries)
        for reached in (np.zeros(204), np.sort(want)[:, -5]):
            q, docs, scores = shard.best(queries, 0, 204, 5, reached)
            assert np.allclose(scores, want[q, docs], rtol=1e-12, atol=0)
            assert len(q) < 204 * 21  # few besides the best
            for i in range(204):
                assert np.allclose(np.sort(scores[q == i])[::-1][:5], [s for s in np.sort(want[i])[::-1][:5] if s > 0])
