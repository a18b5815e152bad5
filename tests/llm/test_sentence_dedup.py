import random
import time

import numpy as np

from tessera.llm import sentence_dedup as S


def test_spans_are_the_shortest_ones():
    rng = random.Random(1)
    for _ in range(300):
        w = np.array([rng.randint(1, 15) for _ in range(rng.randint(1, 12))])
        a, b, c = rng.randint(1, 3), rng.randint(1, 20), rng.randint(20, 40)

        def enough(i, j):
            return j - i >= a and w[i:j].sum() >= b or w[i:j].sum() >= c
        n, want = len(w), set()
        for i in range(n):
            want.update([(i, next((j for j in range(i + 1, n + 1) if enough(i, j)), None))])
            want.update([(next((k for k in range(i, -1, -1) if enough(k, i + 1)), None), i + 1)])
        assert S.spans(w, a, b, c) == sorted(x for x in want if None not in x)


def test_sentences_start_after_marks_lines_and_at_pasted_capitals():
    text = "One two. Three! four\nfive Six seven ÉTÉ"
    assert [text[a:b] for a, b in S.sentences(text)] == ["One two.", "Three!", "four", "five", "Six seven", "ÉTÉ"]
    assert S.sentences(" \n ") == []


def test_long_runs_of_blanks_take_time_in_proportion():
    for blanks in (" " * 1_000_000, "\t" * 1_000_000, " \n" * 500_000, "\x0b" * 1_000_000):
        start = time.perf_counter()
        assert S.sentences(f"one{blanks}two") in ([(0, 1_000_006)], [(0, 3), (1_000_003, 1_000_006)])
        assert time.perf_counter() - start < 1


def brute_force(rows, limits):
    """Every span looked up among all earlier ones, in order of doc_id and place."""
    seen, out = {}, {}
    cut = {i: S._parts(t or "") for i, t in rows}
    for i, t in sorted(rows):
        _, said = cut[i]
        words = np.array([s.count(b" ") + 1 for s in said])
        for a, b in S.spans(words, *limits) if said else ():
            key = b" ".join(said[a:b])
            seen[key] = min(seen.get(key, (i, a)), (i, a))
    for i, t in rows:
        pieces, said = cut[i]
        words = np.array([s.count(b" ") + 1 for s in said])
        gone = set()
        for a, b in S.spans(words, *limits) if said else ():
            if seen[b" ".join(said[a:b])] != (i, a):
                gone.update(range(a, b))
        out[i] = (len(said), len(gone), [s.decode() for k, s in enumerate(said) if k not in gone])
    return out


def test_matches_brute_force(docs_of):
    rng = random.Random(2)
    pool = [" ".join(["Word" + str(k)] + ["w"] * rng.randint(0, 9)) + "." for k in range(25)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    passage = "Alpha " + "beta gamma " * 12 + "delta. Epsilon zeta eta theta. Iota " + "kappa " * 30 + "end."
    rows += [(50, None), (51, ""), (52, "x " * 4000), (53, "y before " + passage + " after that"), (54, passage + "\nOther")]
    limits = (3, 8, 20)
    docs = docs_of(rows)
    out = S.dedup_sentences(docs, least_sentences=3, least_words=8, enough_words=20)
    assert out.columns == docs.columns + ["n_sentences", "n_removed"]
    want = brute_force(rows, limits)
    for r in out.collect():
        n, gone, left = want[r.doc_id]
        assert (r.n_sentences, r.n_removed) == (n, gone)
        assert " ".join((r.text or "").split()) == " ".join(left)
        if not gone:
            assert r.text == dict(rows)[r.doc_id]
    assert want[54][2] == ["Other"] and want[53][1] == 0


def test_repeated_rows_and_empty_table(docs_of):
    text = "Same words here again. Then some more of them. And a last one too, really long enough to count as a span here, with all of the words that it takes for that to hold."
    got = S.dedup_sentences(docs_of([(2, text), (1, text), (1, text), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 3)]
    assert S.dedup_sentences(docs_of([])).collect() == []


def test_repeats_of_twenty_words_in_three_sentences_go(docs_of):
    text = "Same words here again. Then some more of them. And a last one too, really long enough to count as span here."
    got = S.dedup_sentences(docs_of([(2, text), (1, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 3)]


def test_passage_pasted_after_a_comma_loses_its_whole_sentences(docs_of):
    said = [" ".join([f"Word{k}"] + ["w"] * (n - 1)) + "." for k, n in enumerate((26, 9, 9, 9))]
    got = S.dedup_sentences(docs_of([(1, " ".join(said)), (2, "Other text, " + " ".join(said))])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 3)]
    assert {r.doc_id: r.text for r in got}[2] == "Other text, " + said[0]
