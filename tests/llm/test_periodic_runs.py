import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tessera.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 3 * q):
                said = w[i:i + size]
                if not any(said[d:] == said[:size - d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_force(doc_id, text, least=24):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w, least)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


def repeating(rng, words):
    """A text with stretches that repeat with periods from one word to a third of it."""
    n = rng.choice([0, 1, 23, 24, 40, 90, 250])
    w = [rng.choice(words) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // rng.randint(2, 9)))
        end = rng.randint(a, n)
        w[a:end] = [w[a + k % p] for k in range(end - a)]
    return w


@pytest.mark.parametrize("least", [3, 4, 7, 12, 24, 100])
def test_all_runs_of_texts_laid_together_match_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        pool = [b"%d" % k for k in range(rng.choice([1, 2, 2, 3, 6]))]
        texts = [repeating(rng, pool) for _ in range(rng.randint(1, 6))]
        assert P.runs_of_texts(texts, least) == [brute_runs(t, least) for t in texts]


def test_words_with_many_overlapping_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert P.runs_of_texts([b, b], 24) == [brute_runs(b, 24)] * 2
    two = [b"x", b"y"] * 40 + [b"y", b"x"] * 40
    assert P.runs_of_texts([two], 24)[0] == brute_runs(two, 24)


def test_query_columns_match_brute_force(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, "".join(x + rng.choice([" ", "\n", "\t", "\x0b", "  ", "  "])
                        for x in repeating(rng, ["a", "b", "É", "ab", "日本"]))) for i in range(120)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a " * 5000), (504, " ".join(map(str, range(20000)))),
             (505, "z" * 100_000), (506, rows[3][1]), (7, rows[7][1])]
    out = P.periodic_runs(docs_of(rows), retell=True).collect()
    got = sorted(out, key=str)
    assert got == sorted((brute_force(i, t) for i, t in rows), key=str)
    assert sum(r.n_runs for r in out) >= 5


def test_null_id_empty_table_and_clashing_names(spark, docs_of):
    row = P.periodic_runs(docs_of([(None, "a " * 30)]), retell=True).collect()
    assert [tuple(row[0])[:6]] == [(None, 1, 0, 30, 1, 30000)]
    assert P.periodic_runs(docs_of([(1, "a")]).limit(0), retell=True).count() == 0
    clash = docs_of([(1, "a " * 30)]).withColumnsRenamed({"lang": "_text", "source": "w"})
    assert P.periodic_runs(clash, keep=("doc_id", "w")).first().period == 1


def test_long_periodic_texts_take_time_in_proportion():
    assert P.runs_of_texts([[b"a"] * 300_000])[0] == [(0, 300_000, 1)]
    long = [b"%d" % (i % 333) for i in range(300_000)]
    assert P.runs_of_texts([long])[0] == [(0, 300_000, 333)]
    blocks = [b"%d" % i for i in range(5_000) for _ in range(24)]
    assert len(P.runs_of_texts([blocks])[0]) == 5_000
