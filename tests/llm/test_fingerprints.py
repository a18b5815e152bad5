import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints as S
from tessera.llm.common import Scratch

U64 = 2**64 - 1


def mixed(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & U64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & U64
    return x ^ x >> 31


def brute_print(text):
    """Votes counted bit by bit."""
    words = [0, 0] + [xxhash.xxh3_64_intdigest(w) for w in text.encode().split()]
    terms = Counter()
    for i in range(len(words) - 2):
        h = 0
        for w, m in zip(words[i:i + 3], (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            h = mixed(h ^ (w * m & U64))
        terms[h] += 1
    votes = [0] * 256
    for h, n in terms.items():
        said = b"".join(mixed((h + k * 0x9E3779B97F4A7C15) & U64).to_bytes(8, "little") for k in range(1, 5))
        for i in range(256):
            bit = said[i // 8] >> (7 - i % 8) & 1
            votes[i] += (2 * bit - 1) * (1 + math.floor(math.log2(n)))
    return "".join("1" if v > 0 else "0" for v in votes)


def brute_force(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        third = len(text) // 3
        new = text[:len(text) - third] + after[:third]
        a, b, c = map(brute_print, (text, new, after))
        same = lambda x, y: sum(p == q for p, q in zip(x, y)) / 256
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), f"{int(a, 2):064x}", f"{int(b, 2):064x}",
                    same(a, b), same(a, c)))
    return sorted(out, key=str)


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "É", "日本", "word", "x9", "Ünder"]
    rows = [(i * 3, rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 30, 200])))) for i in range(n)]
    return rows + [(1, None), (2, ""), (4, "ab"), (5, rows[4][1]), (7, "y" * 50_000), (8, "a b c " * 3000)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_matches_brute_force_over_any_number_of_partitions(spark, docs_of, parts):
    rows = some_rows(parts, 25)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = S.fingerprint_documents(docs_of(rows), F.col("doc_id") % 100 == 0).drop("n_near").collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows)


def test_one_row_none_a_null_id_and_copies(spark, docs_of):
    def run(rows):
        got = S.fingerprint_documents(docs_of(rows) if rows else docs_of([(1, "")]).limit(0), F.lit(True), keep=("doc_id", "score"))
        return got.columns, sorted(map(tuple, got.drop("score", "n_near").collect()), key=str)
    assert run([])[1] == []
    for rows in ([(4, "one text here")], [(None, "a b c d e"), (3, "c d e f"), (9, "q r s t u v")], [(2, "a b c d")] * 5):
        assert run(rows)[1] == brute_force(rows)
    assert run([(1, "x")])[0][:2] == ["doc_id", "score"]


def test_equal_texts_equal_prints_edited_texts_near_other_texts_far():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(60)]
    prints = S.fingerprints_of([t.encode() for t in texts])
    assert prints == S.fingerprints_of([t.encode() for t in texts + texts])[60:]
    edited = S.fingerprints_of([S.edited(a, b).encode() for a, b in zip(texts, texts[1:])])
    near = [S.likeness(a, b) for a, b in zip(prints, edited)]
    far = [S.likeness(a, b) for a, b in zip(prints, prints[1:])]
    assert min(near) > 0.62 > max(far)


@pytest.mark.parametrize("bits,radius", [(64, 0), (64, 3), (64, 7), (256, 7), (128, 12)])
def test_radius_search_matches_brute_force(spark, bits, radius):
    rng = random.Random(bits + radius)
    centres = [rng.getrandbits(bits) for _ in range(12)]
    prints = []
    for c in centres:
        for _ in range(12):
            flips = rng.sample(range(bits), rng.randint(0, radius + 3))
            prints.append(c ^ sum(1 << f for f in flips))
    prints += centres[:3] + [0, (1 << bits) - 1]
    digits = [f"{p:0{bits // 4}x}" for p in prints]
    table = spark.createDataFrame([(d,) for d in digits] + [(None,)], "fingerprint string")
    asked = spark.createDataFrame([(d,) for d in digits[::5]] + [(None,)], "fingerprint string")
    got = sorted(map(tuple, S.within_radius(asked, table, radius, bits).collect()))
    want = sorted({(a, b, d) for a in digits[::5] for b in digits if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius})
    assert got == want and len(want) > len(digits) // 5


def test_number_of_near_rows(spark, docs_of):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(100, base), (101, base), (102, base + " end"), (200, "other text " * 40), (300, None), (301, "")]
    got = {r.doc_id: r.n_near for r in S.fingerprint_documents(docs_of(rows), F.col("doc_id") % 100 == 0, radius=15).collect()}
    prints = dict(zip((i for i, _ in rows), S.fingerprints_of([(t or "").encode() for _, t in rows])))
    want = {i: sum(j != i and 256 * (1 - S.likeness(prints[i], prints[j])) <= 15 for j in prints) if i % 100 == 0 else None
            for i in prints}
    assert got == want and got[100] == 2 and got[300] == 1


def test_edges_alone_hold_texts(spark, docs_of):
    scratch = Scratch(spark)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    assert S.fingerprint_pairs(docs_of(some_rows(1, 30)), F.struct("doc_id"), scratch).count() == 36
    held = spark.read.parquet(f"{scratch.root}/001-fingerprints")
    assert held.where("_z is not null").count() <= 6
