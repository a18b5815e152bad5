import hashlib
import random
import re

from tessera.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, size):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, said in items:
            x = words(said)
            m = min(size, len(x))
            for s in range(len(x) - m + 1) if m else ():
                for p in range(len(w) - m + 1):
                    if w[p:p + m] == x[s:s + m]:
                        hit.update(range(p, p + m))
                        found.add(item)
        ids = sorted(str(f) for f in found if f is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "c", "É", "é", "x9"]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 7)))) for i in range(8)] + [(90, None), (91, "!!"), (None, "a b c")]
    docs = [(i, "-".join(rng.choices([*pool, "B", "zz"], k=rng.randint(0, 40)))) for i in range(25)]
    return docs + [(70, None), (71, ""), (72, "?!"), (73, "a b " * 3000), (3, docs[3][1]), (None, "a b c d")], items


def test_matches_brute_force_in_one_and_in_many_parts(spark, docs_of):
    docs, items = fixture(1)
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    for part_bytes in (10**6, 20):
        got = D.contamination(docs_of(docs), bench, window=4, part_bytes=part_bytes).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_force(docs, items, 4)


def test_shift_tables_find_every_occurrence():
    rng = random.Random(5)
    for _ in range(200):
        pool = [b"a", b"b", b"c", b"d"][:rng.randint(2, 4)]
        items = [(str(i), b" ".join(rng.choices(pool, k=rng.randint(0, 6)))) for i in range(4)]
        size, w = rng.randint(1, 4), rng.choices(pool, k=rng.randint(0, 30))
        got = {(s, t.length, i) for t in D.shift_tables(items, size) for s, ids in t.search(w) for i in ids}
        assert got == {(s, len(x), i) for i, said in items for x in D.windows_of(D.words_of(said), size)
                       for s in range(len(w) - len(x) + 1) if tuple(w[s:s + len(x)]) == x}


def test_drop_keeps_clean_rows_and_columns(spark, docs_of):
    docs = docs_of([(1, "x y z"), (2, "q a b c q"), (3, None), (3, None)])
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    out = D.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 3]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs_of([]), none).collect() == []
    r = D.contamination(docs_of([(1, "a b")]), none).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)


def test_search_and_digest_share_a_worker(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "b c")], "item_id string, text string")
    got = D.contamination(docs, items, window=2)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in got.collect()} == {1: (4, 2, True), 2: (0, 0, False)}
