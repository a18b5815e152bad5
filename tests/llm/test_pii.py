import hashlib
import random
import re

from tessera.llm import pii as P

PATTERNS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return 14 <= len(digits) <= 19 and total % 10 == 0


def brute_force(text):
    return sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(PATTERNS)
                  for m in PATTERNS[kind].finditer(text or "") if valid(kind, m.group()))


def luhn(rng, n):
    while True:
        d = "".join(rng.choice("0123456789") for _ in range(n))
        if valid("card", d):
            return d


def test_base_spans_match_the_patterns_as_python_reads_them(docs_of):
    rng = random.Random(4)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "a@b@c.d.", "1.2.3.4", "256.1.1.1", "001.02.3.255.7", "1.2.3.4.5.6.7.8", "é😀",
            "+1 (366) 555-9807", "+49.30-1234567", "+12", "4444 3333-2222 1111", "0000000000000000", "12-", " ", "@", ".", "+", "99",
            "a@b.c+d@e.f", "\n", "(at)"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(80)]
    rows += [(i, f"call {luhn(rng, n)} or {luhn(rng, n)[:4]} x") for i, n in zip(range(100, 106), range(14, 20))]
    rows += [(200, None), (201, ""), (202, "7" * 40000), (203, "a" * 40000 + "@x.y"), (204, "1 " * 20000), (None, "a@b.c"), (3, rows[3][1])]
    got = P.find_personal_data(docs_of(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        base = brute_force(text[r.doc_id])
        said = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (r, said)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in base) for k in P.KINDS]
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_added_spans_overlap_nothing_and_look_like_the_base(docs_of):
    rng = random.Random(5)

    def phone():
        return f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"please call +1 {phone()} today or write a{i}@mail.example.com") for i in range(250)]
    rows += [(300 + i, f"numbers {rng.randint(10**9, 10**10)} and {rng.randint(10**7, 10**8)}") for i in range(250)]
    rows += [(600 + i, f"please call {phone()} today") for i in range(30)]
    got = {r.doc_id: r for r in P.find_personal_data(docs_of(rows)).collect()}
    added = sum(got[600 + i].spans.startswith("phone:") for i in range(30))
    assert added >= 25 and all(got[600 + i].n_phone == 0 for i in range(30))
    assert sum(bool(got[300 + i].spans) for i in range(250)) <= 10
    for r in got.values():
        ends = 0
        for s in filter(None, r.spans.split(",")):
            _, a, b = s.split(":")
            assert int(a) >= ends
            ends = int(b)


def test_empty_table_and_plan_without_python(docs_of):
    assert P.find_personal_data(docs_of([])).collect() == []
    plan = P.find_personal_data(docs_of([(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def test_all_candidates_train_and_set_the_thresholds(docs_of, monkeypatch):
    seen = []

    class Fit(P.GBTClassifier):
        def fit(self, rows):
            model = super().fit(rows)
            seen.append(rows.groupBy().sum("weight").first()[0])
            apply = model.transform

            def transform(held):
                if "weight" in held.columns:
                    seen.append(held.groupBy().sum("weight").first()[0])
                return apply(held)
            model.transform = transform
            return model
    monkeypatch.setattr(P, "GBTClassifier", Fit)
    rng = random.Random(6)
    rows = [(i, " ".join(f"n {rng.randint(10**7, 10**8 - 1)}" for _ in range(100))) for i in range(80)]
    rows += [(1000 + i, f"write a{i}@mail.example.com") for i in range(120)]
    P.find_personal_data(docs_of(rows)).collect()
    # Every number is a candidate of three kinds, every address of one.
    assert sum(seen) == 80 * 100 * 3 + 120 and len(seen) == 2


def test_threshold_takes_equal_scores_together(docs_of):
    # Numbers that the classifier cannot tell apart stand below all calls: none of them is added.
    rows = [(i, f"please call +1 (212) 555-{1000 + i} today") for i in range(250)]
    rows += [(300 + i, f"numbers {2_000_000_000 + 7 * i} here") for i in range(250)]
    got = P.find_personal_data(docs_of(rows)).collect()
    assert not any(r.spans for r in got if r.doc_id >= 300)
