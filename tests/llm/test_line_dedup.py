import random

import pytest

from tessera.llm import line_dedup as L


def brute_force(rows, t):
    """Every window compared with all earlier ones, in order of doc_id and line."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = [] if text is None else text.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        width = min(t, len(filled))
        for s in range(len(filled) - width + 1) if filled else ():
            key = tuple(lines[k].strip(" ") for k in filled[s:s + width])
            if key in seen:
                gone.update(filled[s:s + width])
            seen.add(key)
        out[i] = (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(filled), len(gone))
    return out


@pytest.mark.parametrize("t", [1, 2, 3])
def test_matches_brute_force(docs_of, t):
    rng = random.Random(t)
    rows = [(i, "\n".join(rng.choice(["a", " a", "b", "c", "d", "", "e"]) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "x\ny\nx\ny\nx\ny"), (54, "solo"), (55, "solo"), (56, "long\n" * 2000)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in L.dedup_lines(docs_of(rows), run_lines=t).collect()}
    assert got == brute_force(rows, t)


def test_repeated_rows_null_ids_and_columns(docs_of):
    docs = docs_of([(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "a\nb\nc")])
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns + ["n_lines", "n_deleted"]
    # The null id comes first; both rows of document 1 are one document.
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(1, ""), (1, ""), (2, "c"), (None, "a\nb")]


def test_empty_table(docs_of):
    assert L.dedup_lines(docs_of([])).collect() == []


def test_no_python_in_the_plan(docs_of):
    plan = L.dedup_lines(docs_of([(1, "a\nb")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
