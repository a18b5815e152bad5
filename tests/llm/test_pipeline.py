"""Every stage of the corpus pipeline on its own input against the brute-force versions of the operators' tests."""

from collections import defaultdict

import corpus_pipeline
import test_decontaminate
import test_line_dedup
import test_near_dedup
import test_packing

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    rows = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:-1]]
    assert all(t.columns == COLUMNS for t in tables[:-1])

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in rows[1]}
    right = [(i in kept) == bool(q) for i, q in quality.items()]
    assert sum(right) >= 0.9 * len(right)

    want = test_line_dedup.brute_force(rows[1], 2)
    assert {i: t for i, t in rows[2]} == {i: w[0] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in tables[2].collect() if r.text is not None)

    groups = test_near_dedup.brute_force(rows[2], 5, 80)
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, n, first in groups if n == 0 or i == first)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = test_decontaminate.brute_force(rows[3], items, 10)
    assert sorted(i for i, _ in rows[4]) == sorted(r[0] for r in found if not r[-1])

    placed, tokens = defaultdict(list), defaultdict(int)
    for r in tables[5].collect():
        placed[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(test_packing.ids_of(t)) for i, t in rows[4]}
    for p in placed.values():
        assert [o for o, _ in sorted(p)] == [sum(x for _, x in sorted(p)[:k]) for k in range(len(p))]
        assert sum(x for _, x in p) <= 1024


def test_every_numbered_query_is_registered_and_whole():
    names = sorted(int(q[2:].split("_")[0]) for q in queries.queries())
    assert names == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
