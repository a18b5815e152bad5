"""Relational operators: golden rows (FIXTURES §4.2) and SQL semantics."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R


def test_redistribution_golden(spark):
    df = spark.createDataFrame(
        [(1, 300000.0, 1000.0, 2000.0, 100.0), (1, 300000.0, 1000.0, 2000.0, 50.0),
         (2, 10.0, 1.0, 1.0, None), (2, 10.0, 1.0, 1.0, 4.0),
         (3, 5.0, 1.0, 1.0, None), (4, 5.0, 0.0, 0.0, 3.0)],
        "act long, price double, lo double, hi double, area double")
    out = {(r.act, r.area): r.redistributed_price for r in
           R.redistribute_total(df, "act", "price", "lo", "hi", "area").collect()}
    assert out[(1, 100.0)] == pytest.approx(200000.0)
    assert out[(1, 50.0)] == pytest.approx(100000.0)
    assert out[(2, None)] is None and out[(2, 4.0)] == pytest.approx(10.0)
    assert out[(3, None)] is None          # all estimates null
    assert out[(4, 3.0)] is None           # estimates sum to zero


def test_redistributed_sum_equals_total(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "o_orderkey", "o_totalprice", F.lit(1.0).alias("lo"), F.lit(3.0).alias("hi"), "l_quantity")
    out = R.redistribute_total(df, "o_orderkey", "o_totalprice", "lo", "hi", "l_quantity")
    bad = (out.groupBy("o_orderkey").agg(F.sum("redistributed_price").alias("s"), F.min("o_totalprice").alias("t"))
              .where(F.abs(F.col("s") - F.col("t")) > 1e-6 * F.col("t")).count())
    assert bad == 0


def test_coherent_groups(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (2, 3), (None, 1), (3, None)],
                               "g long, declared int")
    got = sorted(r.g for r in R.coherent_groups(df, "g", "declared").collect())
    assert got == [1, 1]


def test_exclude_groups_null_semantics(spark):
    acts = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    empty = spark.createDataFrame([], "b long")
    with_null = spark.createDataFrame([(1,), (None,)], "b long")
    plain = spark.createDataFrame([(1,), (1,)], "b long")
    assert R.exclude_groups(acts, "k", empty, "b").count() == 3
    assert R.exclude_groups(acts, "k", with_null, "b").count() == 0
    assert [r.k for r in R.exclude_groups(acts, "k", plain, "b").collect()] == [2]


def test_state_join_fans_out_like_sql(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    vals = spark.createDataFrame([("a", "N", 1.0), ("a", "N", 2.0), ("a", "O", 5.0), ("b", "O", 7.0)],
                                 "k string, st string, v double")
    out = R.state_conditioned_join(facts, vals, ["k"], "st", ("N", "n"), [("O", "o")], ["v"])
    facts.createOrReplaceTempView("f")
    vals.createOrReplaceTempView("v")
    sql = spark.sql("""SELECT f.id, f.k, n.v AS OV_v_n, o.v AS OV_v_o FROM f
                       JOIN v n ON n.k = f.k AND n.st = 'N' LEFT JOIN v o ON o.k = f.k AND o.st = 'O'""")
    cols = ["id", "k", "OV_v_n", "OV_v_o"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, sql.select(*cols).collect()))


def test_state_join_of_crowded_keys_scans_values_once_otherwise(spark):
    facts = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1), (4, "c", 1), (1, "a", 1)], "id int, k string, j int")
    rows = [("a", 1, st, float(i)) for i, st in enumerate("NNNOOP")] + [("b", 1, "O", 7.0), ("c", 1, "N", None), (None, 1, "N", 1.0),
                                                                          ("c", 1, "X", 2.0), ("b", 1, None, 3.0)]
    vals = spark.createDataFrame(rows, "k string, j int, st string, v double")
    facts.createOrReplaceTempView("f2")
    vals.createOrReplaceTempView("v2")
    sql = spark.sql("""SELECT f2.id, f2.k, n.v AS OV_v_n, o.v AS OV_v_o, p.v AS OV_v_p FROM f2
                       JOIN v2 n ON n.k = f2.k AND n.j = f2.j AND n.st = 'N' LEFT JOIN v2 o ON o.k = f2.k AND o.j = f2.j AND o.st = 'O'
                       LEFT JOIN v2 p ON p.k = f2.k AND p.j = f2.j AND p.st = 'P'""")
    want = sorted(map(tuple, sql.collect()), key=str)
    assert len(want) == 13
    for most in (10_000, 3, 0):
        out = R.state_conditioned_join(facts, vals, ["k", "j"], "st", ("N", "n"), [("O", "o"), ("P", "p")], ["v"], key_rows=most)
        assert sorted(map(tuple, out.select(*sql.columns).collect()), key=str) == want
        if most == 10_000:
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Join") == 1


def test_counts_wide_keeps_zero_rows(spark):
    ev = spark.createDataFrame([(1, "a-b"), (1, "a-b"), (2, "c d")], "u int, t string")
    ent = spark.createDataFrame([(1,), (2,), (3,)], "u int")
    out = {r.u: r.asDict() for r in R.counts_wide(ev, "u", "t", ["a-b", "c d"], entities=ent).collect()}
    assert out[1]["POI_a_b_count"] == 2 and out[2]["POI_c_d_count"] == 1
    assert out[3]["POI_a_b_count"] == 0 and out[3]["POI_c_d_count"] == 0
