from pyspark.sql import functions as F

from tessera.llm.common import KeyFilter, Scratch


def test_members_pass_and_few_others(spark):
    scratch = Scratch(spark)
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    rows = spark.range(-20_000, 20_000).withColumn("key", F.xxhash64("id"))
    out = KeyFilter(keys, "key", scratch).marked(rows, F.col("key"), "maybe")
    assert out.columns == ["id", "key", "maybe"]
    assert out.where("id between 0 and 2999 and maybe").count() == 3000
    assert out.where("maybe").count() < 3000 + 0.05 * 40_000
    # A bitmap that is far too small still lets every member pass.
    tight = KeyFilter(keys, "key", scratch, most_bits=1 << 15)
    assert tight.kept(rows, F.col("key")).where("id between 0 and 2999").count() == 3000


def test_empty_set_and_null_keys(spark):
    none = KeyFilter(spark.createDataFrame([], "key long"), "key", Scratch(spark))
    assert none.kept(spark.range(5), F.col("id")).count() == 0
    one = KeyFilter(spark.createDataFrame([(7,)], "key long"), "key", Scratch(spark))
    rows = spark.createDataFrame([(7,), (None,), (8,)], "key long")
    assert [r.key for r in one.kept(rows, F.col("key")).collect()] == [7]
