import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with further columns whose names meet the operators' own."""
    def make(rows):
        full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), "x", 1.5) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "_id string, score double").coalesce(2)
    return make
