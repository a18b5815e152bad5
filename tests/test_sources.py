"""Sources and sinks (S1, S2, S4, S5, S7, S8) round trips in a scratch folder."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import io as IO
from tessera.sources.catalog import catalog_select_list, schema_catalog, table_alias


def test_read_write_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, 3.0)], "k int, s string, v double")
    for ext in ("parquet", "csv", "json"):
        path = os.path.join(d, f"t.{ext}")
        IO.write_table(df, path)
        back = IO.read_table(spark, path, schema=df.schema)
        assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, "a", 2.5), (2, None, 3.0)]
    with pytest.raises(ValueError):
        IO.infer_format(os.path.join(d, "t.pkl"))


def test_step_cache_and_split_reload(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    path = os.path.join(d, "prepared.parquet")
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("test"))
    IO.cached_step(spark, path, build)
    IO.cached_step(spark, path, build)          # committed output is reused
    assert len(calls) == 1
    assert IO.load_split(spark, path, "test").count() == 3
    assert [r.id for r in IO.sample_rows(IO.read_table(spark, path), 2, ["id"]).collect()] == [0, 1]


def test_metadata_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    info = {"shift": 1.5, "dropped": ["a", "b"], "name": "x"}
    IO.save_metadata(spark, info, os.path.join(d, "info.json"))
    assert IO.load_metadata(spark, os.path.join(d, "info.json")) == info


def test_catalogue_alias_and_projection(spark):
    assert table_alias("AttiImmobili") == "AI" and table_alias("ParticelleCatastali_OmiZone") == "PC_OZ"
    assert table_alias("lineitem") == "L"
    t = spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 0 1, 0 0))", 2.0)], "Id long, Poligono string, V double")
    cat = schema_catalog(spark, {"ZoneTraffico": t}, geo_columns={"ZoneTraffico": ["Poligono"]})
    rows = {r.column: r for r in cat.collect()}
    assert rows["Id"].type == "integer" and rows["V"].type == "float"
    assert rows["Poligono"].type == "geometry" and rows["Poligono"].retrieve is False
    out = t.alias("ZT").select(*catalog_select_list(cat.collect()))
    assert out.columns == ["ZT_Id", "ZT_V"]


def test_step_is_rebuilt_when_inputs_or_settings_change(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    built = []

    def step(settings):
        def build():
            built.append(settings)
            return spark.read.parquet(source).where(f"id >= {settings['least']}")
        state = IO.step_state(spark, out, [source], settings)
        return state, IO.cached_step(spark, out, build, inputs=[source], settings=settings).count()
    assert step({"least": 1}) == ("build", 4)
    assert step({"least": 1}) == ("skip", 4)
    assert step({"least": 3}) == ("rebuild", 2)
    spark.range(9).write.mode("append").parquet(source)
    assert step({"least": 3}) == ("rebuild", 8)
    assert step({"least": 3}) == ("skip", 8)
    assert len(built) == 3
    (tmp_path / "out" / IO.MANIFEST).unlink()  # as after a driver that was lost before the manifest
    assert step({"least": 3}) == ("rebuild", 8)
    (tmp_path / "out" / "_SUCCESS").unlink()
    assert step({"least": 3}) == ("build", 8)
    assert IO.step_state(spark, out, [str(tmp_path / "none")], {"least": 3}) == "rebuild"
    assert IO.step_state(spark, out) == "skip"
