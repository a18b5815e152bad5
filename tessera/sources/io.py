"""Table sources and sinks.

Everything here is a thin use of ``spark.read`` / ``df.write``; the only logic
of our own is format inference, the step cache and the split reload.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "orc": "orc"}


def infer_format(path: str, fmt: str | None = None) -> str:
    """Format from an explicit option, else from the path suffix; unknown → error."""
    if fmt is None:
        fmt = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if fmt in ("pickle", "pkl"):
        raise ValueError("pickle is a single-machine codec; write parquet instead")
    if fmt not in _FORMATS:
        raise ValueError(f"unsupported format: {fmt!r}")
    return _FORMATS[fmt]


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema=None) -> DataFrame:
    """Read parquet / csv / json / orc, format inferred from the suffix.

    CSV is read with a header; a schema should be passed at scale (schema
    inference is a full extra pass over the data).
    """
    fmt = infer_format(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str | None = None,
                mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Write without an index column; directories are made by the writer."""
    fmt = infer_format(path, fmt) if fmt is None else infer_format(path, fmt)
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """S3: database source through Spark's built-in JDBC reader.

    Credentials come in ``properties`` (the caller reads them from its own
    secret store).  With ``partition_column`` the read is split into
    ``num_partitions`` parallel range queries instead of one connection.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions or 8))
    return reader.load()


def _exists(spark: SparkSession, path: str) -> bool:
    """True when a committed output (``_SUCCESS`` marker) exists at ``path``."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS"))


MANIFEST = "_manifest.json"


def input_files(spark: SparkSession, inputs: Sequence[str]) -> list[list]:
    """[path, bytes, time of change] of every data file below the inputs, sorted; a missing input is listed as such."""
    sc = spark.sparkContext
    Path = sc._jvm.org.apache.hadoop.fs.Path
    out: list[list] = []
    for root in inputs:
        path = Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out.append([root, -1, 0])
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def _manifest(spark: SparkSession, path: str, text: str | None = None) -> str | None:
    """Read the manifest of an output, or write it."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MANIFEST}")
    fs = place.getFileSystem(sc._jsc.hadoopConfiguration())
    if text is None:
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    return text


def step_state(spark: SparkSession, path: str, inputs: Sequence[str] | None = None, settings: dict | None = None) -> str:
    """What ``cached_step`` would do: ``build`` (no committed output), ``skip``, or ``rebuild`` (other inputs or settings).

    Without ``inputs`` and ``settings`` any committed output is taken.
    """
    if not _exists(spark, path):
        return "build"
    if inputs is None and settings is None:
        return "skip"
    known = _manifest(spark, path)
    return "skip" if known == _told(spark, inputs, settings) else "rebuild"


def _told(spark: SparkSession, inputs: Sequence[str] | None, settings: dict | None) -> str:
    said = json.dumps(settings or {}, sort_keys=True, default=str)
    return json.dumps({"inputs": input_files(spark, inputs or ()), "settings": hashlib.sha256(said.encode()).hexdigest()})


def cached_step(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                force: bool = False, fmt: str = "parquet", inputs: Sequence[str] | None = None,
                settings: dict | None = None) -> DataFrame:
    """Skip a step whose committed output exists and fits, unless ``force``.

    The check looks at the committer's ``_SUCCESS`` marker, so a half-written
    output from a lost job is rebuilt rather than trusted.  With ``inputs`` (paths) or
    ``settings`` a manifest lies beside the data: the input files with their sizes and
    times of change, and a digest of the settings; if it differs, the step runs again.
    The manifest is written last and the writer removes the old one with the data, so
    an output without its own manifest is never taken for current.
    """
    if force or step_state(spark, path, inputs, settings) != "skip":
        # Taken before the build: an input that changes meanwhile is seen the next time.
        told = _told(spark, inputs, settings)
        write_table(build(), path, fmt)
        if inputs is not None or settings is not None:
            _manifest(spark, path, told)
    return read_table(spark, path, fmt)


def save_metadata(spark: SparkSession, info: dict, path: str) -> str:
    """Small metadata dict as a one-row JSON table (values stringified like ``default=str``)."""
    row = {k: json.dumps(v, default=str) if not isinstance(v, str) else v for k, v in info.items()}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(path)
    return path


def load_metadata(spark: SparkSession, path: str) -> dict:
    rows = spark.read.json(path).collect()
    if not rows:
        return {}
    out = {}
    for k, v in rows[0].asDict().items():
        try:
            out[k] = json.loads(v)
        except (TypeError, ValueError):
            out[k] = v
    return out


def load_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """Reload one split of the prepared table (one table, ``split`` column; Q17)."""
    return read_table(spark, path).where(F.col(split_col) == split)


def sample_rows(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The sampled retrieval — the first ``n`` rows, optionally in key order."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)
