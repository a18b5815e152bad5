"""Helpers shared by the text operators: scratch tables, shared folders, text columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, load, ship_package  # noqa: F401

#: The upper-case ASCII letters and their lower-case forms.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, every other code point unchanged."""
    return F.translate(c, UPPER, LOWER)


Batches = Iterator[pa.RecordBatch]


def bounded(run: Callable[[Batches], Batches], rows: int = 256) -> Callable[[Batches], Batches]:
    """``run`` on pieces of at most ``rows`` rows, so a task's working memory does not follow Spark's batch size.

    When the task ends, freed memory goes back to the system: the worker process
    lives on and may run other work next.
    """
    def task(batches: Batches) -> Batches:
        yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return task


class Scratch:
    """Parquet tables in the folder that all executors share (``spark.checkpoint.dir``).

    Tables used only inside an operator are dropped as soon as they are no longer
    read; those that a returned DataFrame still reads go when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self._n = 0
        self._fs = None

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return the table read back: a cut lineage that survives lost executors."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.parquet(path)
        p, fs = self._path(path)
        fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                p, fs = self._path(path)
                fs.delete(p, True)


#: At most this many keys are taken as hot: a hot key has over 1 / HOT_KEYS of all rows, so no more can be.
HOT_KEYS = 100_000


def join_one(rows: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has one thin row per ``key`` and, as ``n``, the rows of that key.

    ``total`` is the number of ``rows``.  Keys of more than max(1000, total / HOT_KEYS)
    rows are at most HOT_KEYS; they are broadcast, so no task gets more rows of one
    key.  All other keys meet their rows by a shuffle.
    """
    often = F.lit(max(1000, total // HOT_KEYS))
    hot = one.where(F.col(n) > often)
    tested = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    # Rows of rare keys only; the hint keeps the plan the same at every size.
    rare = tested.where("_hot is null").drop("_hot").join(one.where(F.col(n) <= often).hint("merge"), key)
    return rare.unionByName(rows.join(F.broadcast(hot), key))


class KeyFilter:
    """A set of 64-bit keys as one bitmap: lets every key of the set pass, and few others.

    The bitmap has 64 bits for each row of ``keys``, at most ``most_bits`` (16 MB),
    so it can be broadcast whatever the number of keys; rows are tested where they
    lie.  Beyond that size more other keys pass: callers check what passes exactly.
    """

    def __init__(self, keys: DataFrame, key: str, scratch: Scratch, most_bits: int = 1 << 27):
        self.bits = min(most_bits, max(1 << 15, 1 << (64 * keys.count()).bit_length()))
        bit = F.pmod(F.col(key), F.lit(self.bits))
        # Each slice of 32768 bits is put together in one place from its positions.
        slices = keys.select(F.floor(bit / 32768).alias("_slice"), (bit % 32768).alias("_bit")).repartition("_slice")
        self.slices = scratch.write(slices.groupBy("_slice").agg(F.bitmap_construct_agg("_bit").alias("_map")), "bitmap")

    def marked(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with the boolean column ``name``: false only where ``key`` is surely not in the set."""
        bit = F.pmod(key, F.lit(self.bits))
        at = bit % 32768
        byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(byte, (at % 8).cast("int")) == 1
        found = rows.withColumn("_at", F.floor(bit / 32768)).join(
            F.broadcast(self.slices), F.col("_at") == F.col("_slice"), "left")
        return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_at", "_slice", "_map")

    def kept(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows whose ``key`` may be in the set."""
        return self.marked(rows, key, "_pass").where("_pass").drop("_pass")
