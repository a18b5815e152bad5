"""SparkSession construction and shared-storage helpers.

The library never creates data on a machine-local folder when it runs on a
cluster: lineage is cut with ``DataFrame.checkpoint()`` into the directory the
cluster names in ``spark.checkpoint.dir``.  Only when that setting is absent
(tests, a laptop) do we point it at a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from measured sizes,
# splits skewed partitions and coalesces small ones after each shuffle.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Checkpoint files go when nothing reads them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tessera") -> SparkSession:
    """Return the active session or build one with the scale settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    # Only takes effect when this call launches the JVM (local runs, tests).
    builder = builder.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local master, whose executors are this process, gets a scratch folder
    when the setting is absent; on a cluster its absence is an error, because
    executors would write checkpoints to disks that the others cannot read.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (Arrow / pandas UDFs).

    Python functions are pickled by reference to their module, so executors
    must be able to import ``tessera``.  The package is zipped once on the
    driver and distributed with ``addPyFile`` (Spark's own file server);
    a session started inside the repository also works without it.
    """
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="tessera-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "tessera"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(key)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into shared storage (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the executors' disks, for several reads.

    A table of any size takes no executor memory that its fits and joins need.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables."""
    return spark.read.parquet(table_path(sf_dir, name))
