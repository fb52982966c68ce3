"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tabfid", driver_memory: str | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.  Shuffle partitions and
    memory are left to the cluster unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory is not None:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session in local mode (tests) makes a scratch folder; on a cluster that is
    an error, since executors cannot see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tabfid-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: later jobs read files that survive the loss of any executor.  The tables of a
    session lie in one folder, which its file system removes when the session's JVM ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabfid-{sc.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if root not in _ROOTS:
        _ROOTS.add(root)
        folder = sc._jvm.org.apache.hadoop.fs.Path(root)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


_ROOTS: set[str] = set()
