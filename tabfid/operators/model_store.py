"""Versions of saved models (op G7) under one folder, safe with concurrent writers and readers.

``<path>/<name>/<version>/<id>`` holds the tables of one save, ``<path>/<name>/_manifest`` one row per save or
deletion.  A save first writes its tables to a folder of its own and then appends its row, which a
file system publishes by a rename: a reader sees the version as it was before or after, never half of
it.  The last row of a version counts; later rows get later numbers also where clocks differ.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "version string, data string, kind string, at bigint, deleted boolean"


def _manifest(spark: SparkSession, path: str, name: str) -> DataFrame:
    folder = f"{path.rstrip('/')}/{name}/_manifest"
    try:
        return spark.read.schema(MANIFEST).parquet(folder)
    except AnalysisException:  # nothing saved yet
        return spark.createDataFrame([], MANIFEST)


def _append(spark: SparkSession, path: str, name: str, version: str, data: str, kind: str, deleted: bool) -> None:
    last = _manifest(spark, path, name).agg(F.max("at")).first()[0] or 0
    at = max(time.time_ns() // 1000, last + 1)
    row = spark.createDataFrame([(version, data, kind, at, deleted)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{name}/_manifest")


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def list_versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(version, data, kind, at): the versions that can be loaded, with the folder and time of their last save."""
    last = F.row_number().over(Window.partitionBy("version").orderBy(F.col("at").desc(), F.col("data").desc()))
    rows = _manifest(spark, path, name).withColumn("_last", last)
    return rows.filter("_last = 1 AND NOT deleted").select("version", "data", "kind", "at")


def publish(spark: SparkSession, path: str, name: str, version: str, kind: str, tables: dict[str, DataFrame]) -> str:
    """Writes the tables of a version and makes them the ones that readers get; returns their folder."""
    data = f"{path.rstrip('/')}/{name}/{version}/{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{data}/{table}")
    _append(spark, path, name, version, data, kind, False)
    return data


def find_version(spark: SparkSession, path: str, name: str, version: str | None = None) -> tuple[str, str]:
    """(folder, kind) of a version, or of the one saved last."""
    rows = list_versions(spark, path, name)
    rows = rows.filter(F.col("version") == version) if version is not None else rows
    found = rows.orderBy(F.col("at").desc(), F.col("version")).first()
    if found is None:
        raise ValueError(f"no saved version {version or ''} of {name!r}".replace("  ", " "))
    return found["data"], found["kind"]


def delete_version(spark: SparkSession, path: str, name: str, version: str) -> None:
    """Takes a version out of the list, then removes its files (of overwritten saves too)."""
    data, kind = find_version(spark, path, name, version)
    _append(spark, path, name, version, data, kind, True)
    _remove(spark, f"{path.rstrip('/')}/{name}/{version}")


def remove_overwritten(spark: SparkSession, path: str, name: str) -> int:
    """Removes the files of saves that a later save of the same version replaced; call it when no reader that started
    before that save is left.  Returns their number."""
    live = list_versions(spark, path, name).select("data")
    old = _manifest(spark, path, name).filter("NOT deleted").select("data").distinct().join(live, "data", "left_anti")
    folders = [r["data"] for r in old.collect()]   # one short row per save
    for f in folders:
        _remove(spark, f)
    return len(folders)
