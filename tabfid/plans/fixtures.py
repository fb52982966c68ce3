"""Inputs derived from the driver's test tables.

These builders only shape rows into the schema an operator expects; all of the
operators' work runs on the result through the library code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfid.operators.pair import TablePair

# fixed column sets of the lineitem pair
ROW_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PAIR_NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIR_CATEGORICAL = ["l_returnflag", "l_linestatus"]
COPY_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_halves(spark: SparkSession, sf_dir: str, changed: bool = True,
                    columns: list[str] | None = None, far: bool = False) -> tuple[DataFrame, DataFrame]:
    """Real = even ``l_orderkey``; synthetic = odd half, optionally perturbed
    (``l_quantity + l_partkey % 3``, ``l_extendedprice * 1.05``).  ``far``: every 29th part
    has a sentinel price far below all others, and small discounts are 0."""
    li = table(spark, sf_dir, "lineitem")
    if far:
        li = li.withColumns({
            "l_extendedprice": F.when(F.col("l_partkey") % 29 == 0, F.lit(-999999999.0)).otherwise(F.col("l_extendedprice")),
            "l_discount": F.when(F.col("l_discount") > 0.08, F.col("l_discount")).otherwise(F.lit(0.0))})
    real = li.filter(F.col("l_orderkey") % 2 == 0)
    syn = li.filter(F.col("l_orderkey") % 2 == 1)
    if changed:
        syn = syn.withColumns({
            "l_quantity": F.col("l_quantity") + F.col("l_partkey") % 3,
            "l_extendedprice": F.col("l_extendedprice") * F.lit(1.05),
        })
    if columns:
        real, syn = real.select(*columns), syn.select(*columns)
    return real, syn


def lineitem_pair(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
                  changed: bool = True, far: bool = False) -> TablePair:
    cols = columns or (PAIR_NUMERIC + PAIR_CATEGORICAL)
    real, syn = lineitem_halves(spark, sf_dir, changed=changed, columns=cols, far=far)
    return TablePair(real, syn, columns=cols)


def lineitem_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem where rows with ``l_partkey % 17 = 0`` have null quantity and flag."""
    li = table(spark, sf_dir, "lineitem")
    hole = F.col("l_partkey") % 17 == 0
    return li.withColumns({
        "l_quantity": F.when(~hole, F.col("l_quantity")),
        "l_returnflag": F.when(~hole, F.col("l_returnflag")),
    })


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a training log: run_id = user_id, epoch = day of ``ts`` counted from
    2024-01-01, batch = event_id, metric = event_type, value = value."""
    ev = table(spark, sf_dir, "events")
    base = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return ev.select(
        F.col("user_id").alias("run_id"),
        F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - base) / 86400).cast("long").alias("epoch"),
        F.col("event_id").alias("batch"),
        F.col("event_type").alias("metric"),
        F.col("value"))
