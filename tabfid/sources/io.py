"""Read, write, preview and summarise tables (ops A1-A7)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.functions.exprs import is_numeric, nan_to_null
from tabfid.operators.pair import stats_long

# fixed: suffixes the loader accepts
SUPPORTED = (".csv", ".parquet")


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        f = fmt.lower().lstrip(".")
    else:
        base = path.rstrip("/")
        f = os.path.splitext(base)[1].lower().lstrip(".")
    if f not in {s.lstrip(".") for s in SUPPORTED}:
        raise ValueError(f"unsupported file type {f!r} for {path}; supported: {', '.join(SUPPORTED)}")
    return f


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None) -> DataFrame:
    """A1-A3: read CSV (header, inferred types unless a schema is given) or Parquet,
    choosing the reader by suffix.  Files are split into tasks by Spark itself."""
    f = _format_of(path, fmt)
    if f == "csv":
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(path)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """A4: write with a header row (CSV) or as Parquet; executors write in parallel."""
    f = _format_of(path, fmt)
    w = df.write.mode(mode)
    if f == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """A5: first n rows by an explicit key (Spark tables have no row order)."""
    keys = order_by or df.columns
    return df.orderBy(*keys).limit(n)


def table_info(df: DataFrame) -> DataFrame:
    """Column, type, non-null count and row count in one aggregate."""
    cols = df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(nan_to_null(c) if isinstance(fields[c], (T.FloatType, T.DoubleType))
                           else F.col(c)).alias(f"{c}__nn") for c in cols])
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.lit(fields[c].simpleString()).alias("data_type"),
                        F.col(f"{c}__nn").alias("non_null"),
                        F.col("__rows").alias("rows")) for c in cols]
    return row.select(F.inline(F.array(*structs)))


MAP_PERCENTILE_ROWS = 1_000_000   # all columns' maps lie in one task


def describe(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
             accuracy: int = 10_000, map_limit: int = MAP_PERCENTILE_ROWS) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75 % (linear interpolation), max.

    Quartiles are exact at any size: up to ``map_limit`` rows Spark's ``percentile``
    (a value -> count map per column in one buffer), beyond that read off the bucketed
    CDF table (``exact_quantiles``), which never holds a column in one task.
    ``approx=True`` uses ``percentile_approx`` instead (one pass).
    """
    from tabfid.operators.pair import exact_quantiles
    cols = cols or [f.name for f in df.schema.fields
                    if is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)]
    in_map = not approx and df.count() <= map_limit
    aggs = []
    for c in cols:
        v = nan_to_null(F.col(c).cast("double"))
        aggs += [F.count(v).alias(f"{c}__count"), F.avg(v).alias(f"{c}__mean"),
                 F.stddev_samp(v).alias(f"{c}__std"), F.min(v).alias(f"{c}__min"),
                 F.max(v).alias(f"{c}__max")]
        if approx:
            aggs.append(F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias(f"{c}__q"))
        elif in_map:
            aggs.append(F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}__q"))
    row = df.agg(*aggs)
    names = ["count", "mean", "std", "min", "max"]
    with_q = approx or in_map
    base = stats_long(row, cols, {n: n for n in names} | ({"q": "q"} if with_q else {}))
    if with_q:
        q = base.select("column_name", *[F.col("q")[i].cast("double").alias(n)
                                         for i, n in enumerate(("p25", "p50", "p75"))])
        base = base.drop("q")
    else:
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).select(
            "column_name", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    # both sides have one row per column
    j = base.join(q, "column_name", "left")
    return j.select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
