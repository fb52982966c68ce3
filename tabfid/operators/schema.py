"""Typing and projection (ops B1-B7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.functions.exprs import DATETIME_TYPES, INTEGRAL_TYPES, is_numeric

# fixed semantic type names
CONTINUOUS, CATEGORICAL, DATETIME, ORDINAL = "Continuous", "Categorical", "Datetime", "Ordinal"
SEMANTIC_TYPES = (CONTINUOUS, CATEGORICAL, DATETIME, ORDINAL)


def infer_types(df: DataFrame) -> dict[str, str]:
    """B1: numeric (incl. boolean) -> Continuous, date/timestamp -> Datetime, else Categorical."""
    out = {}
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            out[f.name] = CONTINUOUS
        elif isinstance(f.dataType, DATETIME_TYPES):
            out[f.name] = DATETIME
        else:
            out[f.name] = CATEGORICAL
    return out


def types_frame(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    """B1/B2 as a DataFrame (column_name, semantic_type)."""
    return spark.createDataFrame(list(types.items()), "column_name string, semantic_type string")


def apply_overrides(types: dict[str, str], overrides: dict[str, str] | None) -> dict[str, str]:
    """B2: user choice of semantic type (incl. Ordinal), validated."""
    out = dict(types)
    for c, t in (overrides or {}).items():
        if t not in SEMANTIC_TYPES:
            raise ValueError(f"unknown semantic type {t!r} for {c}; use one of {SEMANTIC_TYPES}")
        if c not in out:
            raise ValueError(f"column {c!r} not in table")
        out[c] = t
    return out


# Spark's integer types with the bound of each
_SIGNED = [(2 ** 7, "tinyint"), (2 ** 15, "smallint"), (2 ** 31, "int")]
# fixed names: the unsigned types of the reference and the bound of each
_UNSIGNED = [(2 ** 8, "uint8"), (2 ** 16, "uint16"), (2 ** 32, "uint32")]
_NAMES = {"tinyint": "int8", "smallint": "int16", "int": "int32"}
_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def narrow_plan(df: DataFrame, narrow_floats: bool = True) -> DataFrame:
    """B3/B4 report: one aggregate (min, max, rows, string bytes) -> chosen type per column.

    Columns: column_name, min, max, from_type, to_type, ref_type, bytes_before, bytes_after.
    Integers take the smallest of Spark's types that holds all values, never a wider one than
    they have; ``ref_type`` names the reference's choice, which is unsigned for columns without
    negative values.  Doubles -> float when ``narrow_floats``.
    """
    fields = [f for f in df.schema.fields]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for f in fields:
        if isinstance(f.dataType, INTEGRAL_TYPES):
            aggs += [F.min(f.name).cast("double").alias(f"{f.name}__min"),
                     F.max(f.name).cast("double").alias(f"{f.name}__max")]
        elif isinstance(f.dataType, T.StringType):
            aggs.append(F.sum(F.octet_length(f.name)).alias(f"{f.name}__bytes"))
    row = df.agg(*aggs)
    structs = []
    for f in fields:
        name, dt = f.name, f.dataType
        src = dt.simpleString()
        if isinstance(dt, INTEGRAL_TYPES):
            lo, hi = F.col(f"{name}__min"), F.col(f"{name}__max")
            to_t, ref_t = F.lit(src), F.lit(src)
            for bound, spark_t in reversed(_SIGNED):
                if _WIDTH[spark_t] < _WIDTH[src]:
                    to_t = F.when((lo >= -bound) & (hi < bound), spark_t).otherwise(to_t)
                ref_t = F.when((lo < 0) & (lo > -bound) & (hi < bound), _NAMES[spark_t]).otherwise(ref_t)
            for bound, ref in reversed(_UNSIGNED):
                ref_t = F.when((lo >= 0) & (hi < bound), ref).otherwise(ref_t)
            before = F.col("__rows") * _WIDTH.get(src, 8)
            after = F.col("__rows") * F.when(to_t == "tinyint", 1).when(to_t == "smallint", 2)\
                .when(to_t == "int", 4).otherwise(8)
            mn, mx = lo, hi
        elif isinstance(dt, (T.DoubleType, T.FloatType)):
            to_t = F.lit("float" if narrow_floats else src)
            ref_t = F.lit("float32" if narrow_floats else src)
            before = F.col("__rows") * _WIDTH[src]
            after = F.col("__rows") * (4 if narrow_floats else _WIDTH[src])
            mn = mx = F.lit(None).cast("double")
        elif isinstance(dt, T.StringType):
            to_t, ref_t = F.lit(src), F.lit(src)
            before = after = F.coalesce(F.col(f"{name}__bytes"), F.lit(0))
            mn = mx = F.lit(None).cast("double")
        else:
            to_t, ref_t = F.lit(src), F.lit(src)
            before = after = F.col("__rows") * 8
            mn = mx = F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(name).alias("column_name"), mn.alias("min"), mx.alias("max"),
            F.lit(src).alias("from_type"), to_t.alias("to_type"), ref_t.alias("ref_type"),
            before.cast("long").alias("bytes_before"), after.cast("long").alias("bytes_after")))
    return row.select(F.inline(F.array(*structs)))


def memory_summary(plan: DataFrame) -> DataFrame:
    """Total bytes before/after and the percentage saved."""
    return plan.agg(F.sum("bytes_before").alias("bytes_before"),
                    F.sum("bytes_after").alias("bytes_after")).withColumn(
        "reduction_pct",
        (1 - F.col("bytes_after") / F.col("bytes_before")) * 100)


def narrow_types(df: DataFrame, narrow_floats: bool = True) -> DataFrame:
    """Cast each column to its chosen type (one aggregate, then one projection)."""
    plan = {r["column_name"]: r["to_type"] for r in narrow_plan(df, narrow_floats).collect()}
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if plan[c] != df.schema[c].dataType.simpleString()
                       else F.col(c) for c in df.columns])


def select_columns(df: DataFrame, include: list[str] | None = None,
                   exclude: list[str] | None = None) -> DataFrame:
    """include/exclude columns; unknown names are an error."""
    names = set(df.columns)
    unknown = [c for c in (include or []) + (exclude or []) if c not in names]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    keep = include or df.columns
    ex = set(exclude or [])
    return df.select(*[c for c in keep if c not in ex])


def restore_columns(df: DataFrame, original_schema: T.StructType) -> DataFrame:
    """Put excluded columns back as typed nulls; selected first, then excluded in
    original order."""
    have = set(df.columns)
    missing = [f for f in original_schema.fields if f.name not in have]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def group_by_prefix(columns: list[str]) -> list[tuple[str, str]]:
    """(group, column) where group is the text before the first '_' (else 'other')."""
    return [(c.split("_", 1)[0] if "_" in c else "other", c) for c in columns]
