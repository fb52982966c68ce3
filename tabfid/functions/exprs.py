"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that ``df`` does not have (in any case): each name or one with underscores
    before it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType) and not include_bool:
            continue
        if is_numeric(f.dataType):
            out.append(f.name)
    return out


def nan_to_null(c: Column | str) -> Column:
    """pandas treats NaN as missing; Spark does not.  Map NaN to null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def zero_fill_col(name: str, dt: T.DataType) -> Column:
    """Null (and NaN) -> 0 for numbers (as double), '0' for strings, others unchanged."""
    c = F.col(name)
    if is_numeric(dt):
        d = c.cast("double")
        return F.coalesce(F.nanvl(d, F.lit(0.0)), F.lit(0.0)).alias(name)
    if isinstance(dt, T.StringType):
        return F.coalesce(c, F.lit("0")).alias(name)
    return c.alias(name)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (ANSI mode would raise)."""
    return F.try_divide(a, F.when(b != 0, b))


def r6(c: Column, places: int = 6) -> Column:
    """Round for cross-engine comparison; '+ 0.0' turns -0.0 into 0.0."""
    return F.round(c.cast("double"), places) + F.lit(0.0)


def rsig(c: Column, digits: int = 12) -> Column:
    """Round to ``digits`` significant digits (same formula as the oracle text)."""
    c = c.cast("double")
    e = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))))
    return (F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), c)
            .when(c == 0, F.lit(0.0))
            .otherwise(F.round(c / e, digits - 1) * e + F.lit(0.0)))


