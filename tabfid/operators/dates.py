"""Datetime expansion and rebuild (ops D1-D2); pure projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("year", "month", "day", "dayofweek")


def expand_datetime(df: DataFrame, col: str, drop: bool = True) -> DataFrame:
    """``<c>_year, _month, _day, _dayofweek`` (Monday = 0)."""
    ts = F.col(col)
    if dict(df.dtypes)[col] == "string":
        ts = F.try_to_timestamp(ts)
    out = df.withColumns({
        f"{col}_year": F.year(ts).cast("long"),
        f"{col}_month": F.month(ts).cast("long"),
        f"{col}_day": F.dayofmonth(ts).cast("long"),
        f"{col}_dayofweek": F.weekday(ts).cast("long"),
    })
    return out.drop(col) if drop else out


def rebuild_datetime(df: DataFrame, col: str, drop_parts: bool = True) -> DataFrame:
    """Date from rounded year, month, day; impossible dates (30 February) -> null;
    day-of-week is ignored."""
    y, m, d = (F.rint(F.col(f"{col}_{p}")).cast("int") for p in ("year", "month", "day"))
    out = df.withColumn(col, F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0)))
    if drop_parts:
        out = out.drop(*[f"{col}_{p}" for p in PARTS if f"{col}_{p}" in df.columns])
    return out
