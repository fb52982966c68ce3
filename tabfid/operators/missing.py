"""Missing values (ops M1-M6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.functions.exprs import zero_fill_col


def _nanless(df: DataFrame) -> DataFrame:
    """NaN -> null in float columns (pandas has one missing marker)."""
    ex = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields
          if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(ex) if ex else df


def drop_missing(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1: drop rows with any null; report (rows_before, rows_after, rows_dropped) in
    one aggregate."""
    clean = _nanless(df)
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    report = clean.agg(F.count(F.lit(1)).alias("rows_before"),
                       F.count_if(~any_null).alias("rows_after")).withColumn(
        "rows_dropped", F.col("rows_before") - F.col("rows_after"))
    return clean.na.drop(), report


def fit_mean_imputer(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """M2 fit: means of all columns in one aggregate (NaN counts as missing)."""
    row = _nanless(df.select(*cols)).agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def fit_mode_imputer(df: DataFrame, cols: list[str]) -> dict:
    """M3 fit: most frequent non-null value; ties -> smallest value."""
    # one job: values of all columns are counted together (combined before the shuffle), each in a field of its own
    # type, and one row per column comes back
    at = {c: i for i, c in enumerate(cols)}
    if not at:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("column"), *[
        (F.col(c) if c == own else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{j}") for c, j in at.items()])
        for own, i in at.items()])).alias("e")).select("e.*")
    values = [f"v{i}" for i in at.values()]
    seen = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    counts = long.where(seen).groupBy("column", *values).count()
    top = counts.groupBy("column").agg(*[F.min(F.when(F.col("column") == i, F.struct((-F.col("count")).alias("n"), F.col(v).alias("v")))
                                               ).alias(v) for i, v in enumerate(values)]).collect()
    best = {r["column"]: r[f"v{r['column']}"]["v"] for r in top}
    return {c: best.get(i) for c, i in at.items()}


def impute(df: DataFrame, fills: dict, flags: bool = True) -> DataFrame:
    """M2/M3 apply + M4 flags: ``<c>_missing`` (0/1) and the filled value."""
    d = _nanless(df)
    ex = {}
    for c, v in fills.items():
        if flags:
            ex[f"{c}_missing"] = F.col(c).isNull().cast("int")
        ex[c] = F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) if v is not None else F.col(c)
    return d.withColumns(ex)


def zero_fill(df: DataFrame) -> DataFrame:
    """M5: null/NaN -> 0.0 in numeric columns (cast to double), '0' in strings."""
    return df.select(*[zero_fill_col(f.name, f.dataType) for f in df.schema.fields])


def coerce_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """M6: coerce to double (failures -> null), then zero-fill."""
    cols = cols or df.columns
    out = df.withColumns({c: F.col(c).try_cast("double") for c in cols})
    return out.select(*[zero_fill_col(f.name, f.dataType) if f.name in cols else F.col(f.name)
                        for f in out.schema.fields])
