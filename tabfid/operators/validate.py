"""Validation: each check returns a table of issues (ops C1-C5).

Issue rows: (check, column_name, value).  ``value`` is the null percentage (C1), the
distinct share (C3), the count of unparseable values (C4) or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.functions.exprs import DATETIME_TYPES, is_numeric

ISSUE_SCHEMA = "check string, column_name string, value double"
# fixed thresholds of the reference
HIGH_CARDINALITY_SHARE = 0.5
# band around the threshold where the HLL estimate is confirmed by an exact count
_APPROX_BAND = 0.1


def _value(c: str, dt: T.DataType):
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    return col


def validate_data(df: DataFrame, exact_distinct: bool | None = None) -> DataFrame:
    """C1-C3 in one pass: null %, constant columns, high-cardinality string columns.

    C2 uses ``min = max`` over non-null values (= exactly one distinct value).  C3
    estimates distinct counts with HLL in the same pass; only columns that may pass the
    0.5 threshold get an exact ``count(distinct)`` (so reported shares are exact).
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = list(fields)
    strings = [c for c in cols if isinstance(fields[c], T.StringType)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        v = _value(c, fields[c])
        aggs += [F.count(v).alias(f"{c}__nn"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    for c in strings:
        aggs.append(F.approx_count_distinct(c).alias(f"{c}__ad"))   # rsd 5 %: exact count confirms
    row = df.agg(*aggs).first()
    rows = row["__rows"]
    spark = df.sparkSession
    issues = []
    for c in cols:
        nn = row[f"{c}__nn"]
        null_pct = (1 - nn / rows) * 100 if rows else 0.0
        if null_pct > 0:
            issues.append(("missing_values", c, float(null_pct)))
    for c in cols:
        if row[f"{c}__nn"] and row[f"{c}__min"] == row[f"{c}__max"]:
            issues.append(("constant_column", c, None))
    if strings and rows:
        near = [c for c in strings
                if exact_distinct or row[f"{c}__ad"] / rows > HIGH_CARDINALITY_SHARE - _APPROX_BAND]
        exact = {}
        if near:
            er = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first()
            exact = {c: er[c] for c in near}
        for c in strings:
            share = exact.get(c, row[f"{c}__ad"]) / rows
            if share > HIGH_CARDINALITY_SHARE:
                issues.append(("high_cardinality", c, float(share)))
    return spark.createDataFrame(issues, ISSUE_SCHEMA)


def check_column_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """C4: missing column; Continuous must be numeric; Datetime must parse for every
    non-null value (one aggregate over all string columns marked Datetime)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    issues = []
    to_parse = []
    for c, t in types.items():
        if c not in fields:
            issues.append(("column_not_found", c, None))
        elif t == "Continuous" and not is_numeric(fields[c]):
            issues.append(("not_numeric", c, None))
        elif t == "Datetime" and not isinstance(fields[c], DATETIME_TYPES):
            to_parse.append(c)
    if to_parse:
        row = df.agg(*[F.count_if(F.col(c).isNotNull() &
                                  F.try_to_timestamp(F.col(c).cast("string")).isNull()).alias(c)
                       for c in to_parse]).first()
        for c in to_parse:
            if row[c] > 0:
                issues.append(("not_datetime", c, float(row[c])))
    return df.sparkSession.createDataFrame(issues, ISSUE_SCHEMA)


def verdict(issues: DataFrame) -> DataFrame:
    """valid = no issues."""
    return issues.agg(F.count(F.lit(1)).alias("n_issues")).withColumn(
        "valid", F.col("n_issues") == 0)


def validation_report(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """C1-C4 issues of one table."""
    out = validate_data(df)
    if types:
        out = out.unionByName(check_column_types(df, types))
    return out

