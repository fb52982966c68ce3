"""Queries for sources, schema, validation and missing values (A, B, C, M)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabfid.operators import missing as mis
from tabfid.operators import schema as sch
from tabfid.operators import validate as val
from tabfid.operators.pair import stats_long
from tabfid.plans.catalog import register
from tabfid.plans.fixtures import ROW_KEYS, lineitem_with_nulls, table
from tabfid.plans.sqltext import LINEITEM_TYPES, NULLS_CTE, union_rows
from tabfid.session import ensure_checkpoint_dir
from tabfid.sources import io

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]
KEYS = ", ".join(ROW_KEYS)


@register("a1_csv_roundtrip", "SELECT * FROM lineitem")
def q_a1(spark, sf_dir):
    """A1/A3/A4: write lineitem as CSV with header to the shared folder, read it back
    through the suffix-dispatching loader with the table's schema."""
    src = table(spark, sf_dir, "lineitem")
    path = f"{ensure_checkpoint_dir(spark)}/a1-{uuid.uuid4().hex}.csv"
    io.write_table(src, path, fmt="csv")
    return io.load_table(spark, path, schema=src.schema)


@register("a1_csv_inferred", "SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment, "
          "'int,string,int,double,string' AS types FROM (SELECT CAST(c_custkey AS INTEGER) AS c_custkey, "
          "* EXCLUDE (c_custkey) FROM customer) AS c")
def q_a1i(spark, sf_dir):
    """A1: customer as CSV, read back with inferred types."""
    path = f"{ensure_checkpoint_dir(spark)}/a1i-{uuid.uuid4().hex}.csv"
    io.write_table(table(spark, sf_dir, "customer"), path, fmt="csv")
    d = io.load_table(spark, path)
    return d.withColumn("types", F.lit(",".join(t for _, t in d.dtypes)))


@register("a2_read_parquet", "SELECT * FROM orders")
def q_a2(spark, sf_dir):
    """A2/A3: Parquet reader chosen by suffix."""
    return io.load_table(spark, f"{sf_dir}/orders.parquet")


@register("a5_preview", f"SELECT * FROM lineitem ORDER BY {KEYS} LIMIT 10")
def q_a5(spark, sf_dir):
    """A5: first 10 rows by the row key (top-k is the feature)."""
    return io.preview(table(spark, sf_dir, "lineitem"), 10, ROW_KEYS)


A6_SQL = f"WITH {NULLS_CTE}\n" + union_rows([
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) AS rows FROM li_nulls"
    for c, t in LINEITEM_TYPES])


@register("a6_table_info", A6_SQL)
def q_a6(spark, sf_dir):
    """Columns, types, non-null counts of lineitem with holes."""
    return io.table_info(lineitem_with_nulls(spark, sf_dir))


A7_SQL = union_rows([
    f"SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in LI_NUM])


@register("a7_describe", A7_SQL, doubles=["mean", "std", "min", "p25", "p50", "p75", "max"])
def q_a7(spark, sf_dir):
    """describe() of lineitem numerics (exact linear-interpolated quartiles)."""
    return io.describe(table(spark, sf_dir, "lineitem"), LI_NUM)


def _narrow_sql_row(c: str, t: str) -> str:
    if t in ("bigint", "int"):
        lo, hi = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)"
        width = 8 if t == "bigint" else 4
        # the narrowest signed type that holds both ends, unless the column is that narrow already
        fits = " ".join(f"WHEN min({c}) >= {-2 ** (8 * w - 1)} AND max({c}) < {2 ** (8 * w - 1)} THEN '{n}'"
                        for n, w in (("tinyint", 1), ("smallint", 2), ("int", 4)) if w < width)
        to = f"CASE {fits} ELSE '{t}' END"
        ref = (f"CASE WHEN min({c}) >= 0 AND max({c}) < 256 THEN 'uint8' "
               f"WHEN min({c}) >= 0 AND max({c}) < 65536 THEN 'uint16' "
               f"WHEN min({c}) >= 0 AND max({c}) < 4294967296 THEN 'uint32' "
               f"WHEN min({c}) < 0 AND min({c}) > -128 AND max({c}) < 128 THEN 'int8' "
               f"WHEN min({c}) < 0 AND min({c}) > -32768 AND max({c}) < 32768 THEN 'int16' "
               f"WHEN min({c}) < 0 AND min({c}) > -2147483648 AND max({c}) < 2147483648 THEN 'int32' "
               f"ELSE '{t}' END")
        after = (f"count(*) * CASE {to} WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 "
                 f"WHEN 'int' THEN 4 ELSE 8 END")
        return (f"SELECT '{c}' AS column_name, {lo} AS min, {hi} AS max, '{t}' AS from_type, {to} AS to_type, "
                f"{ref} AS ref_type, CAST(count(*) * {width} AS BIGINT) AS bytes_before, "
                f"CAST({after} AS BIGINT) AS bytes_after FROM lineitem")
    if t == "double":
        return (f"SELECT '{c}' AS column_name, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
                f"'double' AS from_type, 'float' AS to_type, 'float32' AS ref_type, "
                f"CAST(count(*) * 8 AS BIGINT) AS bytes_before, CAST(count(*) * 4 AS BIGINT) AS bytes_after "
                f"FROM lineitem")
    if t == "string":
        return (f"SELECT '{c}' AS column_name, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
                f"'string' AS from_type, 'string' AS to_type, 'string' AS ref_type, "
                f"CAST(coalesce(sum(octet_length(CAST({c} AS BLOB))), 0) AS BIGINT) AS bytes_before, "
                f"CAST(coalesce(sum(octet_length(CAST({c} AS BLOB))), 0) AS BIGINT) AS bytes_after FROM lineitem")
    return (f"SELECT '{c}' AS column_name, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
            f"'{t}' AS from_type, '{t}' AS to_type, '{t}' AS ref_type, "
            f"CAST(count(*) * 8 AS BIGINT) AS bytes_before, CAST(count(*) * 8 AS BIGINT) AS bytes_after "
            f"FROM lineitem")


B3_SQL = union_rows([_narrow_sql_row(c, t) for c, t in LINEITEM_TYPES])


@register("b3_narrow_types", B3_SQL, doubles=["min", "max"])
def q_b3(spark, sf_dir):
    """Chosen narrow type per lineitem column from one min/max aggregate."""
    return sch.narrow_plan(table(spark, sf_dir, "lineitem"))


B3C_SQL = ("SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, "
           "round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 3) AS l_extendedprice, l_returnflag, "
           "(SELECT max(l_linenumber) < 128 FROM lineitem) AS narrowed FROM lineitem")


@register("b3_narrowed_table", B3C_SQL)
def q_b3c(spark, sf_dir):
    """The cast itself - values survive, and the line number's type is the narrowest that holds it."""
    d = sch.narrow_types(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"))
    return d.select(F.col("l_orderkey").cast("double"), F.col("l_linenumber").cast("double"),
                    F.round(F.col("l_extendedprice").cast("double"), 3).alias("l_extendedprice"), "l_returnflag",
                    F.lit(d.schema["l_linenumber"].dataType.simpleString() == "tinyint").alias("narrowed"))


def _column_counts(df):
    """(column_name, n_values, n_distinct) of every column, one aggregate over the table."""
    row = df.agg(*[x for c in df.columns for x in (F.count(c).alias(f"{c}__n"), F.count_distinct(c).alias(f"{c}__d"))])
    return stats_long(row, df.columns, {"n_values": "n", "n_distinct": "d"})


def _counts_sql(tab: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM {tab}" for c in cols)


LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
B1_SQL = ("SELECT column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'Continuous' "
          "WHEN data_type LIKE 'TIMESTAMP%' THEN 'Datetime' ELSE 'Categorical' END AS semantic_type "
          "FROM information_schema.columns WHERE table_name = 'lineitem'")


@register("b1_infer_types", f"SELECT * FROM ({B1_SQL}) AS t JOIN ({_counts_sql('lineitem', LINE_COLS)}) AS n USING (column_name)")
def q_b1(spark, sf_dir):
    """B1: semantic type of each lineitem column, with its values and distinct values."""
    li = table(spark, sf_dir, "lineitem")
    return sch.types_frame(spark, sch.infer_types(li)).join(_column_counts(li), "column_name")


B2_SQL = (f"SELECT column_name, CASE column_name WHEN 'l_linenumber' THEN 'Ordinal' "
          f"WHEN 'l_suppkey' THEN 'Categorical' ELSE semantic_type END AS semantic_type FROM ({B1_SQL}) AS t")


@register("b2_override_types", f"SELECT semantic_type, count(*) AS n_columns, CAST(sum(n_values) AS BIGINT) AS n_values, max(n_distinct) AS most_distinct "
          f"FROM ({B2_SQL}) AS t JOIN ({_counts_sql('lineitem', LINE_COLS)}) AS n USING (column_name) GROUP BY semantic_type")
def q_b2(spark, sf_dir):
    """B2: columns, values and most distinct values by semantic type, with two user choices on top of the inferred ones."""
    li = table(spark, sf_dir, "lineitem")
    types = sch.apply_overrides(sch.infer_types(li), {"l_linenumber": "Ordinal", "l_suppkey": "Categorical"})
    j = sch.types_frame(spark, types).join(_column_counts(li), "column_name")
    return j.groupBy("semantic_type").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_values").alias("n_values"),
                                          F.max("n_distinct").alias("most_distinct"))


@register("b7_prefix_groups", "SELECT split_part(column_name, '_', 1) AS prefix, column_name, n_values, n_distinct "
          f"FROM ({_counts_sql('orders', ORDER_COLS)}) AS n")
def q_b7(spark, sf_dir):
    """Columns of orders under the text before their first underscore, with their values and distinct values."""
    orders = table(spark, sf_dir, "orders")
    groups = spark.createDataFrame(sch.group_by_prefix(orders.columns), "prefix string, column_name string")
    return groups.join(_column_counts(orders), "column_name")


B4_SQL = (f"SELECT CAST(sum(bytes_before) AS BIGINT) AS bytes_before, CAST(sum(bytes_after) AS BIGINT) "
          f"AS bytes_after, (1 - sum(bytes_after) / sum(bytes_before)) * 100 AS reduction_pct "
          f"FROM ({B3_SQL}) AS p")


@register("b4_memory_reduction", B4_SQL, doubles=["reduction_pct"])
def q_b4(spark, sf_dir):
    """Bytes before/after narrowing and % reduction for lineitem."""
    return sch.memory_summary(sch.narrow_plan(table(spark, sf_dir, "lineitem")))


B56_SQL = ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
           "l_discount, l_returnflag, l_linestatus, CAST(NULL AS DOUBLE) AS l_tax, "
           "CAST(NULL AS TIMESTAMP) AS l_shipdate FROM lineitem")


@register("b5_b6_select_restore", B56_SQL)
def q_b56(spark, sf_dir):
    """Exclude l_tax and l_shipdate, then put them back as typed nulls."""
    li = table(spark, sf_dir, "lineitem")
    kept = sch.select_columns(li, exclude=["l_tax", "l_shipdate"])
    return sch.restore_columns(kept, li.schema)


def _validate_sql(src: str, cols: list[tuple[str, str]]) -> str:
    nulls = union_rows([
        f"SELECT 'missing_values' AS check, '{c}' AS column_name, "
        f"(1 - count({c}) / count(*)) * 100 AS value FROM {src}" for c, _ in cols])
    const = union_rows([
        f"SELECT 'constant_column' AS check, '{c}' AS column_name, CAST(NULL AS DOUBLE) AS value "
        f"FROM {src} HAVING count(DISTINCT {c}) = 1" for c, _ in cols])
    card = union_rows([
        f"SELECT 'high_cardinality' AS check, '{c}' AS column_name, "
        f"count(DISTINCT {c}) / count(*) AS value FROM {src}" for c, t in cols if t == "string"])
    return (f"SELECT * FROM ({nulls}) AS a WHERE value > 0\nUNION ALL\n{const}\nUNION ALL\n"
            f"SELECT * FROM ({card}) AS b WHERE value > 0.5")


C13_SQL = f"WITH {NULLS_CTE}\n" + _validate_sql("li_nulls", LINEITEM_TYPES)


@register("c1_c3_validate_lineitem", C13_SQL, doubles=["value"])
def q_c13(spark, sf_dir):
    """Null %, constant and high-cardinality checks on lineitem with holes."""
    return val.validate_data(lineitem_with_nulls(spark, sf_dir))


CUSTOMER_TYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                  ("c_acctbal", "double"), ("c_mktsegment", "string")]


@register("c3_validate_customer", _validate_sql("customer", CUSTOMER_TYPES), doubles=["value"])
def q_c3(spark, sf_dir):
    """C1-C3 on customer (c_name is high-cardinality)."""
    return val.validate_data(table(spark, sf_dir, "customer"))


C4_TYPES = {"l_quantity": "Continuous", "l_returnflag": "Continuous", "l_shipdate": "Datetime",
            "l_linestatus": "Datetime", "l_comment": "Categorical"}
C4_SQL = ("SELECT 'not_numeric' AS check, 'l_returnflag' AS column_name, CAST(NULL AS DOUBLE) AS value\n"
          "UNION ALL SELECT 'not_datetime', 'l_linestatus', CAST(count(*) AS DOUBLE) FROM lineitem "
          "WHERE l_linestatus IS NOT NULL AND TRY_CAST(l_linestatus AS TIMESTAMP) IS NULL "
          "HAVING count(*) > 0\n"
          "UNION ALL SELECT 'column_not_found', 'l_comment', CAST(NULL AS DOUBLE)")


@register("c4_check_types", C4_SQL, doubles=["value"])
def q_c4(spark, sf_dir):
    """C4: declared semantic types checked against lineitem (every value must parse)."""
    return val.check_column_types(table(spark, sf_dir, "lineitem"), C4_TYPES)


C5_SQL = (f"WITH {NULLS_CTE}, issues AS ({_validate_sql('li_nulls', LINEITEM_TYPES)}\nUNION ALL\n"
          f"{C4_SQL.replace('FROM lineitem', 'FROM li_nulls')})\n"
          "SELECT count(*) AS n_issues, count(*) = 0 AS valid FROM issues")


@register("c5_verdict", C5_SQL)
def q_c5(spark, sf_dir):
    """Overall verdict (issue count, valid flag) for lineitem with holes."""
    df = lineitem_with_nulls(spark, sf_dir)
    return val.verdict(val.validation_report(df, C4_TYPES))


M1_SQL = f"WITH {NULLS_CTE}\nSELECT * FROM li_nulls WHERE COLUMNS(*) IS NOT NULL"


@register("m1_drop_missing", M1_SQL)
def q_m1(spark, sf_dir):
    """M1: the rows without any null."""
    return mis.drop_missing(lineitem_with_nulls(spark, sf_dir))[0]


M1R_SQL = (f"WITH {NULLS_CTE}\nSELECT count(*) AS rows_before, "
           f"count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL) AS rows_after, "
           f"count(*) - count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL) "
           f"AS rows_dropped FROM li_nulls")


@register("m1_drop_report", M1R_SQL)
def q_m1r(spark, sf_dir):
    """M1: rows before and after dropping rows with any null."""
    return mis.drop_missing(lineitem_with_nulls(spark, sf_dir))[1]


M2_SQL = (f"WITH {NULLS_CTE}\nSELECT {KEYS}, coalesce(l_quantity, avg(l_quantity) OVER ()) AS l_quantity, "
          f"CAST(l_quantity IS NULL AS INTEGER) AS l_quantity_missing FROM li_nulls")


@register("m2_m4_mean_impute", M2_SQL, doubles=["l_quantity"])
def q_m2(spark, sf_dir):
    """M2 + M4: mean imputation of l_quantity with its missing flag."""
    df = lineitem_with_nulls(spark, sf_dir).select(*ROW_KEYS, "l_quantity")
    return mis.impute(df, mis.fit_mean_imputer(df, ["l_quantity"]))


M3_SQL = (f"WITH {NULLS_CTE}, m AS (SELECT l_returnflag AS v FROM li_nulls WHERE l_returnflag IS NOT NULL "
          f"GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)\n"
          f"SELECT {KEYS}, coalesce(l_returnflag, (SELECT v FROM m)) AS l_returnflag, "
          f"CAST(l_returnflag IS NULL AS INTEGER) AS l_returnflag_missing FROM li_nulls")


@register("m3_m4_mode_impute", M3_SQL)
def q_m3(spark, sf_dir):
    """M3 + M4: most-frequent imputation of l_returnflag (ties -> smallest)."""
    df = lineitem_with_nulls(spark, sf_dir).select(*ROW_KEYS, "l_returnflag")
    return mis.impute(df, mis.fit_mode_imputer(df, ["l_returnflag"]))


M5_SQL = (f"WITH {NULLS_CTE}\nSELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, "
          f"CAST(l_linenumber AS DOUBLE) AS l_linenumber, coalesce(l_quantity, 0.0) AS l_quantity, "
          f"coalesce(l_returnflag, '0') AS l_returnflag FROM li_nulls")


@register("m5_zero_fill", M5_SQL)
def q_m5(spark, sf_dir):
    """M5: zero-fill (numbers -> 0.0 as double, strings -> '0')."""
    df = lineitem_with_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity",
                                                   "l_returnflag")
    return mis.zero_fill(df)


M6_SQL = ("SELECT coalesce(TRY_CAST(c_custkey AS DOUBLE), 0.0) AS c_custkey, "
          "coalesce(TRY_CAST(c_acctbal AS DOUBLE), 0.0) AS c_acctbal, "
          "coalesce(TRY_CAST(c_mktsegment AS DOUBLE), 0.0) AS c_mktsegment, "
          "coalesce(TRY_CAST(split_part(c_name, '#', 2) AS DOUBLE), 0.0) AS name_number FROM customer")


@register("m6_coerce_numeric", M6_SQL, doubles=["c_acctbal"])
def q_m6(spark, sf_dir):
    """M6: coerce columns to numbers, failures -> 0."""
    cu = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment",
        F.split("c_name", "#").getItem(1).alias("name_number"))
    return mis.coerce_numeric(cu)
