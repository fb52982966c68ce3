"""Queries for sampling, scaling, encoding and dates (H, X, E, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfid.functions.hashing import portable_hash_sql
from tabfid.operators import dates as dt
from tabfid.operators import encode as enc
from tabfid.operators import sampling as smp
from tabfid.operators import scale as sc
from tabfid.plans.catalog import register
from tabfid.plans.fixtures import ROW_KEYS, lineitem_halves, lineitem_with_nulls, table
from tabfid.plans.sqltext import NULLS_CTE, union_rows

KEYS = ", ".join(ROW_KEYS)
H = portable_hash_sql(ROW_KEYS)
TEST_CUT = int(0.2 * 2147483648)

# ---------------------------------------------------------------- H: sampling


@register("h1_train_test_split",
          f"SELECT {KEYS}, CASE WHEN {H} < {TEST_CUT} THEN 'test' ELSE 'train' END AS split FROM lineitem")
def q_h1(spark, sf_dir):
    """H1: repeatable 80/20 split of lineitem by the portable hash of the row key."""
    return smp.split_label(table(spark, sf_dir, "lineitem").select(*ROW_KEYS), ROW_KEYS, 0.2, 42)


@register("h2_sample_to_size",
          f"SELECT {KEYS} FROM lineitem WHERE l_orderkey % 2 = 0 "
          f"QUALIFY row_number() OVER (ORDER BY {H}, {KEYS}) <= "
          f"(SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 1)")
def q_h2(spark, sf_dir):
    """H2: exactly as many real rows as there are synthetic rows (hash order)."""
    real, syn = lineitem_halves(spark, sf_dir, columns=ROW_KEYS)
    return smp.match_size(real, syn.count(), ROW_KEYS, 42)


@register("h3_rows_to_generate",
          "SELECT count(*) AS n_rows, CAST(greatest(1, floor(0.25 * count(*))) AS BIGINT) AS default_rows, "
          "CAST(greatest(1, floor(count(*) * 0.1)) AS BIGINT) AS percent_rows, "
          "CAST(least(1000, count(*)) AS BIGINT) AS exact_rows FROM lineitem")
def q_h3(spark, sf_dir):
    """H3: rows to generate for the default, 10 % and exact-1000 choices."""
    n = table(spark, sf_dir, "lineitem").count()
    return spark.createDataFrame(
        [(n, smp.rows_to_generate(n), smp.rows_to_generate(n, "percent", 0.1), smp.rows_to_generate(n, "exact", 1000))],
        "n_rows long, default_rows long, percent_rows long, exact_rows long")


def _keys_of(spark, sf_dir):
    """customers under a text key and a key that is negative for all but a few"""
    return table(spark, sf_dir, "customer").select("c_name", (F.col("c_custkey") - 1_000_000_000).alias("low_key"))


@register("h1_split_text_key", f"SELECT c_name, CASE WHEN {portable_hash_sql(['c_name'])} < {TEST_CUT} "
          f"THEN 'test' ELSE 'train' END AS split FROM customer")
def q_h1_text(spark, sf_dir):
    """H1 on a text key."""
    return smp.split_label(_keys_of(spark, sf_dir).select("c_name"), ["c_name"], 0.2, 42)


@register("h1_split_negative_key",
          f"SELECT low_key, CASE WHEN {portable_hash_sql(['low_key'])} < {TEST_CUT} THEN 'test' ELSE 'train' END AS split "
          f"FROM (SELECT c_custkey - 1000000000 AS low_key FROM customer) AS c")
def q_h1_negative(spark, sf_dir):
    """H1 on negative keys."""
    return smp.split_label(_keys_of(spark, sf_dir).select("low_key"), ["low_key"], 0.2, 42)


@register("h2_sample_negative_key",
          f"SELECT low_key FROM (SELECT c_custkey - 1000000000 AS low_key FROM customer) AS c "
          f"QUALIFY row_number() OVER (ORDER BY {portable_hash_sql(['low_key'])}, low_key) <= 500")
def q_h2_negative(spark, sf_dir):
    """H2 on negative keys: exactly 500 rows."""
    return smp.sample_rows(_keys_of(spark, sf_dir).select("low_key"), ["low_key"], 500)


@register("h4_head_cap", f"SELECT * FROM lineitem ORDER BY {KEYS} LIMIT 20000")
def q_h4(spark, sf_dir):
    """H4: first 20,000 rows by row key (the cap is the feature)."""
    return smp.head_rows(table(spark, sf_dir, "lineitem"), ROW_KEYS, 20_000)


H5C = portable_hash_sql(["c_custkey", "replica"])
H5T = portable_hash_sql(["c_custkey"])


def _resize_sql(total: int) -> str:
    """trim by hash of the key when the table is large enough, else repeat each row
    ceil(total / n) times and cut by hash of (key, replica)"""
    return (f"WITH n AS (SELECT count(*) AS n FROM customer), x AS (\n"
            f"SELECT c_custkey, 0 AS replica, {H5T} AS h FROM customer WHERE (SELECT n FROM n) >= {total}\n"
            f"UNION ALL SELECT c_custkey, replica, {H5C} AS h FROM (SELECT c_custkey, CAST(r AS INTEGER) AS replica "
            f"FROM customer, range(0, CAST(ceil({total} / (SELECT n FROM n)) AS BIGINT)) AS t(r)) AS y "
            f"WHERE (SELECT n FROM n) < {total})\n"
            f"SELECT c_custkey, CAST(replica AS INTEGER) AS replica FROM x ORDER BY h, c_custkey, replica LIMIT {total}")


@register("h5_resize_fill", _resize_sql(4000))
def q_h5(spark, sf_dir):
    """H5: customer resized to exactly 4,000 rows (repeat + hash cut when smaller)."""
    return smp.resize(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 4000)


@register("h5_resize_trim", _resize_sql(1000))
def q_h5b(spark, sf_dir):
    """H5: customer resized to exactly 1,000 rows (hash sample when larger)."""
    return smp.resize(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 1000)


@register("h6_stratified_quota",
          f"WITH q(l_returnflag, quota) AS (VALUES ('A', 5000), ('N', 3000), ('R', 2000))\n"
          f"SELECT {KEYS}, l_returnflag FROM lineitem JOIN q USING (l_returnflag) "
          f"QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {H}, {KEYS}) <= quota")
def q_h6(spark, sf_dir):
    """H6: 10,000 rows with l_returnflag A:N:R = 5:3:2 (exact quotas by hash)."""
    li = table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_returnflag")
    return smp.stratified_sample(li, ROW_KEYS, "l_returnflag", {"A": 5, "N": 3, "R": 2}, 10_000)


# ---------------------------------------------------------------- X: scaling

X1_SQL = (f"WITH {NULLS_CTE}, f AS (SELECT {KEYS}, coalesce(l_quantity, avg(l_quantity) OVER ()) AS q, "
          f"CAST(l_extendedprice AS DOUBLE) AS p FROM li_nulls)\n"
          f"SELECT {KEYS}, (q - avg(q) OVER ()) / CASE WHEN stddev_pop(q) OVER () > 0 THEN stddev_pop(q) OVER () "
          f"ELSE 1 END AS l_quantity, (p - avg(p) OVER ()) / CASE WHEN stddev_pop(p) OVER () > 0 "
          f"THEN stddev_pop(p) OVER () ELSE 1 END AS l_extendedprice FROM f")


@register("x1_standard_scale", X1_SQL, doubles=["l_quantity", "l_extendedprice"])
def q_x1(spark, sf_dir):
    """X1 (+M2): mean-impute, then (x - mean) / population std."""
    df = lineitem_with_nulls(spark, sf_dir).select(*ROW_KEYS, "l_quantity", "l_extendedprice")
    st = sc.fit_scaler(df, ["l_quantity", "l_extendedprice"], "standard")
    return sc.apply_scaler(df, st)


X2_SQL = (f"SELECT {KEYS}, " + ", ".join(
    f"2 * ({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () > min({c}) OVER () "
    f"THEN max({c}) OVER () - min({c}) OVER () ELSE 1 END - 1 AS {c}" for c in ("l_extendedprice", "l_discount"))
    + " FROM lineitem")


@register("x2_minmax_scale", X2_SQL, doubles=["l_extendedprice", "l_discount"])
def q_x2(spark, sf_dir):
    """Min-max scaling to (-1, 1)."""
    df = table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_extendedprice", "l_discount")
    return sc.apply_scaler(df, sc.fit_scaler(df, ["l_extendedprice", "l_discount"], "minmax"))


X3_SQL = (f"WITH s AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i"
    for c in ("l_quantity", "l_extendedprice")) + " FROM lineitem)\n"
    f"SELECT {KEYS}, " + ", ".join(
        f"({c} - {c}_m) / CASE WHEN {c}_i > 0 THEN {c}_i ELSE 1 END AS {c}"
        for c in ("l_quantity", "l_extendedprice")) + " FROM lineitem, s")


@register("x3_robust_scale", X3_SQL, doubles=["l_quantity", "l_extendedprice"])
def q_x3(spark, sf_dir):
    """Robust scaling (x - median) / IQR with linear quantiles."""
    df = table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_quantity", "l_extendedprice")
    return sc.apply_scaler(df, sc.fit_scaler(df, ["l_quantity", "l_extendedprice"], "robust"))


X4_SQL = (f"WITH real AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), "
          f"syn AS (SELECT * REPLACE (l_extendedprice * 1.05 AS l_extendedprice) FROM lineitem WHERE l_orderkey % 2 = 1), "
          f"s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) - min(l_extendedprice) AS rg FROM real)\n"
          f"SELECT 'real' AS side, {KEYS}, (l_extendedprice - lo) / CASE WHEN rg > 0 THEN rg ELSE 1 END AS l_extendedprice "
          f"FROM real, s UNION ALL SELECT 'synthetic', {KEYS}, (l_extendedprice - lo) / CASE WHEN rg > 0 THEN rg ELSE 1 END "
          f"FROM syn, s")


@register("x4_minmax_fit_real", X4_SQL, doubles=["l_extendedprice"])
def q_x4(spark, sf_dir):
    """(0, 1) scaling fitted on real, applied to real and synthetic."""
    cols = [*ROW_KEYS, "l_extendedprice"]
    real, syn = lineitem_halves(spark, sf_dir, columns=cols)
    r, s = sc.minmax_on_real(real, syn, ["l_extendedprice"])
    return r.select(F.lit("real").alias("side"), *cols).unionByName(
        s.select(F.lit("synthetic").alias("side"), *cols))


@register("x5_inverse_roundtrip",
          f"SELECT {KEYS}, l_extendedprice FROM lineitem",
          doubles=["l_extendedprice"])
def q_x5(spark, sf_dir):
    """Standard scale then invert (unscale, clip, round integral types) = identity."""
    df = table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_extendedprice")
    st = sc.fit_scaler(df, ["l_linenumber", "l_extendedprice"], "standard")
    return sc.invert_scaler(sc.apply_scaler(df, st), st)


X6_SQL = (f"WITH {NULLS_CTE}, m AS (SELECT avg(l_quantity) AS mq FROM li_nulls)\n" + union_rows([
    f"SELECT '{c}' AS column_name, 'standard' AS method, avg(v) AS shift, "
    f"CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS scale, CAST(min(v) AS DOUBLE) AS lo, "
    f"CAST(max(v) AS DOUBLE) AS hi, {fill} AS fill, '{t}' AS dtype, {hm} AS has_missing, count(*) AS rows "
    f"FROM (SELECT {expr} AS v, mq FROM li_nulls, m) AS x"
    for c, t, expr, fill, hm in (
        ("l_quantity", "double", "coalesce(l_quantity, mq)", "max(mq)", "true"),
        ("l_extendedprice", "double", "l_extendedprice", "CAST(NULL AS DOUBLE)", "false"),
        ("l_linenumber", "int", "l_linenumber", "CAST(NULL AS DOUBLE)", "false"))]))


@register("x6_scaler_state", X6_SQL, doubles=["shift", "scale", "lo", "hi", "fill"])
def q_x6(spark, sf_dir):
    """Fitted scaler state (shift, scale, range, fill, dtype, has_missing) per column."""
    df = lineitem_with_nulls(spark, sf_dir)
    st = sc.fit_scaler(df, ["l_quantity", "l_extendedprice", "l_linenumber"], "standard")
    return sc.state_frame(spark, st)


# ---------------------------------------------------------------- E: encoding

E1_SQL = (f"WITH {NULLS_CTE}, m AS (SELECT l_returnflag AS v FROM li_nulls WHERE l_returnflag IS NOT NULL "
          f"GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), f AS (SELECT {KEYS}, "
          f"coalesce(l_returnflag, (SELECT v FROM m)) AS v FROM li_nulls)\n"
          f"SELECT {KEYS}, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS l_returnflag FROM f")


@register("e1_label_encode", E1_SQL)
def q_e1(spark, sf_dir):
    """E1 (+M3): most-frequent fill, then code = rank in sorted distinct values."""
    df = lineitem_with_nulls(spark, sf_dir).select(*ROW_KEYS, "l_returnflag")
    return enc.apply_encoder(df, enc.fit_label_encoder(df, "l_returnflag"))


@register("e1_label_encode_names",
          "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS c_name FROM customer")
def q_e1b(spark, sf_dir):
    """E1 on a high-cardinality column (one code per customer name)."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return enc.apply_encoder(df, enc.fit_label_encoder(df, "c_name"))


E2_SQL = ("WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1), "
          "k AS (SELECT v FROM c WHERE n >= greatest(1, floor((SELECT count(*) FROM orders) * 0.0005))), "
          "f AS (SELECT o_orderkey, CASE WHEN CAST(o_custkey AS VARCHAR) IN (SELECT v FROM k) "
          "THEN CAST(o_custkey AS VARCHAR) ELSE 'other' END AS v FROM orders)\n"
          "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS o_custkey FROM f")


@register("e2_rare_to_other", E2_SQL)
def q_e2(spark, sf_dir):
    """Customers with fewer than 0.05 % of orders fold to 'other' before label encoding."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    e = enc.fit_label_encoder(df, "o_custkey", min_share=0.0005)
    return enc.apply_encoder(df, e)


E3_SQL = (f"WITH p AS (SELECT {KEYS}, l_linestatus AS v, row_number() OVER (ORDER BY {KEYS}) AS pos FROM lineitem), "
          f"d AS (SELECT v, row_number() OVER (ORDER BY min(pos)) - 1 AS code FROM p GROUP BY v)\n"
          f"SELECT {KEYS}, CAST(code AS BIGINT) AS l_linestatus FROM p JOIN d USING (v)")


@register("e3_factorize", E3_SQL)
def q_e3(spark, sf_dir):
    """The reference's "onehot" = code by first appearance (row-key order)."""
    df = table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_linestatus")
    return enc.apply_encoder(df, enc.fit_factorize_encoder(df, "l_linestatus", ROW_KEYS))


E4_SQL = ("WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1), "
          "r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS rk, "
          "sum(n) OVER (ORDER BY n DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c), "
          "k AS (SELECT v FROM r WHERE rk <= 50 AND coalesce(prev, 0) < 0.95 * (SELECT count(*) FROM orders)), "
          "f AS (SELECT o_orderkey, CASE WHEN CAST(o_custkey AS VARCHAR) IN (SELECT v FROM k) "
          "THEN CAST(o_custkey AS VARCHAR) ELSE 'other' END AS v FROM orders), "
          "d AS (SELECT v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM f GROUP BY v)\n"
          "SELECT o_orderkey, CAST(code AS BIGINT) AS o_custkey FROM f JOIN d USING (v)")


@register("e4_head_coverage", E4_SQL)
def q_e4(spark, sf_dir):
    """Keep the most frequent customers until 95 % coverage or 50 kept; rest 'other';
    then codes by first appearance."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    e = enc.fit_factorize_encoder(df, "o_custkey", ["o_orderkey"], coverage=enc.HEAD_SHARE)
    return enc.apply_encoder(df, e)


@register("e3_one_hot", f"SELECT {KEYS}, " + ", ".join(
    f"CAST(l_returnflag = '{v}' AS INTEGER) AS flag_{v}" for v in "ANR") + " FROM lineitem")
def q_e3h(spark, sf_dir):
    """True one-hot columns."""
    d = enc.one_hot(table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_returnflag"), "l_returnflag", ["A", "N", "R"], "flag")
    return d.drop("l_returnflag")


E5_SQL = (f"WITH d AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM "
          f"(SELECT DISTINCT l_returnflag AS v FROM lineitem) AS x), "
          f"c AS (SELECT {KEYS}, (SELECT code FROM d WHERE v = l_returnflag) + (l_linenumber - 4) * 0.4 AS x "
          f"FROM lineitem)\n"
          f"SELECT {KEYS}, d.v AS l_returnflag FROM c JOIN d ON d.code = CAST(least(greatest("
          f"round_even(x, 0), 0), (SELECT max(code) FROM d)) AS BIGINT)")


@register("e5_inverse_decode", E5_SQL)
def q_e5(spark, sf_dir):
    """E5: perturbed codes are rounded half-even, clipped to [0, K-1] and decoded."""
    df = table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_returnflag")
    e = enc.fit_label_encoder(df, "l_returnflag")
    coded = enc.apply_encoder(df, e).withColumn(
        "l_returnflag", F.col("l_returnflag") + (F.col("l_linenumber") - 4) * 0.4)
    return enc.invert_encoder(coded, e)


E6_SQL = ("WITH u AS (SELECT CAST(l_quantity AS VARCHAR) AS v FROM lineitem WHERE l_orderkey % 2 = 0 "
          "UNION SELECT CAST(l_quantity + l_partkey % 3 AS VARCHAR) FROM lineitem WHERE l_orderkey % 2 = 1)\n"
          "SELECT v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS code FROM u")


@register("e6_joint_dictionary", E6_SQL)
def q_e6(spark, sf_dir):
    """One dictionary over the values of both sides (as strings)."""
    real, syn = lineitem_halves(spark, sf_dir)
    return enc.fit_joint_encoder(real, syn, "l_quantity").dictionary


E7_SQL = (f"WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS v, "
          f"{portable_hash_sql(['o_orderkey'])} < {TEST_CUT} AS is_test FROM orders), "
          f"d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
          f"(SELECT v FROM o WHERE NOT is_test UNION SELECT 'Other') AS x)\n"
          f"SELECT o_orderkey, CAST(coalesce(d.code, (SELECT code FROM d WHERE v = 'Other')) AS BIGINT) AS o_custkey "
          f"FROM o LEFT JOIN d USING (v) WHERE is_test")


@register("e7_unseen_to_other", E7_SQL)
def q_e7(spark, sf_dir):
    """Dictionary of the training split + 'Other'; unseen test values -> 'Other'."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    train, test = smp.train_test_split(o, ["o_orderkey"], 0.2, 42)
    e = enc.fit_with_unseen(train, "o_custkey")
    return enc.apply_with_unseen(test, e)


@register("e8_category_table",
          f"WITH {NULLS_CTE}\nSELECT l_returnflag AS value, count(*) AS count FROM li_nulls "
          f"WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_e8(spark, sf_dir):
    """Distinct categories with counts."""
    return enc.category_table(lineitem_with_nulls(spark, sf_dir), "l_returnflag")


# ---------------------------------------------------------------- D: dates

@register("d1_expand_datetime",
          f"SELECT {KEYS}, CAST(year(l_shipdate) AS BIGINT) AS l_shipdate_year, "
          f"CAST(month(l_shipdate) AS BIGINT) AS l_shipdate_month, CAST(day(l_shipdate) AS BIGINT) AS l_shipdate_day, "
          f"CAST(isodow(l_shipdate) - 1 AS BIGINT) AS l_shipdate_dayofweek FROM lineitem")
def q_d1(spark, sf_dir):
    """Year, month, day, day of week (Monday = 0)."""
    return dt.expand_datetime(table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_shipdate"), "l_shipdate")


@register("d2_rebuild_datetime",
          f"SELECT {KEYS}, TRY_CAST(printf('%04d-%02d-%02d', CAST(year(l_shipdate) AS INTEGER), "
          f"CAST(month(l_shipdate) AS INTEGER), CAST(day(l_shipdate) + (l_linenumber % 3) * 11 AS INTEGER)) "
          f"AS TIMESTAMP) AS l_shipdate FROM lineitem")
def q_d2(spark, sf_dir):
    """Rebuild dates from parts with days shifted by 0/11/22 (impossible -> null)."""
    parts = dt.expand_datetime(table(spark, sf_dir, "lineitem").select(*ROW_KEYS, "l_shipdate"), "l_shipdate")
    parts = parts.withColumn("l_shipdate_day", F.col("l_shipdate_day") + (F.col("l_linenumber") % 3) * 11)
    return dt.rebuild_datetime(parts, "l_shipdate")
