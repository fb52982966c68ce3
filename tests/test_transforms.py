import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfid.operators import dates as dt
from tabfid.operators import encode as enc
from tabfid.operators import missing as mis
from tabfid.operators import sampling as smp
from tabfid.operators import scale as sc
from tabfid.operators import validate as val
from tests.conftest import SF001


def _ids(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))


def test_take_by_hash_exact_and_partition_invariant(spark):
    df = _ids(spark, 5000)
    a = {r["k"] for r in smp.sample_rows(df, ["k"], 1234).collect()}
    b = {r["k"] for r in smp.sample_rows(df.repartition(13), ["k"], 1234).collect()}
    assert len(a) == 1234 and a == b
    assert smp.sample_rows(df, ["k"], 10 ** 6).count() == 5000


def test_stratified_quota_exact(spark):
    df = _ids(spark, 7000)
    out = smp.stratified_sample(df, ["k"], "g", {0: 5, 1: 3, 2: 2}, 1000)
    got = {r["g"]: r["count"] for r in out.groupBy("g").count().collect()}
    assert got == {0: 500, 1: 300, 2: 200}


def test_resize_fill_and_trim(spark):
    df = _ids(spark, 30)
    assert smp.resize(df, ["k"], 100).count() == 100
    assert smp.resize(df, ["k"], 7).count() == 7


def test_rows_to_generate():
    assert smp.rows_to_generate(10) == 2
    assert smp.rows_to_generate(3) == 1
    assert smp.rows_to_generate(1000, "percent", 0.1) == 100
    assert smp.rows_to_generate(50, "exact", 80) == 50


def test_split_fraction(spark):
    tr, te = smp.train_test_split(_ids(spark, 20000), ["k"], 0.2)
    n = te.count()
    assert 3500 < n < 4500 and tr.count() + n == 20000


@pytest.mark.parametrize("method", ["standard", "minmax", "robust", "minmax01"])
def test_scaler_round_trip(spark, method):
    df = spark.createDataFrame([(float(x), int(x) % 5) for x in range(100)], "a double, b int")
    st = sc.fit_scaler(df, ["a", "b"], method)
    back = sc.invert_scaler(sc.apply_scaler(df, st), st).collect()
    assert [r["a"] for r in back] == pytest.approx([float(x) for x in range(100)])
    assert [r["b"] for r in back] == [x % 5 for x in range(100)]


def test_scaler_constant_and_minmax_range(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "a double")
    for m in ("standard", "robust", "minmax01"):
        st = sc.fit_scaler(df, ["a"], m)
        assert st["a"].scale == 1.0
    v = sc.apply_scaler(df, sc.fit_scaler(df, ["a"], "minmax")).first()["a"]
    assert v == -1.0
    with pytest.raises(ValueError):
        sc.fit_scaler(df, ["a"], "nope")


def test_scaler_mean_imputation(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "a double")
    st = sc.fit_scaler(df, ["a"], "standard")
    assert st["a"].has_missing and st["a"].fill == 2.0
    assert st["a"].scale == pytest.approx(math.sqrt(0.5))


def test_label_encoder_small_and_large_paths_agree(spark):
    df = spark.createDataFrame([(f"v{i % 37:03d}",) for i in range(500)], "c string")
    e = enc.fit_label_encoder(df, "c")
    small = {r["value"]: r["code"] for r in e.dictionary.collect()}
    values = df.select(F.col("c").alias("value")).distinct()
    big = {r["value"]: r["code"] for r in enc.index_sorted(values, ["value"], small_limit=5).collect()}
    assert small == big == {f"v{i:03d}": i for i in range(37)}


def test_encoder_inverse_clamps(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    e = enc.fit_label_encoder(df, "c")
    coded = spark.createDataFrame([(-3.0,), (0.5,), (1.5,), (2.6,), (99.0,), (None,)], "c double")
    got = [r["c"] for r in enc.invert_encoder(coded, e).collect()]
    assert sorted(got) == sorted(["a", "a", "c", "c", "c", "a"])


def test_mode_fill_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert mis.fit_mode_imputer(df, ["c"])["c"] == "a"


def test_dates_round_trip_and_invalid(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-02-29 00:00:00' AS t UNION ALL SELECT timestamp_ntz'2023-01-02 00:00:00'")
    parts = dt.expand_datetime(df, "t")
    rows = sorted(parts.collect())
    assert rows[0]["t_dayofweek"] == 0  # 2023-01-02 is a Monday
    back = dt.rebuild_datetime(parts, "t").collect()
    assert sorted(str(r["t"]) for r in back) == ["2023-01-02 00:00:00", "2024-02-29 00:00:00"]
    bad = parts.withColumn("t_day", F.lit(30.2))
    assert all(r["t"] is None or r["t"].month == 1 for r in dt.rebuild_datetime(bad, "t").collect())


def test_validation_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y")], "a int, b double, c string")
    issues = {(r["check"], r["column_name"]) for r in val.validate_data(df).collect()}
    assert ("constant_column", "a") in issues
    assert ("constant_column", "b") not in issues       # all-null is not constant
    assert ("missing_values", "b") in issues
    assert ("high_cardinality", "c") in issues
    v = val.verdict(val.validate_data(df)).first()
    assert not v["valid"]


def test_drop_missing_report(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet").withColumn(
        "l_tax", F.when(F.col("l_partkey") % 5 == 0, None).otherwise(F.col("l_tax")))
    clean, rep = mis.drop_missing(df)
    r = rep.first()
    assert r["rows_after"] == clean.count() and r["rows_dropped"] > 0


@pytest.mark.parametrize("expr", ["concat('k', id)", "id - 5000", "cast(uuid() as string)", "id"])
def test_split_by_any_key_type(spark, expr):
    """Text, negative and random keys: a fifth of the rows, and not by sign or order."""
    from tabfid.operators.sampling import sample_rows, split_label
    df = spark.range(10_000).select(F.expr(expr).alias("k"), "id").cache()
    d = split_label(df, ["k"], 0.2).cache()
    test = d.filter("split = 'test'")
    assert abs(test.count() / 10_000 - 0.2) < 0.015
    assert abs(test.filter("id < 5000").count() / test.count() - 0.5) < 0.05
    assert sample_rows(df, ["k"], 777).count() == 777


def test_exact_quotas():
    from tabfid.operators.sampling import exact_quotas
    for counts, total in (({"a": 5, "b": 3, "c": 2}, 101), ({"a": 1, "b": 1, "c": 1}, 100), ({"a": 999, "b": 1}, 10)):
        q = exact_quotas(counts, total)
        assert sum(q.values()) == total and min(q.values()) >= 1


@pytest.fixture
def unmeasured(spark):
    """Spark does not broadcast by measured bytes, as with inputs whose sizes it overrates."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, was)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_gathered_by_the_values_of_a_small_dictionary(spark, unmeasured):
    """Two values in many rows: the lookup must not send the rows by value."""
    from tabfid.operators import encode
    df = spark.range(100).selectExpr("id AS k", "CASE WHEN id < 90 THEN 'a' ELSE 'b' END AS v")
    e = encode.fit_factorize_encoder(df, "v", ["k"])
    for out in (encode.apply_encoder(df, e), encode.apply_with_unseen(df, encode.fit_with_unseen(df, "v")),
                encode.invert_encoder(encode.apply_encoder(df, e), e)):
        assert "SortMergeJoin" not in _plan(out)
        assert out.count() == 100
    got = {r["v"]: r["n"] for r in encode.apply_encoder(df, e).groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 90, 1: 10}


def test_rows_are_not_gathered_by_their_stratum(spark, unmeasured):
    """Quotas given on the driver: quotas and cuts travel, the rows stay."""
    from tabfid.operators import sampling
    df = spark.range(1000).selectExpr("id AS k", "CASE WHEN id % 10 < 9 THEN 'a' ELSE 'b' END AS v")
    out = sampling.stratified_sample(df, ["k"], "v", {"a": 3, "b": 1}, 40)
    assert "SortMergeJoin" not in _plan(out)
    assert {r["v"]: r["n"] for r in out.groupBy("v").agg(F.count("*").alias("n")).collect()} == {"a": 30, "b": 10}
    quota = spark.createDataFrame([("a", 30), ("b", 10)], "v string, quota long")
    plain = sampling.take_by_hash(df, ["k"], quota, strata=["v"])
    assert {r["k"] for r in plain.collect()} == {r["k"] for r in out.collect()}
