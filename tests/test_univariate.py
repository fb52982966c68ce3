import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfid.operators import univariate as uni
from tabfid.operators.pair import TablePair, cdf_table


def _pair(spark, a, b, name="x"):
    r = spark.createDataFrame([(float(v),) for v in a], f"{name} double")
    s = spark.createDataFrame([(float(v),) for v in b], f"{name} double")
    return TablePair(r, s)


def _ks_w1_numpy(a, b):
    a, b = np.sort(a), np.sort(b)
    allv = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(a, allv, side="right") / len(a)
    fb = np.searchsorted(b, allv, side="right") / len(b)
    d = np.max(np.abs(fa - fb))
    u = np.unique(allv)
    fa = np.searchsorted(a, u, side="right") / len(a)
    fb = np.searchsorted(b, u, side="right") / len(b)
    w = np.sum(np.abs(fa - fb)[:-1] * np.diff(u))
    return d, w


@pytest.mark.parametrize("rows_per_bucket", [10 ** 9, 37])
def test_ks_wasserstein_matches_numpy(spark, rows_per_bucket):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(0, 1, 400), 2)
    b = np.round(rng.normal(0.3, 1.2, 300), 2)
    pair = _pair(spark, a, b)
    res = uni.ks_wasserstein(pair, ["x"], rows_per_bucket=rows_per_bucket).first()
    d, w = _ks_w1_numpy(a, b)
    assert res["ks_statistic"] == pytest.approx(d, abs=1e-12)
    assert res["wasserstein"] == pytest.approx(w, rel=1e-9)


def test_cdf_buckets_do_not_change_result(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50, 500)
    b = rng.integers(10, 60, 500)
    pair = _pair(spark, a, b)
    one = {r["value"]: (r["cum_real"], r["cum_syn"], r["next_value"])
           for r in cdf_table(pair, ["x"], rows_per_bucket=10 ** 9).collect()}
    many = {r["value"]: (r["cum_real"], r["cum_syn"], r["next_value"])
            for r in cdf_table(pair, ["x"], rows_per_bucket=20).collect()}
    assert one == many


def test_closed_forms(spark):
    a = np.arange(100.0)
    same = uni.ks_wasserstein(_pair(spark, a, a), ["x"]).first()
    assert same["ks_statistic"] == 0 and same["wasserstein"] == 0 and same["ks_pvalue"] == 1.0
    shifted = uni.ks_wasserstein(_pair(spark, a, a + 3.0), ["x"]).first()
    assert shifted["wasserstein"] == pytest.approx(3.0)
    disjoint = uni.ks_wasserstein(_pair(spark, a, a + 1000.0), ["x"]).first()
    assert disjoint["ks_statistic"] == 1.0
    jsd = uni.jensen_shannon(_pair(spark, a, a), ["x"]).first()
    assert jsd["jsd"] == pytest.approx(0.0, abs=1e-7)


def test_jsd_no_synthetic_in_range_is_null(spark):
    a = np.arange(10.0)
    r = uni.jensen_shannon(_pair(spark, a, a + 100), ["x"]).first()
    assert r["jsd"] is None


def test_cdf_curve_ranks(spark):
    a = np.arange(2500.0)[::-1]
    b = np.arange(7.0)
    rows = uni.cdf_curve(_pair(spark, a, b), ["x"], points=1000).collect()
    real = sorted((r["i"], r["value"]) for r in rows if r["side"] == "real")
    syn = sorted((r["i"], r["value"]) for r in rows if r["side"] == "synthetic")
    n, m = 2500, 1000
    expect = [(i, float((i * (n - 1)) // (m - 1))) for i in range(m)]
    assert real == expect
    assert syn == [(i, float(i)) for i in range(7)]


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, 200)
    b = rng.normal(1, 2, 150)
    rows = uni.kde_curves(_pair(spark, a, b), ["x"], gridsize=50).collect()
    got = {(r["side"], r["i"]): r["density"] for r in rows}
    for side, v in (("real", a), ("synthetic", b)):
        bw = v.std(ddof=1) * len(v) ** (-0.2)
        grid = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 50)
        dens = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / bw) ** 2).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))
        for i in range(50):
            assert got[(side, i)] == pytest.approx(dens[i], rel=1e-9)


def test_partition_count_invariance(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, 300)
    b = rng.normal(0, 1, 300)
    p1 = _pair(spark, a, b)
    p8 = TablePair(p1.real.repartition(8), p1.synthetic.repartition(3))
    r1 = uni.ks_wasserstein(p1, ["x"]).first()
    r8 = uni.ks_wasserstein(p8, ["x"]).first()
    assert r1["ks_statistic"] == r8["ks_statistic"]
    assert r1["wasserstein"] == pytest.approx(r8["wasserstein"], rel=1e-12)


def test_exact_quantiles_match_numpy(spark):
    from tabfid.operators.pair import exact_quantiles
    rng = np.random.default_rng(9)
    a = np.round(rng.exponential(3, 777), 1)
    df = spark.createDataFrame([(float(x), float(x) * 2 if i % 5 else None) for i, x in enumerate(a)],
                               "x double, y double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["column_name"]: r for r in exact_quantiles(df, ["x", "y"], probs, rows_per_bucket=50).collect()}
    y = np.array([x * 2 for i, x in enumerate(a) if i % 5])
    for i, p in enumerate(probs):
        assert got["x"][f"q{i}"] == pytest.approx(np.quantile(a, p), rel=1e-12)
        assert got["y"][f"q{i}"] == pytest.approx(np.quantile(y, p), rel=1e-12)
    assert got["y"]["n"] == len(y)


def test_describe_paths_agree(spark):
    from tabfid.sources.io import describe
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    a = {r["column_name"]: r.asDict() for r in describe(df, cols).collect()}
    b = {r["column_name"]: r.asDict() for r in describe(df, cols, map_limit=0).collect()}
    for c in cols:
        for k in ("p25", "p50", "p75", "mean"):
            assert a[c][k] == pytest.approx(b[c][k], rel=1e-12)


def test_categorical_cdf_large_path_agrees(spark):
    r = spark.createDataFrame([(f"c{i % 53:02d}",) for i in range(700)], "x string")
    s = spark.createDataFrame([(f"c{(i * 7) % 61:02d}",) for i in range(500)], "x string")
    pair = TablePair(r, s)
    a = sorted(tuple(x) for x in uni.categorical_cdf(pair, ["x"]).collect())
    b = sorted(tuple(x) for x in uni.categorical_cdf(pair, ["x"], small_limit=10).collect())
    assert len(a) == len(b) == 61
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and x[4] == pytest.approx(y[4]) and x[5] == pytest.approx(y[5])


def test_category_frequencies_top_k_paths_agree(spark):
    r = spark.createDataFrame([(f"c{(i * i) % 97:02d}",) for i in range(900)], "x string")
    s = spark.createDataFrame([(f"c{(i * 5) % 89:02d}",) for i in range(700)], "x string")
    pair = TablePair(r, s)
    a = sorted(tuple(x) for x in uni.category_frequencies(pair, ["x"]).collect())
    b = sorted(tuple(x) for x in uni.category_frequencies(pair, ["x"], small_limit=7).collect())
    assert 25 <= len(a) <= 50 and [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b):
        assert x[2:] == pytest.approx(y[2:])


def test_counting_tasks_are_bounded(spark, monkeypatch):
    """Past the bound a single file split is dealt to several tasks, and buckets to as many as there are; the quartiles stay exact."""
    from tabfid.operators import pair
    from tabfid.sources import io

    df = spark.range(5_000).select((F.pmod(F.hash("id"), F.lit(900)) / 8.0).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") * 2).alias("b")).coalesce(1)
    want = sorted(io.describe(df).collect())
    monkeypatch.setattr(pair, "ENTRIES", 2_000)
    monkeypatch.setattr(pair, "ENTRIES_SPREAD", 2_000)
    got = io.describe(df, map_limit=0)
    assert "RoundRobinPartitioning(5)" in got._jdf.queryExecution().toString()
    for a, b in zip(want, sorted(got.collect()), strict=True):
        assert a["column_name"] == b["column_name"] and a["count"] == b["count"]
        assert [a[c] for c in ("min", "p25", "p50", "p75", "max")] == [b[c] for c in ("min", "p25", "p50", "p75", "max")]
