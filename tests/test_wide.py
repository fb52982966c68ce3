"""Wide tables: blocked cross products and principal axes against the plain forms; exact KS p-values."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfid.operators import multivariate as mv
from tabfid.operators import univariate as uni
from tabfid.operators.pair import TablePair


def wide_pair(spark, k, n=300, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((k, k)) * (rng.random((k, k)) < 0.3) + np.eye(k)
    scale = np.exp(-np.arange(k) / 4)
    out = []
    for shift in (0.0, 0.3):
        x = (rng.standard_normal((n, k)) * scale) @ mix + shift + 1e6 * (np.arange(k) == 1)
        x[:, k - 1] = 4.0  # constant
        out.append(x)
    cols = [f"c{i}" for i in range(k)]
    frames = [spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3) for x in out]
    return TablePair(*frames), cols, out


@pytest.mark.parametrize("k", [5, 60])
def test_blocked_gram(spark, monkeypatch, k):
    pair, cols, data = wide_pair(spark, k)
    plain = mv.gram(pair, cols) if k == 5 else None
    monkeypatch.setattr(mv, "SUMS_AT_ONCE", 0)
    monkeypatch.setattr(mv, "TILE", 16)
    monkeypatch.setattr(mv, "STRIP_MB", 0)
    got = mv.gram(pair, cols)
    for s, x in enumerate(data):
        z = x - x.mean(axis=0)
        assert got[f"n_{s}"] == len(x) and np.allclose(got[f"mean_{s}"], x.mean(axis=0))
        assert np.allclose(got[f"S_{s}"], z.T @ z, rtol=1e-7, atol=1e-5)
        assert got[f"const_{s}"].tolist() == [False] * (k - 1) + [True]
        if plain:
            assert np.allclose(got[f"S_{s}"], plain[f"S_{s}"], rtol=1e-9, atol=1e-6)
            assert (got[f"const_{s}"] == plain[f"const_{s}"]).all()


def test_principal_axes(spark, monkeypatch):
    pair, cols, _ = wide_pair(spark, 40)
    want = [mv.pca_similarity(pair, cols, 4, mode).first()[0] for mode in ("reference", "explained_variance")]
    monkeypatch.setattr(mv, "WIDE_PCA", 10)
    got = [mv.pca_similarity(pair, cols, 4, mode).first()[0] for mode in ("reference", "explained_variance")]
    assert got == pytest.approx(want, rel=1e-6) and 0 < want[1] < 1


def test_blocked_gram_of_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(mv, "SUMS_AT_ONCE", 0)
    pair, cols, _ = wide_pair(spark, 5)
    got = mv.gram(TablePair(pair.real, pair.synthetic.limit(0)), cols)
    assert got["n_1"] == 0 and got["const_1"].all() and not got["S_1"].any() and got["n_0"] == 300


@pytest.mark.parametrize("n,m", [(3, 4), (5, 5), (4, 8), (1, 6), (6, 4)])
def test_exact_ks_against_all_orders(n, m):
    far = []
    for chosen in combinations(range(n + m), n):
        i, best = 0, 0
        for at in range(n + m):
            i += at in chosen
            best = max(best, abs(i * m - (at + 1 - i) * n))
        far.append(best)
    for h in set(far):
        assert uni.exact_ks_pvalue(h / (n * m), n, m) == pytest.approx(np.mean([f >= h for f in far]), rel=1e-12)


def test_ks_pvalue_is_exact_for_small_sides_only(spark, monkeypatch):
    pair = TablePair(spark.range(40).select(F.col("id").cast("double").alias("x")), spark.range(10, 60).select(F.col("id").cast("double").alias("x")))
    exact = uni.ks_wasserstein(pair).first()
    assert exact["ks_pvalue"] == pytest.approx(uni.exact_ks_pvalue(exact["ks_statistic"], 40, 50), rel=1e-12)
    monkeypatch.setattr(uni, "KS_EXACT_ROWS", 10)
    asymptotic = uni.ks_wasserstein(pair).first()["ks_pvalue"]
    assert asymptotic != exact["ks_pvalue"] and asymptotic == pytest.approx(exact["ks_pvalue"], rel=0.5)
    assert uni.exact_ks_pvalue(0.0, 7, 9) == 1.0 and 0 < uni.exact_ks_pvalue(1.0, 500, 400) < 1e-200


def test_kde_by_moments_equals_a_kernel_per_value(spark):
    rng = np.random.default_rng(3)
    values = [np.concatenate([rng.normal(0, 1, 400), rng.normal(50, 0.01, 100), [1e4]]), np.repeat([1.0, 2.0, 7.5], [300, 5, 60])]
    pair = TablePair(*[spark.createDataFrame([(float(v), 3.0) for v in x], "x double, flat double").repartition(3) for x in values])
    got = {(r["column_name"], r["side"], r["i"]): r for r in uni.kde_curves(pair).collect()}
    want = uni.kde_curves(pair, every_value=True).collect()
    assert len(got) == len(want) == 400
    peak = {s: max(r["density"] for r in want if r["side"] == s) for s in ("real", "synthetic")}
    for r in want:
        g = got[r["column_name"], r["side"], r["i"]]
        assert g["x"] == r["x"] and abs(g["density"] - r["density"]) <= 1e-12 * peak[r["side"]]


def test_copies_by_digest(spark):
    schema = "a string, b string, c double, d array<int>"
    real = [("x", "yz", 0.0, [1]), ("xy", "z", 1.0, None), (None, "q", None, []), ("w", None, float("nan"), [1, None]), ("r", "r", 2.0, [2])]
    syn = [("x", "yz", -0.0, [1])] * 3 + [("xyz", "", 1.0, None), (None, "q", None, []), ("w", None, float("nan"), [1, None]), ("w", "-", 1.0, [])]
    pair = TablePair(spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema), zero_fill=False)
    got = mv.duplicate_rows(pair).first()
    assert (got["duplicate_rows_count"], got["synthetic_rows"]) == (3, 7)
    assert got["copied_rows_pct"] == pytest.approx(500 / 7) and got["duplicate_rows_percentage"] == pytest.approx(300 / 7)


def test_approximate_neighbours(spark):
    from tabfid.operators.neighbors import approximate_points, nearest_neighbor_distance, nearest_neighbor_points
    rng = np.random.default_rng(5)
    cols = [f"c{i}" for i in range(12)]
    make = lambda n: spark.createDataFrame([tuple(map(float, r)) for r in rng.standard_normal((n, 12)) @ mix], ", ".join(f"{c} double" for c in cols))
    mix = rng.standard_normal((12, 12)) * np.exp(-np.arange(12) / 2)[:, None]
    pair = TablePair(make(3000), make(300))
    exact = {tuple(r)[:12]: r["d"] for r in nearest_neighbor_points(pair, cols, leaf_size=100).collect()}
    near = {tuple(r)[:12]: r["d"] for r in approximate_points(pair, cols, leaf_size=100).collect()}
    assert near.keys() == exact.keys() and all(near[p] >= exact[p] - 1e-12 for p in exact)
    assert np.mean([near[p] <= exact[p] + 1e-9 for p in exact]) >= 0.9
    e = nearest_neighbor_distance(pair, cols, leaf_size=100, epsilon=0.5).first()
    a = nearest_neighbor_distance(pair, cols, leaf_size=100, epsilon=0.5, approx=True).first()
    assert a["nearest_neighbor_mean"] == pytest.approx(e["nearest_neighbor_mean"], rel=0.02)
    assert e["near_share"] == pytest.approx(np.mean([d < 0.5 for d in exact.values()]))
    empty = TablePair(pair.real.limit(0), pair.synthetic)
    assert approximate_points(empty, cols).count() in (0, 300)
