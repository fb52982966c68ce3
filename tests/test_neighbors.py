import numpy as np
import pytest

from tabfid.operators.neighbors import build_kd_tree, leaf_of, nearest_neighbor_distance, nearest_neighbor_points
from tabfid.operators.pair import TablePair


def _brute(a, b):
    m, s = a.mean(0), a.std(0)
    s[s == 0] = 1
    za, zb = (a - m) / s, (b - m) / s
    d = np.sqrt(((zb[:, None, :] - za[None, :, :]) ** 2).sum(-1)).min(1)
    return d


def _pair(spark, a, b):
    cols = [f"c{i}" for i in range(a.shape[1])]
    sch = ", ".join(f"{c} double" for c in cols)
    r = spark.createDataFrame([tuple(map(float, x)) for x in a], sch)
    s = spark.createDataFrame([tuple(map(float, x)) for x in b], sch)
    return TablePair(r, s), cols


@pytest.mark.parametrize("leaf_size,block", [(10 ** 6, 10 ** 6), (16, 8), (40, 3)])
def test_nn_exact_against_brute_force(spark, leaf_size, block):
    rng = np.random.default_rng(7)
    a = np.round(rng.normal(0, 1, (300, 3)), 1)
    b = np.round(rng.normal(0.2, 1.3, (250, 3)), 1)
    b[:40] = a[:40]                         # exact copies
    b[40:120] = b[40]                       # one hot repeated point
    pair, cols = _pair(spark, a, b)
    d = _brute(a, b)
    r = nearest_neighbor_distance(pair, cols, leaf_size=leaf_size, block=block).first()
    assert r["nearest_neighbor_mean"] == pytest.approx(d.mean(), rel=1e-9)
    assert r["nearest_neighbor_std"] == pytest.approx(d.std(), rel=1e-6)
    assert r["exact_match_share"] == pytest.approx((d == 0).mean())


def test_nn_points_weights(spark):
    a = np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]])
    b = np.array([[0.0, 0.0], [0.0, 0.0], [5.0, 5.0]])
    pair, cols = _pair(spark, a, b)
    pts = nearest_neighbor_points(pair, cols, leaf_size=1, block=1).collect()
    assert sum(r["w"] for r in pts) == 3


def test_kd_tree_leaves_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (4096, 4))
    dims, splits = build_kd_tree(x, 4)
    leaves = leaf_of(x, dims, splits, 4)
    counts = np.bincount(leaves, minlength=16)
    assert counts.min() >= 200 and counts.max() <= 300


@pytest.mark.parametrize("offset", [1.0, 1e3, 1e4])
def test_nn_exact_with_far_off_clusters(spark, offset):
    """Standardised coordinates far from the origin: rounding of the fast form must not show."""
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, (400, 3))
    a[:4, 0] += offset * 400
    b = rng.normal(0, 1, (300, 3))
    b[:100, 0] += offset * 400
    pair, cols = _pair(spark, a, b)
    d = _brute(a, b)
    r = nearest_neighbor_distance(pair, cols, leaf_size=50, block=20).first()
    assert r["nearest_neighbor_mean"] == pytest.approx(d.mean(), rel=1e-9)
    assert r["nearest_neighbor_std"] == pytest.approx(d.std(), rel=1e-6)


def test_nn_empty_leaves_and_zero_inflated_columns(spark):
    rng = np.random.default_rng(4)
    a = np.zeros((600, 3))
    a[:200] = rng.normal(0, 1, (200, 3))
    a[200:400, 0] = rng.normal(0, 1, 200)
    b = rng.normal(0, 6, (200, 3))
    pair, cols = _pair(spark, a, b)
    d = _brute(a, b)
    r = nearest_neighbor_distance(pair, cols, leaf_size=8, block=5).first()
    assert r["nearest_neighbor_mean"] == pytest.approx(d.mean(), rel=1e-9)


def test_search_inside_a_block_leaves_out_far_points():
    """The search equals brute force bit by bit, with and without a known distance, and measures few of the pairs."""
    from tabfid.operators import neighbors as nb
    rng = np.random.default_rng(3)

    def points(n):
        return np.c_[rng.integers(0, 7, n), rng.integers(0, 50, n) / 15, rng.normal(size=n), rng.integers(0, 11, n) / 3].astype(float)

    a, b = points(2000), points(2048)
    a[:20] = b[:20]
    want = nb._min_dist(a, b)
    seen, met = [], nb._met

    def counted(x, y, p, leaf, starts, d2):
        seen.append(int((starts[leaf + 1] - starts[leaf]).sum()))
        met(x, y, p, leaf, starts, d2)

    nb._met = counted
    try:
        assert np.array_equal(nb._nearest(a, b), want)
        bound = want * rng.uniform(0.5, 1.5, len(a))
        assert np.allclose(nb._nearest(a, b, bound), np.minimum(want, bound), rtol=1e-15)
    finally:
        nb._met = met
    assert 0 < sum(seen) < 0.3 * len(a) * len(b)
    same = np.ones((3000, 2))
    assert not nb._nearest(same, same).any()


def test_points_without_other_leaves_near_are_done_in_the_home_pass(spark):
    """Only points with another leaf nearer than their distance go on to the second pass, none of them twice."""
    from tabfid.operators import neighbors as nb
    rng = np.random.default_rng(5)
    a, b = (np.c_[rng.integers(0, 4, 4000) * 10.0, rng.normal(0, 1, (4000, 2))] for _ in range(2))
    pair, cols = _pair(spark, a, b)
    held = []
    pts = nb.nearest_neighbor_points(pair, cols, leaf_size=256, _held=held)
    got = np.sort([r["d"] for r in pts.collect()])
    home = held[-1]
    assert np.allclose(got, np.sort(_brute(a, b)), rtol=1e-12)
    done = home.where("leaf = -1 AND NOT more").count()
    assert home.where("leaf = -1").count() == len(b) and done > len(b) / 2
    assert home.where("leaf >= 0").count() < len(b)
    for h in held:
        h.unpersist()


@pytest.mark.parametrize("points", [np.ones((300, 2)), np.repeat([[0.0, 1.0]], 200, axis=0)])
def test_block_tree_parts_all_points_by_its_own_splits(points):
    from tabfid.operators.neighbors import _block_tree
    rng = np.random.default_rng(6)
    tied = np.c_[points, rng.integers(0, 3, len(points))].astype(float)
    for x in (points, tied, rng.normal(size=(1000, 3))):
        dims, splits, order, leaf = _block_tree(x, 4)
        assert np.array_equal(np.sort(order), np.arange(len(x))) and (np.diff(leaf) >= 0).all()
        assert np.array_equal(leaf_of(x[order], dims, splits, 4), leaf)
    assert np.bincount(leaf, minlength=16).max() <= 64


@pytest.mark.parametrize("leaf_size,block", [(64, 16), (10 ** 6, 50)])
def test_approximate_takes_the_nearest_of_the_probed_leaves_without_cogroup(spark, leaf_size, block):
    """The nearest real point of every probed leaf of every table, however its leaves are cut into blocks; blocks are taken
    many at a time, not by a call for each, and each leaf of a point is visited once."""
    from tabfid.operators import neighbors as nb
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(0, 1, (3000, 3)), 2), np.round(rng.normal(0.3, 1.2, (500, 3)), 2)
    b[:50], b[50:90] = a[:50], b[90]
    pair, cols = _pair(spark, a, b)
    out = nb.approximate_points(pair, cols, tables=3, probes=2, leaf_size=leaf_size, block=block)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
    got = {tuple(r[c] for c in cols): (r["w"], r["d"]) for r in out.collect()}
    m, s = a.mean(0), a.std(0)
    real, syn = np.unique(a, axis=0), np.unique(b, axis=0, return_counts=True)
    zr, zs = (real - m) / s, (syn[0] - m) / s
    assert len(got) == len(zs) and sum(w for w, _ in got.values()) == len(b)
    depth = max(0, int(np.ceil(np.log2(len(zr) / leaf_size))))
    want = np.full(len(zs), np.inf)
    turns = np.random.default_rng(42)
    turns = [np.eye(3)] + [np.linalg.qr(turns.standard_normal((3, 3)))[0] for _ in range(2)]
    for turn in turns:   # the sample is all of the real points
        tree = nb.build_kd_tree(zr @ turn, depth) if depth else None
        leaf = nb.leaf_of(zr @ turn, *tree, depth) if depth else np.zeros(len(zr), int)
        probed = nb._probed(zs @ turn, *tree, depth, 2) if depth else np.zeros((len(zs), 1), int)
        for i, leaves in enumerate(probed):
            near = zr[np.isin(leaf, leaves)]
            want[i] = min([want[i], *np.sqrt(((near - zs[i]) ** 2).sum(1))])
    have = np.array(sorted(got))
    order = np.lexsort(zs.T[::-1])
    assert np.allclose(have, zs[order])
    assert np.allclose([got[tuple(k)][1] for k in have], want[order], atol=1e-9)
