"""Multi-column fidelity and privacy of a (real, synthetic) pair (ops J1-J5, J7-J12).

Correlation matrices come from one pass of centred cross-product sums: one aggregate for few columns, a
blocked product (tiles summed in the Arrow batches, ``_blocked_gram``) for many; only k x k numbers
reach the driver.  Past ``WIDE_PCA`` columns PCA does without them (``principal_axes``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfid.operators.pair import SIDE, TablePair, on_side, side_agg

# fixed constants of the reference
RATIO_EPS = 1e-10        # J9/J10 denominators
RANGE_EPS = 1e-8         # J12 denominators
ENTROPY_EPS = 1e-10      # J11 count offset
CODE_TOL = 0.25          # J11: a value counts for code c when within +-0.25
PCA_EPS = 1e-10          # J7 MAPE denominator
SUMS_AT_ONCE = 400       # cross-product sums of one aggregate; more columns take the blocked product
TILE = 128               # columns of a tile of the blocked product
STRIP_MB = 256           # sums that one task holds; more columns than fit take several scans
WIDE_PCA = 1000          # columns from which PCA uses the randomised range finder
PCA_OVERSAMPLE, PCA_ROUNDS, PCA_TOL = 10, 30, 1e-9


def _clean(c):
    """pandas .corr().fillna(0): NaN/null correlation -> 0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def gram(pair: TablePair, cols: list[str]) -> dict:
    """Two aggregate passes per pair: (1) count, mean, min, max per column and side;
    (2) centered cross-product sums S_ij = sum (x_i - m_i)(x_j - m_j), i <= j, per side.

    Only plain sums in pass 2 (the two-pass algorithm, numerically stable), so the
    aggregate stays inside whole-stage codegen and never divides by zero.  Returns
    numpy means, S (k x k), n, and a zero-variance flag (min = max) per side.
    Rows are assumed complete (the pair is zero-filled by default)."""
    k = len(cols)
    if k * (k + 1) // 2 > SUMS_AT_ONCE:
        out = _wide_stats(pair, cols)
        out["S_0"], out["S_1"] = _blocked_gram(pair, cols, out)
        return out
    st = side_agg(pair, cols, {"mean": F.avg, "lo": F.min, "hi": F.max, "n": F.count}).first()
    out: dict = {}
    for s in (0, 1):
        out[f"mean_{s}"] = np.array([st[f"{c}__mean__{s}"] or 0.0 for c in cols], dtype=float)
        out[f"n_{s}"] = int(st[f"{cols[0]}__n__{s}"] or 0)
        out[f"const_{s}"] = np.array([st[f"{c}__lo__{s}"] is None or st[f"{c}__lo__{s}"] == st[f"{c}__hi__{s}"]
                                      for c in cols])
    t = pair.tagged(cols, as_double=True)
    cen = {c: F.col(c) - F.when(F.col(SIDE) == 0, F.lit(float(out["mean_0"][i])))
           .otherwise(F.lit(float(out["mean_1"][i]))) for i, c in enumerate(cols)}
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    out["S_0"], out["S_1"] = np.zeros((k, k)), np.zeros((k, k))
    row = t.groupBy().pivot(SIDE, [0, 1]).agg(*[F.sum(cen[cols[i]] * cen[cols[j]]).alias(f"s_{i}_{j}") for i, j in pairs]).first()
    for s in (0, 1):
        for i, j in pairs:
            v = row[f"{s}_s_{i}_{j}" if len(pairs) > 1 else f"{s}"]
            out[f"S_{s}"][i, j] = out[f"S_{s}"][j, i] = 0.0 if v is None else float(v)
    return out


def _batches(pair: TablePair, cols: list[str], each, schema: str) -> DataFrame:
    """``each(blocks)`` over every partition of both sides; a block is (side, rows x columns)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for b in batches:
                side = b.column(0).to_numpy(zero_copy_only=False)
                x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(cols))])
                for s in (0, 1):
                    here = x if (side == s).all() else x[side == s]
                    if len(here):
                        yield s, here
        yield from each(blocks())

    return pair.tagged(cols, as_double=True).select(SIDE, *cols).mapInArrow(run, schema)


def _wide_stats(pair: TablePair, cols: list[str]) -> dict:
    """Counts, means and constant columns of both sides in one scan, a row of sums per task and column."""
    def each(blocks):
        held: dict = {}
        for s, x in blocks:
            n, total, lo, hi = held.get(s, (0, 0.0, np.inf, -np.inf))
            held[s] = n + len(x), total + x.sum(axis=0), np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        for s, (n, total, lo, hi) in held.items():
            yield pa.RecordBatch.from_pydict({"side": [s] * len(cols), "i": list(range(len(cols))), "n": [n] * len(cols),
                                              "total": total, "lo": lo, "hi": hi},
                                             pa.schema([("side", pa.int32()), ("i", pa.int32()), ("n", pa.int64()),
                                                        ("total", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())]))

    long = _batches(pair, cols, each, "side int, i int, n bigint, total double, lo double, hi double")
    rows = long.groupBy("side", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"),
                                         F.max("hi").alias("hi")).collect()   # 2 k rows
    out: dict = {}
    for s in (0, 1):
        mine = {r["i"]: r for r in rows if r["side"] == s}
        out[f"n_{s}"] = int(mine[0]["n"]) if mine else 0
        out[f"mean_{s}"] = np.array([mine[i]["total"] / mine[i]["n"] if mine else 0.0 for i in range(len(cols))])
        out[f"const_{s}"] = np.array([not mine or mine[i]["lo"] == mine[i]["hi"] for i in range(len(cols))])
    return out


def _blocked_gram(pair: TablePair, cols: list[str], stats: dict) -> list[np.ndarray]:
    """Centred cross-product sums of both sides in one scan, for any number of columns that ``STRIP_MB`` holds
    (else one scan per strip of rows of the matrix).

    A task multiplies whole Arrow batches and keeps one sum; at its end it hands over tiles.  Equal tiles are
    dealt together and added one after the other, so no task holds more than one of them.
    """
    k = len(cols)
    means = [stats["mean_0"], stats["mean_1"]]
    out = [np.zeros((k, k)), np.zeros((k, k))]
    strip = max(TILE, int(STRIP_MB * 2**20 / 16 / k) // TILE * TILE)
    tile_schema = "side int, i int, j int, sums array<double>"
    arrow = pa.schema([("side", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def tile_rows(tiles):
        for (s, i, j), v in tiles:
            yield pa.RecordBatch.from_pydict({"side": [s], "i": [i], "j": [j], "sums": [v.ravel()]}, arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for r, (s, i, j) in enumerate(zip(*[b.column(c).to_pylist() for c in range(3)])):
                v = b.column(3)[r].values.to_numpy()
                if at != (s, i, j):
                    if at is not None:
                        yield from tile_rows([(at, total)])
                    at, total = (s, i, j), np.zeros(len(v))
                total = total + v
        if at is not None:
            yield from tile_rows([(at, total)])

    for top in range(0, k, strip):
        end = min(top + strip, k)

        def each(blocks, top=top, end=end):
            held: dict = {}
            for s, x in blocks:
                z = x - means[s]
                part = z[:, top:end].T @ z[:, top:]
                held[s] = held[s] + part if s in held else part
            for s, total in held.items():
                yield from tile_rows(((s, i, j), total[i - top:min(i + TILE, end) - top, j - top:j + TILE - top])
                                     for i in range(top, end, TILE) for j in range(i, k, TILE))

        tiles = _batches(pair, cols, each, tile_schema)
        whole = tiles.repartition("side", "i", "j").sortWithinPartitions("side", "i", "j").mapInArrow(add, tile_schema)
        for r in whole.toLocalIterator():   # k x k numbers in all, one partition's tiles at a time
            i, j = r["i"], r["j"]
            v = np.array(r["sums"]).reshape(min(TILE, end - i), min(TILE, k - j))
            out[r["side"]][i:i + v.shape[0], j:j + v.shape[1]] = v
            out[r["side"]][j:j + v.shape[1], i:i + v.shape[0]] = v.T
    return out


def principal_axes(pair: TablePair, cols: list[str], stats: dict, m: int, sd: np.ndarray, seed: int = 0) -> np.ndarray:
    """First ``m`` principal axes (k x m) of the standardised real side by a randomised range finder.

    Every round is one scan that sums Z^T (Z Q) for a basis Q of ``m`` + ``PCA_OVERSAMPLE`` columns, k x l numbers
    instead of k x k; rounds end when the variances along the axes are settled.
    """
    k, mean = len(cols), stats["mean_0"]
    width = min(k, m + PCA_OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, width)))[0]
    before = None
    for _ in range(PCA_ROUNDS):
        y = _projected(pair, cols, mean, sd, q, 0)
        small = q.T @ y
        w, v = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(w)[::-1][:m]
        axes, now = q @ v[:, top], w[top]
        if before is not None and np.abs(now - before).max() <= PCA_TOL * max(np.abs(now).max(), PCA_EPS):
            break
        before, q = now, np.linalg.qr(y)[0]
    return axes


def _projected(pair: TablePair, cols: list[str], mean: np.ndarray, sd: np.ndarray, q: np.ndarray, side: int) -> np.ndarray:
    """Z^T (Z q) of one side, Z its rows less ``mean`` over ``sd``: k x l sums, one row of l per task and column."""
    def each(blocks):
        total = None
        for s, x in blocks:
            if s == side:
                z = (x - mean) / sd
                part = z.T @ (z @ q)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(cols), dtype="int32"), "sums": list(total)},
                                             pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    long = _batches(pair, cols, each, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "v"))
    out = np.zeros((len(cols), q.shape[1]))
    for r in long.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out


def _corr_from_gram(S: np.ndarray, const: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.clip(np.diag(S), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = S / np.outer(d, d)
    c = np.nan_to_num(c, nan=0.0, posinf=0.0, neginf=0.0)
    live = ~const
    c[~live, :] = 0.0
    c[:, ~live] = 0.0
    np.fill_diagonal(c, live.astype(float))
    return np.clip(c, -1.0, 1.0)


def correlation_long(pair: TablePair, cols: list[str] | None = None, g: dict | None = None) -> DataFrame:
    """(col_i, col_j, real_corr, synthetic_corr, diff, valid_i, valid_j) for all k^2
    ordered pairs incl. the diagonal (1, or 0 for a constant column).  ``valid`` = the
    column has non-zero variance on both sides (and at least two rows)."""
    cols = cols or pair.numeric
    g = g if g is not None else gram(pair, cols)
    const = [g["const_0"] | (g["n_0"] < 2), g["const_1"] | (g["n_1"] < 2)]
    cr, cs = _corr_from_gram(g["S_0"], const[0]), _corr_from_gram(g["S_1"], const[1])
    valid = ~const[0] & ~const[1]
    rows = [(a, b, float(cr[i, j]), float(cs[i, j]), float(cr[i, j] - cs[i, j]), bool(valid[i]), bool(valid[j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return pair.real.sparkSession.createDataFrame(
        rows, "col_i string, col_j string, real_corr double, synthetic_corr double, diff double, "
              "valid_i boolean, valid_j boolean")


def correlation_similarity(pair: TablePair, cols: list[str] | None = None,
                           long: DataFrame | None = None) -> DataFrame:
    """1 - ||Cr - Cs||_F / sqrt(2 k) over columns with variance > 0 on both sides,
    clipped to [0, 1]; 0 when at most one column is valid."""
    long = long if long is not None else correlation_long(pair, cols)
    v = long.where(F.col("valid_i") & F.col("valid_j"))
    agg = v.agg(F.sum(F.col("diff") * F.col("diff")).alias("ss"),
                F.count_if(F.col("col_i") == F.col("col_j")).alias("k"))
    sim = 1 - F.sqrt(F.col("ss")) / F.sqrt(2 * F.col("k"))
    return agg.select(F.when(F.col("k") <= 1, F.lit(0.0))
                      .otherwise(F.least(F.greatest(sim, F.lit(0.0)), F.lit(1.0)))
                      .alias("correlation_similarity"))


def correlation_distance(pair: TablePair, cols: list[str] | None = None,
                         long: DataFrame | None = None) -> DataFrame:
    """RMSE and MAE over all k^2 entries of Cr - Cs; 0 when k <= 1."""
    long = long if long is not None else correlation_long(pair, cols)
    agg = long.agg(F.avg(F.col("diff") * F.col("diff")).alias("mse"),
                   F.avg(F.abs("diff")).alias("mae"),
                   F.count_if(F.col("col_i") == F.col("col_j")).alias("k"))
    return agg.select(
        F.when(F.col("k") <= 1, 0.0).otherwise(F.sqrt("mse")).alias("correlation_distance_rmse"),
        F.when(F.col("k") <= 1, 0.0).otherwise(F.col("mae")).alias("correlation_distance_mae"))


def _row_digest(df: DataFrame, cols: list[str]):
    """SHA-256 of the cells, each with its length before it and nulls marked, so that different rows are different
    strings; -0.0 counts as 0.0, as in a grouping."""
    types = dict(df.dtypes)

    def cell(c):
        v = F.col(c) + 0.0 if types[c] in ("double", "float") else F.col(c)
        v = F.to_json(F.struct(v.alias("v"))) if types[c].startswith(("array", "struct", "map")) else v.cast("string")
        return F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[cell(c) for c in cols]), 256))


def duplicate_rows(pair: TablePair, cols: list[str] | None = None) -> DataFrame:
    """Exact copies, found by a 256-bit digest of each row.

    duplicate_rows_count = distinct rows present on both sides; duplicate_rows_percentage
    = that count / synthetic rows * 100 (the reference's definition); copied_rows_pct =
    synthetic rows (repeats included) that equal some real row.  Equal rows combine
    map-side before the shuffle, so a row repeated a billion times costs one record, and a record is a digest
    and two numbers however wide the row is.
    """
    cols = cols or pair.columns
    t = pair.tagged(cols)
    g = t.select(SIDE, _row_digest(t, cols).alias("_digest")).groupBy("_digest").agg(
        F.max(1 - F.col(SIDE)).alias("in_real"), F.sum(F.col(SIDE)).alias("n_syn"))
    both = (F.col("in_real") == 1) & (F.col("n_syn") > 0)
    agg = g.agg(F.count_if(both).alias("duplicate_rows_count"),
                F.sum("n_syn").alias("synthetic_rows"),
                F.sum(F.when(both, F.col("n_syn")).otherwise(0)).alias("copied_rows"))
    return agg.select(
        "duplicate_rows_count",
        F.when(F.col("synthetic_rows") > 0,
               F.col("duplicate_rows_count") / F.col("synthetic_rows") * 100).otherwise(0.0)
        .alias("duplicate_rows_percentage"),
        F.when(F.col("synthetic_rows") > 0,
               F.col("copied_rows") / F.col("synthetic_rows") * 100).otherwise(0.0)
        .alias("copied_rows_pct"),
        F.coalesce(F.col("synthetic_rows"), F.lit(0)).cast("long").alias("synthetic_rows"))


def moments(pair: TablePair, cols: list[str], g: dict | None = None) -> dict:
    """Means, population std, counts and correlation matrices of both sides from the
    two Gram passes; numpy arrays (k and k x k)."""
    g = g if g is not None else gram(pair, cols)
    out = {}
    for s, name in ((0, "real"), (1, "syn")):
        n = max(g[f"n_{s}"], 1)
        const = g[f"const_{s}"] | (g[f"n_{s}"] < 2)
        out[f"corr_{name}"] = _corr_from_gram(g[f"S_{s}"], const)
        out[f"mean_{name}"] = g[f"mean_{s}"]
        out[f"sdp_{name}"] = np.where(const, 0.0, np.sqrt(np.clip(np.diag(g[f"S_{s}"]), 0, None) / n))
        out[f"n_{name}"] = g[f"n_{s}"]
    return out


def pca_similarity(pair: TablePair, cols: list[str] | None = None, n_components: int = 5,
                   mode: str = "reference", mo: dict | None = None) -> DataFrame:
    """PCA fitted on standardised real; compares component means of both sides.

    The mean of a projection is the projection of the means, so after one moments
    aggregate everything is k x k driver arithmetic.  ``reference`` mode: 1 - MAPE of
    component means (real means are 0 by construction, so this is ~0 unless synthetic
    means are 0 too).  ``explained_variance`` mode: 1 - mean relative error of the
    variance along each real component.  0 when numeric columns < n_components.
    """
    cols = cols or pair.numeric
    spark = pair.real.sparkSession
    m = n_components
    if len(cols) < m or len(cols) == 0:
        return spark.createDataFrame([(0.0, mode)], "pca_similarity double, mode string")
    if mo is None and len(cols) > WIDE_PCA:
        return _wide_pca(pair, cols, m, mode)
    mo = mo if mo is not None else moments(pair, cols)
    sd, comps, ev_r = _axes(mo, m)
    shift = (mo["mean_syn"] - mo["mean_real"]) / sd
    syn_means = shift @ comps
    ss = mo["sdp_syn"] / sd
    ns = max(mo["n_syn"], 2)
    cov_s = mo["corr_syn"] * np.outer(ss, ss) * ns / (ns - 1)
    ev_s = np.einsum("ij,ik,kj->j", comps, cov_s, comps)
    return _pca_row(spark, syn_means, ev_r, ev_s, mode)


def _axes(mo: dict, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spread of each real column, first ``m`` axes, variances along them) of the standardised real side."""
    sd = np.where(mo["sdp_real"] > 0, mo["sdp_real"], 1.0)
    # covariance of standardised real = correlation (constant columns -> 0 row/col)
    nr = max(mo["n_real"], 2)
    cov_r = mo["corr_real"] * np.outer(mo["sdp_real"] > 0, mo["sdp_real"] > 0) * nr / (nr - 1)
    w, v = np.linalg.eigh(cov_r)
    order = np.argsort(w)[::-1][:m]
    return sd, v[:, order], w[order]


def pca_components(pair: TablePair, cols: list[str] | None = None, n_components: int = 5) -> DataFrame:
    """J7's axes as a table: (component, variance, column_name, loading, mean, spread), k rows per component."""
    cols = cols or pair.numeric
    mo = moments(pair, cols)
    sd, axes, var = _axes(mo, n_components)
    rows = [(j, float(var[j]), c, float(axes[i, j]), float(mo["mean_real"][i]), float(sd[i]))
            for j in range(axes.shape[1]) for i, c in enumerate(cols)]
    return pair.real.sparkSession.createDataFrame(
        rows, "component int, variance double, column_name string, loading double, mean double, spread double")


def _pca_row(spark, syn_means: np.ndarray, ev_r: np.ndarray, ev_s: np.ndarray, mode: str) -> DataFrame:
    real_means = np.zeros(len(syn_means))
    if mode == "reference":
        mape = np.mean(np.abs((real_means - syn_means) / (np.abs(real_means) + PCA_EPS))) * 100
        sim = max(0.0, 1 - mape / 100)
    elif mode == "explained_variance":
        rel = np.abs(ev_r - ev_s) / np.maximum(np.abs(ev_r), PCA_EPS)
        sim = max(0.0, 1 - float(np.mean(rel)))
    else:
        raise ValueError(f"unknown PCA mode {mode!r}")
    return spark.createDataFrame([(float(sim), mode)], "pca_similarity double, mode string")


def _wide_pca(pair: TablePair, cols: list[str], m: int, mode: str) -> DataFrame:
    """J7 without the k x k matrix: axes by the range finder, variances along them from one more scan a side."""
    st = _wide_stats(pair, cols)
    var = []
    for s in (0, 1):
        def each(blocks, s=s):
            total = None
            for side, x in blocks:
                if side == s:
                    part = ((x - st[f"mean_{s}"]) ** 2).sum(axis=0)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"i": np.arange(len(cols), dtype="int32"), "v": total},
                                                 pa.schema([("i", pa.int32()), ("v", pa.float64())]))
        sums = {r["i"]: r["v"] for r in _batches(pair, cols, each, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        dead = st[f"const_{s}"] | (st[f"n_{s}"] < 2)
        var.append(np.where(dead, 0.0, [sums.get(i, 0.0) / max(st[f"n_{s}"], 1) for i in range(len(cols))]))
    sd = np.sqrt(np.where(var[0] > 0, var[0], 1.0))
    axes = principal_axes(pair, cols, st, m, sd)
    along = []
    for s in (0, 1):
        y = _projected(pair, cols, st[f"mean_{s}"], sd, axes, s)
        along.append(np.einsum("ij,ij->j", axes, y) / max(st[f"n_{s}"] - 1, 1))
    return _pca_row(pair.real.sparkSession, ((st["mean_1"] - st["mean_0"]) / sd) @ axes, along[0], along[1], mode)


def adjacent_ratios(pair: TablePair, cols: list[str] | None = None) -> DataFrame:
    """Mean and std (n-1) of b/a for adjacent columns; zero denominators -> null."""
    cols = cols or pair.numeric
    t = pair.tagged(cols, as_double=True)
    aggs = []
    for a, b in zip(cols, cols[1:]):
        ratio = F.try_divide(F.col(b), F.when(F.col(a) != 0, F.col(a)))
        for s in (0, 1):
            aggs += [F.avg(on_side(ratio, s)).alias(f"{a}__{b}__mean__{s}"),
                     F.stddev_samp(on_side(ratio, s)).alias(f"{a}__{b}__std__{s}")]
    if not aggs:
        return pair.real.sparkSession.createDataFrame(
            [], "col_a string, col_b string, real_ratio_mean double, real_ratio_std double, "
                "synthetic_ratio_mean double, synthetic_ratio_std double")
    row = t.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.col(f"{a}__{b}__mean__0").alias("real_ratio_mean"),
                 F.col(f"{a}__{b}__std__0").alias("real_ratio_std"),
                 F.col(f"{a}__{b}__mean__1").alias("synthetic_ratio_mean"),
                 F.col(f"{a}__{b}__std__1").alias("synthetic_ratio_std"))
        for a, b in zip(cols, cols[1:])])))


def relationship_loss(pair: TablePair, cols: list[str] | None = None, target_ratio: float = 2.0,
                      categorical: list[str] | None = None) -> DataFrame:
    """Per side, mean over adjacent non-categorical pairs of mean((b/(a+1e-10) - t)^2)."""
    cols = cols or pair.numeric
    cat = set(categorical or [])
    pairs = [(a, b) for a, b in zip(cols, cols[1:]) if a not in cat and b not in cat]
    t = pair.tagged(cols, as_double=True)
    aggs = []
    for a, b in pairs:
        e = F.pow(F.col(b) / (F.col(a) + F.lit(RATIO_EPS)) - F.lit(target_ratio), 2)
        for s in (0, 1):
            aggs.append(F.avg(on_side(e, s)).alias(f"{a}__{b}__{s}"))
    spark = pair.real.sparkSession
    if not pairs:
        return spark.createDataFrame([("real", 0.0), ("synthetic", 0.0)], "side string, relationship_loss double")
    row = t.agg(*aggs)
    n = max(1, len(pairs))
    out = []
    for s, name in ((0, "real"), (1, "synthetic")):
        tot = None
        for a, b in pairs:
            term = F.coalesce(F.col(f"{a}__{b}__{s}"), F.lit(0.0))
            tot = term if tot is None else tot + term
        out.append(F.struct(F.lit(name).alias("side"), (tot / n).alias("relationship_loss")))
    return row.select(F.inline(F.array(*out)))


def pairwise_ratios(pair: TablePair, cols: list[str] | None = None) -> DataFrame:
    """b/(a+1e-10) for every i<j pair: mean and std (n-1) per side, one aggregate."""
    cols = cols or pair.numeric
    t = pair.tagged(cols, as_double=True)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for a, b in pairs:
        r = F.col(b) / (F.col(a) + F.lit(RATIO_EPS))
        for s in (0, 1):
            aggs += [F.avg(on_side(r, s)).alias(f"{a}__{b}__m__{s}"),
                     F.stddev_samp(on_side(r, s)).alias(f"{a}__{b}__s__{s}")]
    row = t.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.col(f"{a}__{b}__m__0").alias("real_mean"), F.col(f"{a}__{b}__s__0").alias("real_std"),
                 F.col(f"{a}__{b}__m__1").alias("synthetic_mean"), F.col(f"{a}__{b}__s__1").alias("synthetic_std"))
        for a, b in pairs])))


def categorical_entropy(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Per encoded categorical column, entropy (natural log) of the code counts,
    where a value counts for code c when |v - c| <= 0.25 (c = 0..K-1), counts + 1e-10.
    Returns (column_name, entropy) plus a row ``__loss__`` = -mean(entropy)."""
    spark = df.sparkSession
    cols = list(dims)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])))
    code = F.rint("v")
    counts = long.where(F.abs(F.col("v") - code) <= CODE_TOL).groupBy(
        "column_name", code.cast("long").alias("code")).agg(F.count(F.lit(1)).alias("cnt"))
    # codes outside 0..K-1 do not count; codes that do not occur all have the same small share,
    # so their terms are added by number and no grid of codes is made
    size = spark.createDataFrame(list(dims.items()), "column_name string, k long")  # one row per column
    g = counts.join(F.broadcast(size), "column_name").where(F.col("code").between(0, F.col("k") - 1))
    tot = size.join(g.groupBy("column_name").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("met")), "column_name", "left")
    tot = tot.select("column_name", "k", F.coalesce("met", F.lit(0)).alias("met"),
                     (F.coalesce("n", F.lit(0)) + F.col("k") * F.lit(ENTROPY_EPS)).alias("total"))
    p = (F.col("cnt") + F.lit(ENTROPY_EPS)) / F.col("total")
    own = g.drop("k").join(F.broadcast(tot), "column_name").groupBy("column_name").agg(F.sum(-p * F.log(p)).alias("t"))
    q = F.lit(ENTROPY_EPS) / F.col("total")
    ent = tot.join(own, "column_name", "left").select(
        "column_name", (F.coalesce("t", F.lit(0.0)) - (F.col("k") - F.col("met")) * q * F.log(q)).alias("entropy"))
    loss = ent.agg(F.lit("__loss__").alias("column_name"), (-F.avg("entropy")).alias("entropy"))
    return ent.unionByName(loss)


def range_preservation(pair: TablePair, cols: list[str] | None = None) -> DataFrame:
    """Mean |range_s - range_r| / (range_r + 1e-8) + 0.5 (mean |min diff| / (range_r +
    1e-8) + mean |max diff| / (range_r + 1e-8)), whole-table min/max in one aggregate."""
    cols = cols or pair.numeric
    row = side_agg(pair, cols, {"lo": F.min, "hi": F.max})
    k = len(cols)
    rl = ml = xl = None
    for c in cols:
        lr, hr = F.col(f"{c}__lo__0"), F.col(f"{c}__hi__0")
        ls, hs = F.col(f"{c}__lo__1"), F.col(f"{c}__hi__1")
        rr = hr - lr
        d = rr + F.lit(RANGE_EPS)
        a, b, cc = F.abs((hs - ls) - rr) / d, F.abs(ls - lr) / d, F.abs(hs - hr) / d
        rl = a if rl is None else rl + a
        ml = b if ml is None else ml + b
        xl = cc if xl is None else xl + cc
    return row.select((rl / k).alias("range_loss"), (ml / k).alias("min_loss"), (xl / k).alias("max_loss"),
                      (rl / k + 0.5 * (ml / k + xl / k)).alias("range_preservation_loss"))


def encoded_correlation_distance(pair: TablePair, categorical: list[str] | None = None,
                                 numeric: list[str] | None = None) -> DataFrame:
    """Categories coded with one dictionary over both sides (E6), numbers coerced
    (M6) and min-max scaled with real's range (X4), then J2 over all columns."""
    from tabfid.operators import encode as enc
    from tabfid.operators import missing as mis
    from tabfid.operators import scale as sc
    categorical = categorical if categorical is not None else pair.categorical
    numeric = numeric if numeric is not None else pair.numeric
    real, syn = pair.real, pair.synthetic
    for c in categorical:
        e = enc.fit_joint_encoder(real, syn, c)
        real, syn = enc.apply_encoder(real, e), enc.apply_encoder(syn, e)
    cols = numeric + categorical
    real, syn = mis.coerce_numeric(real.select(*cols)), mis.coerce_numeric(syn.select(*cols))
    real, syn = sc.minmax_on_real(real, syn, cols)
    return correlation_distance(TablePair(real, syn, columns=cols, zero_fill=False), cols)
