"""Exact nearest-neighbour distance of synthetic rows to real rows (op J6).

Exact and without all pairs:

1. standardise both sides by real's mean and population std (zero std -> 1);
2. collapse equal points (real: distinct; synthetic: distinct with a weight), so a
   row repeated a billion times is one point;
3. a k-d tree is built on the driver from a *bounded* hash sample of real points (at least 64 per leaf);
   points get their leaf id in Arrow batches;
4. home pass: every synthetic point meets the real points of its own leaf;
5. pruning, in the same task: a leaf can only hold a closer point if the distance from the point to the
   leaf's bounding box (true min/max of its real points) is below the home distance; a point without
   such leaves is done;
6. candidate pass: the other points meet only those leaves; the minimum over both passes is
   the exact nearest-neighbour distance.

Both passes meet in blocks keyed by (leaf, synthetic part, real part): a leaf with
many points on either side is cut on that side, so no block holds more than about ``block``
points of each, however skewed the data is.  A task reads the blocks dealt to it at once and takes them one by
one as slices of its arrays, which costs far less than a ``cogroup`` call for each.  Inside a block a small k-d tree over the real points,
and in the candidate pass the home distance, leave out most pairs, so leaves can be large: few groups to hand
over and few points with other leaves near.

In many dimensions the boxes prune little.  ``approximate_points`` then hashes the points by several k-d trees
of randomly turned points and looks into a fixed number of leaves of each, at a fixed cost per point.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfid.operators.pair import TablePair

SAMPLE_PER_LEAF = 64
LEAST_SAMPLE = 200_000          # rows of the tree sample, or SAMPLE_PER_LEAF for each leaf where these are more
LEAF, LEAF_MOST, LEAVES = 2_048, 16_384, 64     # real points a leaf: LEAF, from LEAVES of them on more, up to LEAF_MOST
BLOCK_LEAVES = 4                # a block holds up to so many times a leaf's points
ROWS_PER_TASK = 250_000         # points of both sides that a task of the passes takes
MAX_SAMPLE = 2_000_000          # bound on the driver-side tree sample (points)
MAX_LEAVES = 1 << 20
ANCHORS = 512                   # real points that bound the search of points in empty leaves
_HASH_RANGE = 1 << 30


def _standardised(pair: TablePair, cols: list[str]):
    row = pair.real.agg(F.count(F.lit(1)).alias("__n"), *[x for c in cols for x in (F.avg(F.col(c).cast("double")).alias(f"{c}__m"),
                                                     F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__s"))]).first()  # with the rows of real
    mean = {c: row[f"{c}__m"] or 0.0 for c in cols}
    sd = {c: (row[f"{c}__s"] if row[f"{c}__s"] else 1.0) for c in cols}

    def z(df):
        return df.select(*[((F.col(c).cast("double") - F.lit(mean[c])) / F.lit(sd[c])).alias(c) for c in cols])
    return z(pair.real), z(pair.synthetic), row["__n"]


def build_kd_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Heap-ordered split dimensions and values; left = value <= split."""
    n_inner = (1 << depth) - 1
    dims = np.zeros(max(n_inner, 1), dtype=np.int64)
    splits = np.full(max(n_inner, 1), np.inf)

    def rec(node, pts, level):
        if level == depth:
            return
        if len(pts) == 0:
            rec(2 * node + 1, pts, level + 1)
            rec(2 * node + 2, pts, level + 1)
            return
        spread = pts.max(0) - pts.min(0)
        d = int(np.argmax(spread))
        s = float(np.median(pts[:, d]))
        dims[node], splits[node] = d, s
        left = pts[:, d] <= s
        if left.all() and spread[d] > 0:
            s = float(np.nextafter(s, -np.inf))
            splits[node] = s
            left = pts[:, d] <= s
        rec(2 * node + 1, pts[left], level + 1)
        rec(2 * node + 2, pts[~left], level + 1)

    rec(0, points, 0)
    return dims, splits


def leaf_of(x: np.ndarray, dims: np.ndarray, splits: np.ndarray, depth: int) -> np.ndarray:
    idx = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(depth):
        go_right = x[rows, dims[idx]] > splits[idx]
        idx = 2 * idx + 1 + go_right
    return idx - ((1 << depth) - 1)


def _node_boxes(leafbox: pd.DataFrame, cols: list[str], depth: int):
    """Bounding boxes of every heap node from the leaf boxes (empty leaf = empty box)."""
    k, n_inner = len(cols), (1 << depth) - 1
    n = (1 << (depth + 1)) - 1
    lo = np.full((n, k), np.inf)
    hi = np.full((n, k), -np.inf)
    idx = leafbox["leaf"].to_numpy() + n_inner
    lo[idx] = leafbox[[f"{c}__lo" for c in cols]].to_numpy(dtype="float64")
    hi[idx] = leafbox[[f"{c}__hi" for c in cols]].to_numpy(dtype="float64")
    for node in range(n_inner - 1, -1, -1):
        lo[node] = np.minimum(lo[2 * node + 1], lo[2 * node + 2])
        hi[node] = np.maximum(hi[2 * node + 1], hi[2 * node + 2])
    return lo, hi


def _walk(x: np.ndarray, d2: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int):
    """(point index, leaf) pairs whose leaf box is closer than the point's bound,
    found level by level: a subtree is dropped as soon as its box is too far."""
    p = np.arange(len(x))
    node = np.zeros(len(x), dtype=np.int64)
    for _ in range(depth):
        p = np.concatenate([p, p])
        node = np.concatenate([2 * node + 1, 2 * node + 2])
        xs = x[p]
        gap = np.maximum(np.maximum(lo[node] - xs, 0.0), xs - hi[node])
        gap = np.where(np.isfinite(gap), gap, np.inf)
        keep = np.einsum("ij,ij->i", gap, gap) < d2[p]
        p, node = p[keep], node[keep]
    return p, node - ((1 << depth) - 1)


ROWS_AT_ONCE = 10_000           # that Python hands over
PAIRS_AT_ONCE = 1_000_000
POINTS_AT_ONCE = 4_096
MET_AT_ONCE = 1 << 15           # pairs measured at once in a leaf: few enough for the processor's cache
BOTTOM = 16                     # points a leaf of the tree inside a block


def _min_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact min Euclidean distance from each row of ``a`` to the rows of ``b``.

    Both are moved by the mean of ``b``; squared distances are then formed with one matrix
    product (|a|^2 + |b|^2 - 2ab), whose rounding error is below ``err``.  Every pair within
    twice that error of its row's smallest value is measured directly, so rounding in the
    fast form cannot change the result (copies still give exactly 0)."""
    out = np.full(len(a), np.inf)
    if len(b) == 0 or len(a) == 0:
        return out
    mean = b.mean(axis=0)
    ac, bc = a - mean, b - mean
    bb = np.einsum("ij,ij->i", bc, bc)
    eps = 4 * (a.shape[1] + 4) * np.finfo(float).eps
    chunk = max(1, 4_000_000 // len(b))
    for i in range(0, len(a), chunk):
        x = ac[i:i + chunk]
        xx = np.einsum("ij,ij->i", x, x)
        d2 = xx[:, None] + bb[None, :] - 2.0 * (x @ bc.T)
        err = eps * (xx[:, None] + bb[None, :])
        near = d2 - err <= (d2 + err).min(axis=1)[:, None]
        rows, cols = np.nonzero(near)
        best = np.full(len(x), np.inf)
        for j in range(0, len(rows), PAIRS_AT_ONCE):
            r, c = rows[j:j + PAIRS_AT_ONCE], cols[j:j + PAIRS_AT_ONCE]
            diff = a[i + r] - b[c]
            np.minimum.at(best, r, np.einsum("ij,ij->i", diff, diff))
        out[i:i + chunk] = best
    return np.sqrt(out)


def _block_tree(b: np.ndarray, depth: int):
    """As ``build_kd_tree`` with the leaves of ``b`` itself, a level at a time: dims, splits, the order of the
    points by leaf and their leaves in that order."""
    n_inner = (1 << depth) - 1
    dims, splits = np.zeros(max(n_inner, 1), dtype=np.int64), np.full(max(n_inner, 1), np.inf)
    order, node = np.arange(len(b)), np.zeros(len(b), dtype=np.int64)
    for level in range(depth):
        x = b[order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        at, ends = node[starts], np.r_[starts[1:], len(b)]
        hi = np.maximum.reduceat(x, starts, axis=0)
        dim = np.argmax(hi - np.minimum.reduceat(x, starts, axis=0), axis=1)
        seg = np.repeat(np.arange(len(starts)), ends - starts)
        v = x[np.arange(len(b)), dim[seg]]
        by = np.lexsort((v, seg))
        order, v = order[by], v[by]
        s, top = v[(starts + ends - 1) // 2], v[ends - 1]
        # left = value <= split; where that would be all, the largest value goes right
        s = np.where((s == top) & (v[starts] < top), np.nextafter(s, -np.inf), s)
        heap = (1 << level) - 1 + at
        dims[heap], splits[heap] = dim, s
        node = 2 * node + (v > s[seg])
    return dims, splits, order, node


def _bottom_boxes(b: np.ndarray, leaf: np.ndarray, depth: int):
    """Boxes of every heap node over the points ``b`` in order of their leaves, and where each leaf starts."""
    n_inner = (1 << depth) - 1
    lo = np.full((2 * n_inner + 1, b.shape[1]), np.inf)
    hi = -lo
    starts = np.searchsorted(leaf, np.arange((1 << depth) + 1))
    full = np.flatnonzero(starts[1:] > starts[:-1])
    lo[n_inner + full], hi[n_inner + full] = (f.reduceat(b, starts[full], axis=0) for f in (np.minimum, np.maximum))
    for level in range(depth - 1, -1, -1):
        at = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
        lo[at], hi[at] = np.minimum(lo[2 * at + 1], lo[2 * at + 2]), np.maximum(hi[2 * at + 1], hi[2 * at + 2])
    return lo, hi, starts


def _met(a: np.ndarray, b: np.ndarray, p: np.ndarray, leaf: np.ndarray, starts: np.ndarray, d2: np.ndarray) -> None:
    """Lower ``d2[p]`` to the squared distance of point ``a[p]`` to the points of ``b`` in its leaf."""
    n = starts[leaf + 1] - starts[leaf]
    ends = np.cumsum(n)
    i = 0
    while i < len(p):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MET_AT_ONCE, "right")))
        m = n[i:j]
        some = m > 0
        if some.any():
            m, q, first = m[some], p[i:j][some], starts[leaf[i:j]][some]
            heads = np.cumsum(m) - m
            diff = np.repeat(a[q], m, axis=0) - b[np.arange(m.sum()) + np.repeat(first - heads, m)]
            np.minimum.at(d2, q, np.minimum.reduceat(np.einsum("ij,ij->i", diff, diff), heads))
        i = j


def _nearest(a: np.ndarray, b: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
    """As ``_min_dist``, but a k-d tree over ``b`` (``BOTTOM`` points a leaf) leaves out what cannot be nearest.
    With ``bound``, distances that are not below it come out as it."""
    if len(b) <= 2 * BOTTOM or len(a) * len(b) <= PAIRS_AT_ONCE // 4:
        d = _min_dist(a, b)
        return d if bound is None else np.minimum(d, bound)
    depth = math.ceil(math.log2(len(b) / BOTTOM))
    dims, splits, order, leaf = _block_tree(b, depth)
    b = b[order]
    lo, hi, starts = _bottom_boxes(b, leaf, depth)
    d2 = np.full(len(a), np.inf) if bound is None else bound ** 2
    if bound is None:
        _met(a, b, np.arange(len(a)), leaf_of(a, dims, splits, depth), starts, d2)
        none = ~np.isfinite(d2)
        if none.any():   # an empty leaf: some point bounds the search
            d2[none] = np.einsum("ij,ij->i", a[none] - b[0], a[none] - b[0])
    for i in range(0, len(a), POINTS_AT_ONCE):
        x, best = a[i:i + POINTS_AT_ONCE], d2[i:i + POINTS_AT_ONCE]
        p, at = _walk(x, best, lo, hi, depth)
        _met(x, b, p, at, starts, best)
    out = np.sqrt(d2)
    return out if bound is None else np.minimum(out, bound)


def _with_leaf(df: DataFrame, cols: list[str], tree, depth, extra: str = "") -> DataFrame:
    def assign(batches):
        dims, splits = tree.value
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64")
            pdf["leaf"] = leaf_of(x, dims, splits, depth).astype("int32") if depth else 0
            yield pdf
    schema = ", ".join(f"`{c}` double" for c in cols) + (f", {extra}" if extra else "") + ", leaf int"
    return df.mapInPandas(assign, schema)


def _blocks(left: DataFrame, right: DataFrame, cols: list[str], block: int, meet, schema: str, tasks: int = 0,
            counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """``meet(left points, right points)`` for the points of both sides in the same leaf.  A leaf with many
    points on either side is cut into parts of about ``block`` on that side, and every left part meets every
    right part, so what holds for a point is the smallest distance of its rows.  Left points carry the number of
    parts of their leaf's right side as ``_rs``.  ``tasks``: partitions of the pass, else as Spark finds by bytes.
    ``counts``: tables (leaf, n) of the points of a side ("_ls", "_rs") where they are known."""
    def parts(side: DataFrame, name: str) -> DataFrame:
        n = (counts or {}).get(name)
        n = side.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")) if n is None else n
        return n.select("leaf", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block))).cast("int").alias(name))

    # one row per leaf: bounded by the leaf count
    subs = F.broadcast(parts(left, "_ls").join(parts(right, "_rs"), "leaf", "full").fillna(1))
    own = F.xxhash64(*cols)
    lh = left.join(subs, "leaf").withColumns({
        "sub": F.pmod(own, F.col("_ls")).cast("int"), "rsub": F.explode(F.sequence(F.lit(0), F.col("_rs") - 1))}).drop("_ls")
    rh = right.join(subs, "leaf").withColumns({
        "rsub": F.pmod(own, F.col("_rs")).cast("int"), "sub": F.explode(F.sequence(F.lit(0), F.col("_ls") - 1))}).drop("_ls", "_rs")
    rest = [c for c in lh.columns if c not in (*cols, "leaf", "sub", "rsub")]
    kinds = dict(lh.dtypes)
    both = lh.select("leaf", "sub", "rsub", F.lit(False).alias("_right"), *cols, *rest).unionByName(rh.select(
        "leaf", "sub", "rsub", F.lit(True).alias("_right"), *cols, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest]))
    both = both.repartition(*([tasks] if tasks else []), "leaf", "sub", "rsub")

    def fn(batches):
        batches = list(batches)
        if not sum(x.num_rows for x in batches):
            return
        t = pa.Table.from_batches(batches)
        right, *key = (t.column(c).to_numpy() for c in ("_right", "rsub", "sub", "leaf"))
        order = np.lexsort((right, *key))   # by block, left points first
        right, key = right[order], [x[order] for x in key]
        new = np.any([x[1:] != x[:-1] for x in key], axis=0)
        starts = np.append(0, np.flatnonzero(new) + 1)
        points = np.stack([t.column(c).to_numpy() for c in cols], axis=1)[order[right]]
        lefts = t.select(["leaf", *cols, *rest]).take(pa.array(order[~right])).to_pandas()
        upto = np.append(0, np.cumsum(~right))
        out = []
        for lo, hi in zip(starts, np.append(starts[1:], len(right))):
            if upto[hi] > upto[lo]:
                out.append(meet(lefts.iloc[upto[lo]:upto[hi]], points[lo - upto[lo]:hi - upto[hi]]))
        if out:
            found = pa.RecordBatch.from_pandas(pd.concat(out, ignore_index=True), preserve_index=False)
            for lo in range(0, found.num_rows, ROWS_AT_ONCE):
                yield found.slice(lo, ROWS_AT_ONCE)

    return both.mapInArrow(fn, schema)


def _tree_depth(n: float, leaf_size: int) -> int:
    return min(math.ceil(math.log2(n / leaf_size)), int(math.log2(MAX_LEAVES))) if n > leaf_size else 0


def nearest_neighbor_points(pair: TablePair, cols: list[str] | None = None, leaf_size: int | None = None,
                            block: int | None = None, seed: int = 42, _held: list | None = None) -> DataFrame:
    """Distinct synthetic points (standardised) with weight ``w`` and exact NN distance ``d``.

    ``leaf_size`` and ``block`` (points) are taken from the number of real points unless given.
    Intermediate tables are persisted and appended to ``_held``; the caller unpersists
    them after its action."""
    _held = _held if _held is not None else []
    cols = cols or pair.numeric
    zr, zs, rows = _standardised(pair, cols)
    # a bounded sample of the points (<= ~MAX_SAMPLE) says how many there are and fixes the splits of the tree
    frac = min(1.0, min(MAX_SAMPLE, max(LEAST_SAMPLE, SAMPLE_PER_LEAF * rows / (leaf_size or LEAF_MOST))) / max(rows, 1))
    picked = zr if frac == 1.0 else zr.where(
        F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(_HASH_RANGE)) < F.lit(int(frac * _HASH_RANGE)))
    sample = picked.distinct().toPandas()[cols].to_numpy(dtype="float64")
    n_real = len(sample) / frac
    leaf_size = leaf_size or int(min(LEAF_MOST, max(LEAF, n_real / LEAVES)))
    block = block or BLOCK_LEAVES * leaf_size
    depth = _tree_depth(n_real, leaf_size)
    if frac < 1.0:
        depth = min(depth, _tree_depth(len(sample), SAMPLE_PER_LEAF))
    spark = zr.sparkSession
    sc = spark.sparkContext
    tree = sc.broadcast(build_kd_tree(sample, depth) if depth else (np.zeros(1, dtype=np.int64), np.full(1, np.inf)))
    # each is read by several jobs below: keep them (memory, spilling to disk)
    real_l = _with_leaf(zr.distinct(), cols, tree, depth).persist(StorageLevel.MEMORY_AND_DISK)
    syn_l = _with_leaf(zs.groupBy(*cols).agg(F.count(F.lit(1)).alias("w")), cols, tree, depth, extra="w long").persist(
        StorageLevel.MEMORY_AND_DISK)
    _held.extend([real_l, syn_l])
    names = ", ".join(f"`{c}` double" for c in cols)
    # true bounding boxes of the real points per leaf (one row per leaf), then per tree node
    leafbox = real_l.groupBy("leaf").agg(F.count(F.lit(1)).alias("__n"), *[x for c in cols for x in (
        F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))]).toPandas()
    boxes = sc.broadcast(_node_boxes(leafbox, cols, depth))
    # a point whose leaf holds no real point takes its distance to the nearest of a few real
    # points as a first bound, so that it need not visit every leaf
    anchors = sc.broadcast(sample[:ANCHORS])
    syn_n = syn_l.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).toPandas()
    points = int(leafbox["__n"].sum() + syn_n["n"].sum())
    tasks = min(1 << depth, max(LEAVES, points // ROWS_PER_TASK)) if depth else 0
    counts = {name: spark.createDataFrame(n[["leaf", "n"]], "leaf int, n long") for name, n in (("_ls", syn_n), ("_rs", leafbox.rename(columns={"__n": "n"})))}

    def at_home(lp: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        """A row for each point (leaf -1) and one for each other leaf that may hold a closer point."""
        a = lp[cols].to_numpy(dtype="float64")
        d = _nearest(a, b)
        none = ~np.isfinite(d)
        if none.any() and len(anchors.value):
            d[none] = _min_dist(a[none], anchors.value)
        at, to = [np.arange(len(a))], [np.full(len(a), -1)]
        if depth and len(a):
            lo, hi = boxes.value
            own = lp["leaf"].iloc[0]
            for i in range(0, len(a), POINTS_AT_ONCE):
                p, leaf = _walk(a[i:i + POINTS_AT_ONCE], d[i:i + POINTS_AT_ONCE] ** 2, lo, hi, depth)
                at.append(i + p[leaf != own])
                to.append(leaf[leaf != own])
        p = np.concatenate(at)
        more = (lp["_rs"] > 1).to_numpy(dtype=bool)
        more[p[len(a):]] = True
        return pd.DataFrame({**{c: a[p, i] for i, c in enumerate(cols)}, "w": lp["w"].to_numpy()[p], "d": d[p],
                             "leaf": np.concatenate(to).astype("int32"), "more": more[p]})

    def at_candidates(lp: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        """The points that came nearer than they were known to be."""
        known = lp["d"].to_numpy(dtype="float64")
        d = _nearest(lp[cols].to_numpy(dtype="float64"), b, known)
        return lp.assign(d=d).loc[d < known, [*cols, "w", "d"]]

    home = _blocks(syn_l, real_l, cols, block, at_home, f"{names}, w long, d double, leaf int, more boolean", tasks, counts).persist(
        StorageLevel.MEMORY_AND_DISK)
    _held.append(home)
    found = home.where("leaf = -1")
    if depth:
        cand = home.where("leaf >= 0").select(*cols, "w", "d", "leaf")
        far = _blocks(cand, real_l, cols, block, at_candidates, f"{names}, w long, d double", tasks,
                      {"_rs": counts["_rs"]})
        rest = found.where("more").select(*cols, "w", "d").unionByName(far)
    else:
        rest = found.where("more").select(*cols, "w", "d")
    return found.where("NOT more").select(*cols, "w", "d").unionByName(
        rest.groupBy(*cols, "w").agg(F.min("d").alias("d")))


def _probed(x: np.ndarray, dims: np.ndarray, splits: np.ndarray, depth: int, probes: int) -> np.ndarray:
    """(points, 1 + probes) leaves: the own one, and those behind the splits of its path that are nearest."""
    rows = np.arange(len(x))
    path, margins = np.zeros((len(x), depth + 1), dtype=np.int64), np.empty((len(x), depth))
    for level in range(depth):
        node = path[:, level]
        at = x[rows, dims[node]] - splits[node]
        margins[:, level] = np.abs(at)
        path[:, level + 1] = 2 * node + 1 + (at > 0)
    out = [path[:, depth]]
    order = np.argsort(margins, axis=1, kind="stable")
    for j in range(min(probes, depth)):
        level = order[:, j]
        down = path[rows, level + 1]
        node = np.where(down % 2 == 1, down + 1, down - 1)   # the other child
        for _ in range(depth - 1):
            inner = node < (1 << depth) - 1
            at = np.where(inner, node, 0)
            go = x[rows, dims[at]] > splits[at]
            node = np.where(inner, 2 * node + 1 + go, node)
        out.append(node)
    return np.stack(out, axis=1) - ((1 << depth) - 1)


def approximate_points(pair: TablePair, cols: list[str] | None = None, tables: int = 6, probes: int = 4,
                       leaf_size: int | None = None, block: int | None = None, seed: int = 42, _held: list | None = None) -> DataFrame:
    """As ``nearest_neighbor_points``, but ``d`` is the distance to the nearest of the real points in the probed leaves:
    never too small, and exact for a share of the points that grows with ``tables`` and ``probes``.

    Every table is a locality-sensitive hash: a k-d tree over the points turned by a random rotation (the first is
    not turned), built on a bounded sample, so its leaves are about equally full.  A synthetic point meets
    ``tables * (1 + probes)`` leaves, whatever the number of real points."""
    cols = cols or pair.numeric
    leaf_size, block = leaf_size or LEAF, block or LEAF
    zr, zs, _ = _standardised(pair, cols)
    # read several times: the sample, the leaves' counts and the points
    real, syn = (d.persist(StorageLevel.MEMORY_AND_DISK) for d in (zr.distinct(), zs.groupBy(*cols).agg(F.count(F.lit(1)).alias("w"))))
    if _held is not None:
        _held.extend([real, syn])
    n_real = real.count()
    depth = min(max(0, math.ceil(math.log2(max(n_real, 1) / leaf_size))), int(math.log2(MAX_LEAVES))) if n_real else 0
    rng, sc, k = np.random.default_rng(seed), real.sparkSession.sparkContext, len(cols)
    turns = [np.eye(k)] + [np.linalg.qr(rng.standard_normal((k, k)))[0] for _ in range(tables - 1)]
    if depth:
        frac = min(1.0, min(MAX_SAMPLE, SAMPLE_PER_LEAF * (1 << depth)) / n_real)
        h = F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(_HASH_RANGE))
        sample = real.where(h < F.lit(int(frac * _HASH_RANGE))).toPandas()[cols].to_numpy(dtype="float64")
        trees = sc.broadcast([(r, *build_kd_tree(sample @ r, depth)) for r in turns])
    else:
        trees = sc.broadcast([(turns[0], np.zeros(1, dtype=np.int64), np.full(1, np.inf))])

    def leaves(batch: pa.RecordBatch, probe: int):
        """Of each table the leaves of each point, in order, and which of them are not there twice."""
        x = np.stack([batch.column(c).to_numpy() for c in cols], axis=1)
        for turn, dims, splits in trees.value:
            got = np.sort(_probed(x @ turn, dims, splits, depth, probe), axis=1) if depth else np.zeros((len(x), 1), np.int64)
            new = np.ones(got.shape, dtype=bool)
            new[:, 1:] = got[:, 1:] != got[:, :-1]
            yield got, new

    def counted(probe: int):
        def run(batches):
            n = np.zeros((tables, 1 << depth), dtype=np.int64)
            for batch in batches:
                for t, (got, new) in enumerate(leaves(batch, probe)):
                    n[t] += np.bincount(got[new], minlength=1 << depth)
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n.ravel()[full])], ["leaf", "n"])
        return run

    def placed(probe: int):
        def run(batches):
            for batch in batches:
                for t, (got, new) in enumerate(leaves(batch, probe)):
                    mine = batch.take(pa.array(np.nonzero(new)[0]))
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array((t << depth) + got[new])], [*mine.schema.names, "leaf"])
        return run

    names = ", ".join(f"`{c}` double" for c in cols)
    n_leaves = {name: side.mapInArrow(counted(probe), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
                for name, side, probe in (("_ls", syn, probes), ("_rs", real, 0))}   # at most MAX_LEAVES a table
    counts = {name: real.sparkSession.createDataFrame(n, "leaf long, n long") for name, n in n_leaves.items()}
    real_l = real.mapInArrow(placed(0), f"{names}, leaf long")
    syn_l = syn.mapInArrow(placed(probes), f"{names}, w long, leaf long")
    tasks = max(1, min(tables << depth, int(sum(n["n"].sum() for n in n_leaves.values())) // ROWS_PER_TASK))

    def meet(lp: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        return lp[[*cols, "w"]].assign(d=_nearest(lp[cols].to_numpy(dtype="float64"), b))

    met = _blocks(syn_l, real_l, cols, block, meet, f"{names}, w long, d double", tasks, counts)
    return met.groupBy(*cols, "w").agg(F.min("d").alias("d"))


def nearest_neighbor_distance(pair: TablePair, cols: list[str] | None = None, leaf_size: int | None = None,
                              block: int | None = None, max_rows: int | None = None, keys: list[str] | None = None,
                              seed: int = 42, approx: bool = False, epsilon: float | None = None) -> DataFrame:
    """Mean and population std of each synthetic row's distance to its nearest real
    row (standardised by real), plus the share of synthetic rows with distance 0 and, with
    ``epsilon``, the share nearer than that (``near_share``).  ``approx`` takes ``approximate_points``.

    ``max_rows`` (default None = all rows) reproduces the reference's 20,000-row cap by
    a repeatable hash sample of each side (``keys`` = unique row key columns)."""
    cols = cols or pair.numeric
    spark = pair.real.sparkSession
    if not cols:
        empty = spark.createDataFrame([(0.0, 0.0, 0.0)], "nearest_neighbor_mean double, "
                                      "nearest_neighbor_std double, exact_match_share double")
        return empty if epsilon is None else empty.withColumn("near_share", F.lit(0.0))
    if max_rows is not None:
        from tabfid.operators.sampling import sample_rows
        if not keys:
            raise ValueError("max_rows needs the unique row key columns (keys=...)")
        pair = TablePair(sample_rows(pair.real, keys, max_rows, seed),
                         sample_rows(pair.synthetic, keys, max_rows, seed), columns=pair.columns,
                         zero_fill=False)
    held: list = []
    if approx:
        pts = approximate_points(pair, cols, leaf_size=leaf_size, block=block, seed=seed, _held=held)
    else:
        pts = nearest_neighbor_points(pair, cols, leaf_size, block, seed, held)
    agg = pts.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("d")).alias("s1"),
                  F.sum(F.col("w") * F.col("d") * F.col("d")).alias("s2"),
                  F.sum(F.when(F.col("d") == 0, F.col("w")).otherwise(0)).alias("z"),
                  F.sum(F.when(F.col("d") < F.lit(epsilon or 0.0), F.col("w")).otherwise(0)).alias("near"))
    mean = F.col("s1") / F.col("n")
    res = agg.select(
        F.coalesce(mean, F.lit(0.0)).alias("nearest_neighbor_mean"),
        F.coalesce(F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(0.0))
        .alias("nearest_neighbor_std"),
        F.coalesce(F.col("z") / F.col("n"), F.lit(0.0)).alias("exact_match_share"),
        F.coalesce(F.col("near") / F.col("n"), F.lit(0.0)).alias("near_share")).first()
    for h in held:
        h.unpersist()
    out = spark.createDataFrame([tuple(res)], "nearest_neighbor_mean double, nearest_neighbor_std double, "
                                              "exact_match_share double, near_share double")
    return out if epsilon is not None else out.drop("near_share")
