"""The copula model kept as tables (ops G1-G4, G7), for any number of values and conditions.

``synth.fit_copula`` holds its model in the driver; past its bounds it hands over to this module, where no
statistic is collected by stratum or by value:

* ``strata``: one row per stratum with its rows, shares of missing cells, Cholesky factor and the
  inverse distributions of its columns as arrays (quantile points of continuous columns without
  repeated ones, all values of discrete and categorical columns that have at most ``SMALL_VALUES``).
* ``values``: every value with its count, for the columns of a stratum that have more than that.

Fit: strata of up to ``FEW`` rows are sorted by stratum and fitted many at a time, in one pass over Arrow batches.
The others take one aggregate per stratum, one count of values, and one pass of normal scores, in which rows and
strata are merged in the order of (stratum, part); large strata have several parts.  Where the large strata are
few, their rows stay where they are and the distributions are broadcast instead.

Sample: a stratum's row is cut into blocks of row ids, generated many at a time, with the same random
streams as ``synth.sample_copula``.  A column with many values gets its draw u as a place in the
cumulative counts; the place falls into one of many buckets of equal mass, and draws and values are merged in
the order of the buckets, where a binary search finds the value (inverse-CDF range join).  Buckets
of equal mass take equal numbers of draws, whatever the share of a single value is, and hold no more values than
their mass, since no value weighs less than 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabfid.functions.random import norm_cdf, norm_ppf, normals, uniforms
from tabfid.session import shared_table

#: A stratum's column with more values than this keeps them in the table of values.
SMALL_VALUES = 1_024
#: Strata of up to so many rows (and no more than quantiles or small values) are fitted together.
FEW = 512
#: Rows of a stratum that are scored by one merge, and rows generated from one copy of its statistics.
PART, BLOCK = 50_000, 65_536
#: Mass, and so the most values, and draws of a bucket of equal mass, about.
WIDE = 32_768
#: Values and draws that a task merges.
MERGED = 400_000
#: Rows generated for each fitted one from which the strata are dealt anew.
MUCH = 2
MOST_TASKS = 10_000
#: Values of a range that a task sorts, about; rows sampled to bound the ranges, for each range, and at most.
RANGE, SAMPLED, SAMPLED_RANGE, MOST_SAMPLED = 200_000, 1_000, 50, 2_000_000
#: Rows of a table that is broadcast, and large strata whose distributions are.
MOST_BESIDE, MOST_STRATA = 100_000, 64
#: Longer strings are compared one by one.
SHORT = 64
#: Rows that Python hands over at once.
BATCH = 8_192

POINTS = "array<struct<column:int,large:boolean,x:array<double>,s:array<string>,upto:array<double>>>"


@dataclass
class TableModel:
    columns: list[str]
    strata: DataFrame     # key, stratum, n, nulls, chol, points; before (the rows of the strata of smaller keys) where all are of few rows
    values: DataFrame     # key, column, x, s, n, before (the counts of the smaller values)
    condition: str | None = None
    n_quantiles: int = 1000
    meta: dict = field(default_factory=dict)   # kinds, types, discrete


def stratum_key(c: Column) -> Column:
    """A null is a stratum of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def running(df: DataFrame, part: list[str], order: list[str], weight: str, name: str, per_range: int = 200_000,
            count: int | None = None) -> DataFrame:
    """``df`` with ``before``, the sum of ``weight`` of the earlier rows of the same ``part``, for rows of unique
    (part, order): range-sorted, running sums in each range, and the ranges' sums added up per part.  ``count``: the
    rows of ``df`` where they are known."""
    ranges = max(1, -(-(df.count() if count is None else count) // per_range))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _sorted(list(batches), [*part, *order])
        if rows is not None:
            new = np.zeros(rows.num_rows, dtype=bool)
            for c in part:
                new[1:] |= pc.not_equal(rows.column(c)[1:], rows.column(c)[:-1]).to_numpy(zero_copy_only=False)
            yield from _with_sums(rows, weight, np.append(0, np.flatnonzero(new)), np.full(rows.num_rows, TaskContext.get().partitionId()))

    ranged = df.repartitionByRange(ranges, *part, *order)
    return _placed(shared_table(ranged.mapInArrow(own, _summed_schema(df, weight)), name), part, weight, name)


def _sorted(batches: list, by: list[str]) -> pa.RecordBatch | None:
    """All rows of a range at once, in order: there are not many."""
    rows = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if rows is None or not rows.num_rows:
        return None
    rows = rows.to_batches()[0]
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in by]))


def _with_sums(rows: pa.RecordBatch, weight: str, starts: np.ndarray, ranges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted rows with ``_own``, the sum of the weights before a row in its run, and the number of its range."""
    w = rows.column(weight).to_numpy()
    own = np.empty_like(w)
    for lo, hi in zip(starts, np.append(starts[1:], len(w))):
        own[lo:hi] = np.cumsum(np.append(w.dtype.type(0), w[lo:hi - 1]))
    out = pa.RecordBatch.from_arrays([*rows.columns, pa.array(own), pa.array(ranges.astype(np.int32))], [*rows.schema.names, "_own", "_range"])
    for lo in range(0, len(w), BATCH):
        yield out.slice(lo, BATCH)


def _summed_schema(df: DataFrame, weight: str) -> str:
    return ", ".join([*[f"`{c}` {kind}" for c, kind in df.dtypes], f"_own {dict(df.dtypes)[weight]}", "_range int"])


def _placed(dealt: DataFrame, part: list[str], weight: str, name: str) -> DataFrame:
    """Adds up the ranges' sums: ``before`` of every row from its ``_own`` and the earlier ranges of its ``part``."""
    by = [*part, "_range"]
    sums = dealt.groupBy(*by).agg(F.sum(weight).alias("_sum"))
    over = Window.partitionBy(*part).orderBy("_range") if part else Window.orderBy("_range")
    sums = sums.select(*by, F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(beside(sums, f"{name}-sums"), by).withColumn("before", F.col("_before") + F.col("_own")).drop("_before", "_own", "_range")


def _comparable(at, ask: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings and those to be looked up among them, as arrays that compare without Python where they can be."""
    at, values = np.asarray(at, dtype=object), ask.to_numpy(zero_copy_only=False)
    short = max(map(len, at), default=0) <= SHORT and (pc.max(pc.utf8_length(ask)).as_py() or 0) <= SHORT
    if not len(at) or not short or any("\0" in a for a in at) or pc.any(pc.match_substring(ask, "\0")).as_py():
        return at, values
    return at.astype("U"), values.astype("U")


def beside(df: DataFrame, name: str) -> DataFrame:
    """A table with a row for each of some (stratum, column), to be joined with their values: broadcast where it is
    small, so that the values of a few columns are not dealt to as few tasks."""
    held = shared_table(df, name)
    return F.broadcast(held) if held.limit(MOST_BESIDE + 1).count() <= MOST_BESIDE else held


# ------------------------------------------------------------------ fit

def _runs(points: Column, n: int) -> Column:
    """Quantile points without those inside a run of equal ones: (place on the grid, value)."""
    at = F.transform(points, lambda x, i: F.struct(i.cast("double").alias("i"), x.alias("x")))
    return F.filter(at, lambda e: (e["i"] == 0) | (e["i"] == n) | (e["x"] != F.get(points, e["i"].cast("int") - 1))
                    | (e["x"] != F.get(points, e["i"].cast("int") + 1)))


def fit_tables(base: DataFrame, columns: list[str], kinds: dict, discrete: dict, types: dict, condition: str | None,
               n_quantiles: int, accuracy: int) -> TableModel:
    """Fits ``base``: ``_g``, the stratum, and the columns as c0, c1, ... (numbers as double, categories as string)."""
    rows = base.withColumn("_key", stratum_key(F.col("_g"))).drop("_g")
    meta = {"kinds": kinds, "types": types, "discrete": discrete}
    few = min(FEW, n_quantiles, SMALL_VALUES)
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    above = shared_table(sizes.filter(F.col("n") > few), "large-strata")   # at most one in ``few`` rows
    many, inside = above.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = rows.count()
    large = {r["_key"]: r["n"] for r in above.collect()} if 0 < many <= MOST_STRATA else None
    named = F.when(F.col("_key") != "null", F.col("_key").substr(F.lit(2), F.length("_key"))).alias("stratum")
    held = ["_key", named, "n", "nulls", "points", "chol"]
    if not many and total:
        small = _fit_small(rows, columns, kinds, discrete, n_quantiles, total).select(*held, "_own", "_range")
        strata = _placed(shared_table(small, "fitted-strata"), [], "n", "fitted-strata")
        return TableModel(columns, strata, _no_values(rows.sparkSession), condition, n_quantiles, meta)
    if inside == total:
        strata, values = _fit_large(rows, columns, kinds, discrete, n_quantiles, accuracy, large)
    else:
        above = above.select("_key")
        strata, values = _fit_large(rows.join(above, "_key", "left_semi"), columns, kinds, discrete, n_quantiles, accuracy, large)
        strata = strata.unionByName(_fit_small(rows.join(above, "_key", "left_anti"), columns, kinds, discrete, n_quantiles, total - inside).drop("_own", "_range"))
    return TableModel(columns, shared_table(strata.select(*held), "fitted-strata"), values, condition, n_quantiles, meta)


def _no_values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "_key string, column int, x double, s string, n bigint, before bigint")


def count_values(rows: DataFrame, by: str, columns: list[int], categorical: set) -> DataFrame:
    """(``by``, column, x, s, n): how often each value of the columns c0, c1, ... occurs; numbers in x, categories in s."""
    none = {"x": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}
    long = rows.select(by, F.inline(F.array(*[F.struct(
        F.lit(i).alias("column"), *[(F.col(f"c{i}") if (i in categorical) == (at == "s") else none[at]).alias(at) for at in none]) for i in columns])))
    return long.filter("x IS NOT NULL OR s IS NOT NULL").groupBy(by, "column", "x", "s").agg(F.count(F.lit(1)).alias("n"))


def _ranked_values(rows: DataFrame, columns: list[int], categorical: set, sizes_of: dict) -> DataFrame:
    """As ``count_values`` with ``before``, the counts of a column's smaller values, for few strata: values are counted in
    the batches of each task, dealt by ranges of values that a sample of the rows bounds, added up and sorted there."""
    n = sum(sizes_of.values())
    picked = rows.select("_key", *[f"c{i}" for i in columns]).sample(min(1.0, max(SAMPLED / n, SAMPLED_RANGE / RANGE)), seed=1).limit(MOST_SAMPLED).toPandas()
    bounds, first, owners = {}, {}, []
    for key in sorted(sizes_of):   # ranges that follow each other for each column of a stratum
        mine = picked[picked["_key"] == key]
        for i in columns:
            v = sorted(set(mine[f"c{i}"].dropna()))   # the value that starts each range but the first
            step = max(1, round(RANGE * max(len(mine), 1) / sizes_of[key]))
            bounds[key, i], first[key, i] = v[step::step], len(owners)
            owners += [(key, i)] * (len(bounds[key, i]) + 1)
    held = rows.sparkSession.sparkContext.broadcast((bounds, first, owners))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, first, _ = held.value

        def counts(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for key in pc.unique(table.column("_key")).to_pylist():
                mine = table.filter(pc.equal(table.column("_key"), key)) if len(sizes_of) > 1 else table
                for i in columns:
                    v, m = pc.value_counts(mine.column(f"c{i}").combine_chunks().drop_null()).flatten()
                    if not len(v):
                        continue
                    at, ask = _comparable(bounds[key, i], v) if i in categorical else (np.asarray(bounds[key, i], dtype=float), v.to_numpy())
                    ranges = first[key, i] + np.searchsorted(at, ask, "right")
                    x, s = (pa.nulls(len(v), pa.float64()), v) if i in categorical else (v, pa.nulls(len(v), pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), x, s, m], ["range", "x", "s", "n"])

        some, have = [], 0
        for batch in batches:
            some.append(batch)
            have += batch.num_rows
            if have >= RANGE:
                yield from counts(pa.Table.from_batches(some))
                some, have = [], 0
        if have:
            yield from counts(pa.Table.from_batches(some))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, batches = held.value[2], list(batches)
        t = pa.Table.from_batches(batches).combine_chunks() if batches else None
        if t is None or not t.num_rows:
            return
        t = t.group_by(["range", "x", "s"]).aggregate([("n", "sum")]).rename_columns(["range", "x", "s", "n"])
        t = _sorted(t.to_batches(), ["range", "x", "s"])
        at = t.column("range").to_numpy()
        keys, which = (pa.array([o[j] for o in owners], kind).take(t.column("range")) for j, kind in ((0, pa.string()), (1, pa.int32())))
        t = pa.RecordBatch.from_arrays([keys, which, *t.columns[1:]], ["_key", "column", "x", "s", "n"])
        yield from _with_sums(t, "n", np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1), at)

    parts = rows.select("_key", *[f"c{i}" for i in columns]).mapInArrow(counted, "range int, x double, s string, n bigint")
    schema = "_key string, column int, x double, s string, n bigint, _own bigint, _range int"
    dealt = shared_table(parts.repartition(len(owners), "range").mapInArrow(added, schema), "ranked")
    return _placed(dealt, ["_key", "column"], "n", "ranked")


def _fit_large(rows: DataFrame, columns: list[str], kinds: dict, discrete: dict, n_quantiles: int, accuracy: int,
               sizes_of: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(strata, values) by aggregates per stratum.  ``sizes_of``: rows by stratum, where the strata are few."""
    k = len(columns)
    cat = [i for i, c in enumerate(columns) if kinds[c] == "categorical"]
    counted = [i for i, c in enumerate(columns) if kinds[c] == "categorical" or discrete[c]]
    smooth = [i for i in range(k) if i not in counted]
    probs = [i / n_quantiles for i in range(n_quantiles + 1)]
    none = F.array().cast(POINTS)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count(f"c{i}").alias(f"m{i}") for i in range(k)]]
    aggs += [F.percentile_approx(f"c{i}", probs, accuracy).alias(f"q{i}") for i in smooth]
    one = rows.groupBy("_key").agg(*aggs)
    runs = [F.struct(F.lit(i).alias("column"), F.lit(False).alias("large"), _runs(F.col(f"q{i}"), n_quantiles).alias("r")) for i in smooth]
    points = F.transform(F.filter(F.array(*runs), lambda e: e["r"].isNotNull()), lambda e: F.struct(
        e["column"], e["large"], e["r"]["x"].alias("x"), F.lit(None).cast("array<string>").alias("s"),
        e["r"]["i"].alias("upto"))) if smooth else none
    nulls = F.array(*[1 - F.col(f"m{i}") / F.col("n") for i in range(k)])
    strata = one.select("_key", "n", nulls.alias("nulls"), points.cast(POINTS).alias("points"))
    if counted:
        if sizes_of is None:
            vc = shared_table(count_values(rows, "_key", counted, set(cat)), "value-counts")
        else:
            vc = _ranked_values(rows, counted, set(cat), sizes_of)
        sizes = beside(vc.groupBy("_key", "column").agg(F.count(F.lit(1)).alias("_many"), F.sum("n").alias("_total")), "value-sizes")
        sized = vc.join(sizes, ["_key", "column"])
        by = Window.partitionBy("_key", "column").orderBy("x", "s")
        few = sized.filter(F.col("_many") <= SMALL_VALUES).withColumn("upto", F.sum("n").over(by).cast("double"))
        few = few.groupBy("_key", "column").agg(F.sort_array(F.collect_list(F.struct("x", "s", "upto"))).alias("e"))
        few = few.select("_key", "column", F.lit(False).alias("large"), *[F.col(f"e.{c}").alias(c) for c in ("x", "s", "upto")])
        many = sized.filter(F.col("_many") > SMALL_VALUES).drop("_many")
        n_many = sizes.filter(F.col("_many") > SMALL_VALUES).agg(F.sum("_many")).first()[0] or 0
        ranked = running(many, ["_key", "column"], ["x", "s"], "n", "ranked", count=n_many) if sizes_of is None else many
        values = ranked.select("_key", "column", "x", "s", "n", "before")
        # for the scores: the values at evenly spaced ranks
        step = (F.col("_total") - 1) / F.lit(float(n_quantiles))
        first, last = F.ceil(F.col("before") / step), F.least(F.floor((F.col("before") + F.col("n") - 1) / step), F.lit(n_quantiles))
        grid = ranked.filter(first <= last).select("_key", "column", "x", "s", F.explode(F.sequence(first, last)).alias("i"))
        grid = grid.groupBy("_key", "column").agg(F.sort_array(F.collect_list(F.struct("i", "x", "s"))).alias("e"))
        grid = grid.select("_key", "column", F.lit(True).alias("large"), F.col("e.x").alias("x"), F.col("e.s").alias("s"),
                           F.col("e.i").cast("array<double>").alias("upto"))
        more = few.unionByName(grid).groupBy("_key").agg(F.collect_list(F.struct("column", "large", "x", "s", "upto")).alias("more"))
        strata = strata.join(more, "_key", "left").select("_key", "n", "nulls", F.concat(
            "points", F.coalesce(F.col("more").cast(POINTS), none)).alias("points"))
    else:
        values = _no_values(rows.sparkSession)
    strata = shared_table(strata, "strata")
    chol = _factors(_score_sums(rows, strata, columns, kinds, n_quantiles), k)
    identity = F.array(*[F.lit(float(i == j)) for i in range(k) for j in range(k)])
    return strata.join(chol, "_key", "left").withColumn("chol", F.coalesce("chol", identity)), values


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def _fit_small(rows: DataFrame, columns: list[str], kinds: dict, discrete: dict, n: int, total: int) -> DataFrame:
    """Strata of few rows, as ``_fit_large`` gives them: ``total`` rows sorted by stratum, whole strata of a batch at a
    time.  ``_own`` and ``_range`` as ``running`` has them: the strata come out in the order of their keys."""
    k = len(columns)
    categorical = [kinds[c] == "categorical" for c in columns]
    smooth = [not categorical[i] and not discrete[c] for i, c in enumerate(columns)]
    grid: dict = {}   # values of a column -> first and last place on the grid of quantiles for each rank

    def places(m: int) -> tuple[np.ndarray, np.ndarray]:
        if m not in grid:
            ranks = np.maximum(np.ceil(np.arange(n + 1) / n * m), 1)
            each = np.arange(1, m + 1)
            grid[m] = np.searchsorted(ranks, each, "left"), np.searchsorted(ranks, each, "right") - 1
        return grid[m]

    def distribution(i: int, v: pa.Array, g: np.ndarray, many: int):
        """A column's scores (from 0 to 1), missing cells, and entries of each stratum: (counts, values, places)."""
        ok = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
        u, of = np.full(len(v), 0.5), g[ok]
        if categorical[i]:
            coded = v.dictionary_encode()
            names = coded.dictionary.to_pylist()
            by_name = sorted(range(len(names)), key=names.__getitem__)
            rank = np.empty(len(names), dtype=np.int64)
            rank[by_name] = np.arange(len(names))
            x = rank[coded.indices.take(pa.array(ok)).to_numpy(zero_copy_only=False)] if len(ok) else np.zeros(0, dtype=np.int64)
        else:
            x = v.to_numpy(zero_copy_only=False)[ok]
        order = np.lexsort((x, of))
        of, x = of[order], x[order]
        new = np.append(True, (of[1:] != of[:-1]) | (x[1:] != x[:-1]))[:len(of)]
        runs = np.flatnonzero(new)
        have = np.bincount(of, minlength=many)
        base, run_of = (np.cumsum(have) - have)[of[runs]], of[runs]
        before, upto = runs - base, np.append(runs[1:], len(of)) - base
        total, value = have[run_of], x[runs]
        if smooth[i]:
            first, last = np.empty(len(runs), dtype=np.int64), np.empty(len(runs), dtype=np.int64)
            for m in np.unique(total):
                at = total == m
                lo, hi = places(int(m))
                first[at], last[at] = lo[before[at]], hi[upto[at] - 1]
            score = np.clip((first + last + 1) / (2.0 * (n + 1)), 0.5 / (n + 1), 1 - 0.5 / (n + 1))
            twice = 1 + (last > first)
            ends = np.cumsum(twice)
            at = np.repeat(first, twice)
            at[ends - 1] = last
            entries = np.bincount(run_of, weights=twice, minlength=many).astype(np.int64), pa.array(np.repeat(value, twice)), at
        else:
            score = (before + upto) / 2 / total
            value = pa.array(names, pa.string()).take(pa.array(np.asarray(by_name, dtype=np.int64)[value])) if categorical[i] else pa.array(value)
            entries = np.bincount(run_of, minlength=many), value, upto
        u[ok[order]] = score[np.cumsum(new) - 1]
        return u, 1 - have, entries

    def points(entries: list, many: int) -> pa.ListArray:
        structs, owners = [], []
        for i, (counts, value, upto) in enumerate(entries):
            held = np.flatnonzero(counts)
            here, size = counts[held], len(held)
            none = lambda t: pa.nulls(size, pa.list_(t))
            of = _lists(here, value)
            structs.append(pa.StructArray.from_arrays(
                [pa.array(np.full(size, i), pa.int32()), pa.array(np.zeros(size, dtype=bool)), none(pa.float64()) if categorical[i] else of,
                 of if categorical[i] else none(pa.string()), _lists(here, pa.array(upto.astype(np.float64)))],
                ["column", "large", "x", "s", "upto"]))
            owners.append(held)
        owner = np.concatenate(owners)
        return _lists(np.bincount(owner, minlength=many), pa.concat_arrays(structs).take(pa.array(np.argsort(owner, kind="stable"))))

    def fitted(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        many, lengths = len(starts), np.diff(np.append(starts, t.num_rows))
        g = np.repeat(np.arange(many), lengths)
        found = [distribution(i, t.column(f"c{i}").combine_chunks(), g, many) for i in range(k)]
        z = norm_ppf(np.stack([u for u, _, _ in found], axis=1))
        mean = np.add.reduceat(z, starts, axis=0) / lengths[:, None]
        cov = np.empty((many, k, k))
        for a in range(k):
            for b in range(a, k):
                cov[:, a, b] = cov[:, b, a] = np.add.reduceat(z[:, a] * z[:, b], starts) / lengths - mean[:, a] * mean[:, b]
        chol = _cholesky_of(cov)
        chol[lengths < 2] = np.eye(k)
        nulls = np.stack([1 - (1 - lost) / lengths for _, lost, _ in found], axis=1)
        flat = lambda m: _lists(np.full(many, m.size // many), pa.array(m.ravel()))
        return pa.RecordBatch.from_arrays([t.column("_key").combine_chunks().take(pa.array(starts)), pa.array(lengths, pa.int64()), flat(nulls),
                                           points([e for _, _, e in found], many), flat(chol)], ["_key", "n", "nulls", "points", "chol"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, so_far, here = None, 0, TaskContext.get().partitionId()   # rest: the last stratum, which may go on

        def placed(found: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal so_far
            n = found.column("n").to_numpy()
            own, so_far = so_far + np.cumsum(n) - n, so_far + int(n.sum())
            return pa.RecordBatch.from_arrays([*found.columns, pa.array(own), pa.array(np.full(len(n), here, dtype=np.int32))],
                                              [*found.schema.names, "_own", "_range"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if t.num_rows:
                keys = t.column("_key").combine_chunks()
                starts = np.append(0, np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1)
                rest = t.slice(starts[-1])
                if len(starts) > 1:
                    yield placed(fitted(t.slice(0, starts[-1]), starts[:-1]))
        if rest is not None and rest.num_rows:
            yield placed(fitted(rest, np.array([0])))

    by_key = rows.select("_key", *[f"c{i}" for i in range(k)]).repartitionByRange(max(1, -(-total // MERGED)), "_key").sortWithinPartitions("_key")
    return by_key.mapInArrow(fit, f"_key string, n bigint, nulls array<double>, points {POINTS}, chol array<double>, _own bigint, _range int")


def _cholesky_of(cov: np.ndarray) -> np.ndarray:
    """Cholesky factors of the correlations of many covariances of scores."""
    from tabfid.operators.synth import _cholesky

    k = cov.shape[1]
    d = np.sqrt(np.clip(np.diagonal(cov, axis1=1, axis2=2), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.nan_to_num(cov / (d[:, :, None] * d[:, None, :]), nan=0.0, posinf=0.0, neginf=0.0)
    c[:, np.arange(k), np.arange(k)] = 1.0
    return _cholesky(np.clip(c, -1.0, 1.0))


def _read(points) -> dict:
    """Distribution of each column of a stratum from its row."""
    out = {}
    for e in points:
        f = lambda c: None if e[c] is None else np.asarray(e[c])
        out[e["column"]] = (e["large"], f("x"), f("s"), f("upto"))
    return out


def _score(dist, v: pa.Array, smooth: bool, categorical: bool, n: int) -> np.ndarray:
    """Middle of the ranks that each of a column's values takes, from 0 to 1; missing values lie at 0.5."""
    large, x, s, upto = dist
    if categorical:   # equal strings are looked up once
        v = v.dictionary_encode()
        missing = v.indices.is_null().to_numpy(zero_copy_only=False)
        which = v.indices.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(v.dictionary):
            return np.full(len(v), 0.5)
        at, ask = _comparable(s, v.dictionary)
    else:
        ask = v.to_numpy(zero_copy_only=False)
        missing, which, at = np.isnan(ask), slice(None), x
    if smooth or large:   # places on the grid of quantiles
        lo, hi = np.searchsorted(at, ask, "left"), np.searchsorted(at, ask, "right")
        first = np.append(upto, n + 1)[lo]
        last = np.where(hi > 0, upto[np.maximum(hi - 1, 0)] + 1, 0)
        u = np.clip((first + last) / (2.0 * (n + 1)), 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    else:
        i = np.minimum(np.searchsorted(at, ask), len(at) - 1)
        u = (upto[i] + np.where(i > 0, upto[i - 1], 0)) / 2 / upto[-1]
    return np.where(missing, 0.5, u[which])


def _score_sums(rows: DataFrame, strata: DataFrame, columns: list[str], kinds: dict, n_quantiles: int) -> DataFrame:
    """(_key, i, v): partial sums 1, z, z z^T of the normal scores of every stratum, as one upper triangle."""
    k = len(columns)
    categorical = [kinds[c] == "categorical" for c in columns]
    upper = np.triu_indices(k + 1)

    def ready(points) -> list:
        """(column, distribution, whether it is a grid of quantiles) of a stratum."""
        return [(i, d, not categorical[i] and d[3][0] == 0 and not d[0]) for i, d in _read(points).items()]

    def products(u: np.ndarray) -> np.ndarray:
        z = np.hstack([np.ones((len(u), 1)), norm_ppf(u)])
        return (z.T @ z)[upper]

    def listed(keys: pa.Array, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, _lists(np.full(len(sums), len(upper[0])), pa.array(np.concatenate(sums)))], ["_key", "sums"])

    def summed(sums: DataFrame) -> DataFrame:
        return sums.select("_key", F.posexplode("sums").alias("i", "v")).groupBy("_key", "i").agg(F.sum("v").alias("v"))

    heads = strata.select("_key", "points").limit(MOST_STRATA + 1).collect()
    if len(heads) <= MOST_STRATA:   # at most SMALL_VALUES or n_quantiles values of a column each
        known = rows.sparkSession.sparkContext.broadcast({r["_key"]: [e.asDict() for e in r["points"]] for r in heads})

        def add_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dists, total = {key: ready(points) for key, points in known.value.items()}, {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                coded = batch.column("_key").dictionary_encode()
                of = coded.indices.to_numpy()
                for at, key in enumerate(coded.dictionary.to_pylist()):
                    mine = batch if len(coded.dictionary) == 1 else batch.filter(pa.array(of == at))
                    u = np.full((mine.num_rows, k), 0.5)
                    for i, d, smooth in dists[key]:
                        u[:, i] = _score(d, mine.column(f"c{i}"), smooth, categorical[i], n_quantiles)
                    total[key] = total.get(key, 0.0) + products(u)
            if total:
                yield listed(pa.array(total.keys(), pa.string()), list(total.values()))

        return summed(rows.select("_key", *[f"c{i}" for i in range(k)]).mapInArrow(add_here, "_key string, sums array<double>"))
    parts = strata.select("_key", F.floor((F.col("n") - 1) / PART).cast("long").alias("_parts"))
    big = parts.filter("_parts > 0")  # at most one stratum in PART rows
    dealt = rows.join(big, "_key", "left").withColumn(
        "_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(0)) + 1)).drop("_parts")
    empty = F.lit(None).cast(POINTS)
    tagged = dealt.select("_key", "_part", F.lit(1).alias("_tag"), empty.alias("points"), *[f"c{i}" for i in range(k)])
    heads = strata.select("_key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART).cast("long"))).alias("_part"),
                          F.lit(0).alias("_tag"), "points",
                          *[F.lit(None).cast(rows.schema[f"c{i}"].dataType).alias(f"c{i}") for i in range(k)])
    merged = tagged.unionByName(heads).repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_tag")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dists = []
        for batch in batches:
            tags = batch.column("_tag").to_numpy()
            heads_at = np.flatnonzero(tags == 0)
            points = dict(zip(heads_at.tolist(), batch.column("points").take(pa.array(heads_at)).to_pylist()))   # null elsewhere
            bounds = [*([] if len(heads_at) and heads_at[0] == 0 else [-1]), *heads_at.tolist(), len(tags)]
            at, sums = [], []
            for head, hi in zip(bounds, bounds[1:]):
                if head >= 0:
                    dists = ready(points[head])
                lo = head + 1
                if lo < hi:
                    u = np.full((hi - lo, k), 0.5)
                    for i, d, smooth in dists:
                        u[:, i] = _score(d, batch.column(f"c{i}").slice(lo, hi - lo), smooth, categorical[i], n_quantiles)
                    at.append(lo)
                    sums.append(products(u))
            if at:
                yield listed(batch.column("_key").take(pa.array(at)), sums)

    return summed(merged.mapInArrow(add, "_key string, sums array<double>"))


def _factors(sums: DataFrame, k: int) -> DataFrame:
    """(_key, chol): Cholesky factor, row by row, of each stratum's correlation of scores."""
    upper = np.triu_indices(k + 1)

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m = np.zeros((len(batch), k + 1, k + 1))
                m[:, upper[0], upper[1]] = [[e["v"] for e in v] for v in batch["v"]]
                n = m[:, 0, 0]
                mean, prod = m[:, 0, 1:] / n[:, None], m[:, 1:, 1:]
                cov = (prod + np.triu(prod, 1).swapaxes(1, 2)) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
                chol = _cholesky_of(cov)
                chol[n < 2] = np.eye(k)
                yield pd.DataFrame({"_key": batch["_key"], "chol": list(chol.reshape(len(batch), -1))})

    lists = sums.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v"))
    return lists.mapInPandas(factor, "_key string, chol array<double>")


# ------------------------------------------------------------------ sample

def proportional_quota(model: TableModel, total: int) -> DataFrame:
    """(stratum, rows): ``total`` rows in proportion to the fitted rows, each within one of its share.  Where the model has
    its strata in order, these are its own rows with their quota and first row id, so that ``sample_tables`` need not join them."""
    ordered = "before" in model.strata.columns
    s = model.strata if ordered else running(model.strata.select("_key", "stratum", "n"), [], ["_key"], "n", "quota")
    all_rows = model.strata.agg(F.sum("n")).first()[0] or 1
    upto = lambda c: F.floor(c.cast("decimal(38,0)") * F.lit(total) / F.lit(all_rows)).cast("long")
    rows, start = (upto(F.col("before") + F.col("n")) - upto(F.col("before"))).alias("rows"), upto(F.col("before")).alias("before")
    if not ordered:
        return s.select("stratum", rows)
    quota = s.select("stratum", rows, start, "_key", "n", "nulls", "chol", "points")
    quota._strata_of = model   # lost by any change of the table
    return quota


def _mass_buckets(values: DataFrame, weight: Column | None, want: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of every (stratum, column): its header (total, buckets, width of one, number of the first among all), the entries
    (column, bucket, x, s, sum of weights up to it) in all its buckets, and the number of values.  ``weight``: None for
    the counts, whose running sums the model has.  ``want``: (_key, rows) to draw."""
    part = ["_key", "column"]
    if weight is None:
        run = values.withColumn("_w", F.col("n"))
        if "before" not in values.columns:   # saved before models had it
            run = running(run, part, ["x", "s"], "_w", "cumulative")
    else:
        run = running(values.drop("before").withColumn("_w", weight), part, ["x", "s"], "_w", "cumulative")
    run = run.select(*part, "x", "s", F.col("before").cast("double").alias("before"), (F.col("before") + F.col("_w")).cast("double").alias("upto"))
    header = run.groupBy(*part).agg(F.max("upto").alias("total"), F.count(F.lit(1)).alias("many"))
    header = header.join(want.select("_key", "rows"), "_key").withColumn(
        "buckets", F.ceil(F.greatest(F.col("total"), F.col("rows").cast("double")) / WIDE))
    header = running(header, [], part, "buckets", "headers").withColumnRenamed("before", "first")
    header = beside(header.select(*part, "total", "many", "buckets", "first", (F.col("total") / F.col("buckets")).alias("width")), "numbered-headers")
    # a value also goes to the bucket that starts where it ends, in case a draw is rounded up to there
    in_bucket = lambda c: F.least(F.floor(F.col(c) / F.col("width")), F.col("buckets") - 1)
    entries = run.join(header, part).select("column", "x", "s", "upto", "first", F.explode(F.sequence(in_bucket("before"), in_bucket("upto"))).alias("b"))
    return header, entries.select("column", "x", "s", "upto", (F.col("first") + F.col("b")).alias("b")), int(header.agg(F.sum("many")).first()[0] or 0)


def _looked_up(out: DataFrame, entries: DataFrame, i: int, categorical: bool, tasks: int) -> DataFrame:
    """``out`` with c{i} of the rows with a bucket b{i} from the entries there: the first above the place r{i}, or else
    the last.  A task takes the draws and the entries of a few buckets."""
    rest = [c for c in out.columns if c not in (f"c{i}", f"r{i}", f"b{i}")]
    kinds, own = dict(out.dtypes), "s" if categorical else "x"
    draws = out.select(F.lit(True).alias("_drawn"), F.col(f"b{i}").alias("_bucket"), F.col(f"r{i}").alias("_place"), f"c{i}", *rest)
    listed = entries.filter(F.col("column") == i).select(F.lit(False).alias("_drawn"), F.col("b").alias("_bucket"), F.col("upto").alias("_place"),
                                                         F.col(own).alias(f"c{i}"), *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])
    merged = draws.unionByName(listed).repartition(tasks, "_bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        t = pa.Table.from_batches(batches) if batches else None
        if t is None or not t.num_rows:
            return
        drawn = t.column("_drawn")
        held, t = t.filter(pc.invert(drawn)).combine_chunks(), t.filter(drawn).combine_chunks()
        if not t.num_rows:
            return
        at, top = held.column("_bucket").to_numpy(), held.column("_place").to_numpy()
        order = np.lexsort((top, at))
        at, top = at[order], top[order]
        bucket, place = t.column("_bucket").to_numpy(), t.column("_place").to_numpy()
        asked = np.flatnonzero(bucket >= 0)
        asked = asked[np.argsort(bucket[asked], kind="stable")]
        of = bucket[asked]
        hit = np.empty(len(asked), dtype=np.int64)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
        for a, b in zip(starts, [*starts[1:], len(of)]):
            lo, hi = np.searchsorted(at, of[a], "left"), np.searchsorted(at, of[a], "right")
            hit[a:b] = lo + np.minimum(np.searchsorted(top[lo:hi], place[asked[a:b]], "right"), hi - lo - 1)
        value = t.column(f"c{i}").combine_chunks()
        pick = np.arange(len(value))
        pick[asked] = len(value) + order[hit]
        value = pa.chunked_array([value, held.column(f"c{i}").combine_chunks()]).combine_chunks().take(pa.array(pick))
        found = pa.RecordBatch.from_arrays([value, *[t.column(c).combine_chunks() for c in rest]], [f"c{i}", *rest])
        for lo in range(0, found.num_rows, BATCH):
            yield found.slice(lo, BATCH)

    return merged.mapInArrow(find, ", ".join(f"`{c}` {kinds[c]}" for c in [f"c{i}", *rest]))


def sample_tables(spark: SparkSession, model: TableModel, quota: int | dict | DataFrame, seed: int = 42,
                  temperature: float | None = None) -> DataFrame:
    """Rows of the model: ``quota`` is a number of rows (no condition), or the rows of each stratum as a dict or a table
    (stratum, rows).  Columns are the condition and the fitted columns as Python leaves them."""
    from tabfid.operators.synth import TEMPERATURE_ARGMAX

    columns, kinds, k = model.columns, model.meta["kinds"], len(model.columns)
    categorical = [kinds[c] == "categorical" for c in columns]
    own = getattr(quota, "_strata_of", None) is model
    if isinstance(quota, int):
        if model.condition is not None:
            raise ValueError("give the rows of each stratum")
        quota = {"__all__": quota}
    if isinstance(quota, dict):
        listed = [(None if s is None else str(s), int(n), i) for i, (s, n) in enumerate(quota.items())]
        quota = spark.createDataFrame(pd.DataFrame(listed, columns=["stratum", "rows", "_at"]), "stratum string, rows bigint, _at int")
    elif not own:
        quota = quota.withColumn("_at", F.lit(0))
    if own:
        want = quota.filter("rows > 0")
    else:
        want = quota.select(stratum_key(F.col("stratum")).alias("_key"), F.col("rows").cast("long").alias("rows"), "_at").filter("rows > 0")
        want = running(want, [], ["_at", "_key"], "rows", "wanted").drop("_at")
    asked = want.agg(F.sum("rows")).first()[0] or 0
    tasks = min(max(-(-asked // (2 * BLOCK)), 1), MOST_TASKS)
    strata = model.strata.drop("before")
    lost = [] if own else want.join(strata, "_key", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"no fitted stratum for {[r['_key'] for r in lost]}")

    large = [] if "before" in model.strata.columns else sorted(   # strata of few rows have few values
        r[0] for r in strata.select(F.explode("points").alias("p")).filter("p.large").select("p.column").distinct().collect())
    values = model.values
    if not large:
        weight = None
    elif temperature is not None and temperature <= TEMPERATURE_ARGMAX:  # categories take their mode
        cats = [i for i in large if categorical[i]]
        modes = values.filter(F.col("column").isin(cats)).groupBy("_key", "column").agg(
            F.min(F.struct((-F.col("n")).alias("n"), "s")).alias("m"))
        modes = modes.groupBy("_key").agg(F.collect_list(F.struct(
            "column", F.lit(False).alias("large"), F.lit(None).cast("array<double>").alias("x"), F.array("m.s").alias("s"),
            F.array(F.lit(1.0)).alias("upto"))).alias("_modes"))
        strata = strata.join(modes, "_key", "left").withColumn("points", F.concat(
            F.filter("points", lambda p: ~(p["large"] & p["column"].isin(cats))) if cats else F.col("points"),
            F.coalesce(F.col("_modes").cast(POINTS), F.array().cast(POINTS)))).drop("_modes")
        large = [i for i in large if not categorical[i]]
        values = values.filter(~F.col("column").isin(cats))
        weight = None
    elif temperature is not None:
        weight = F.when(F.col("column").isin([i for i in large if categorical[i]]), F.pow(F.col("n"), F.lit(1.0 / temperature))
                        ).otherwise(F.col("n").cast("double"))
    else:
        weight = None
    no_heads = F.array().cast("array<struct<column:int,total:double,width:double,buckets:bigint,first:bigint>>")
    if large:
        header, entries, many_values = _mass_buckets(values, weight, want)
        heads = header.groupBy("_key").agg(F.collect_list(F.struct("column", "total", "width", "buckets", "first")).alias("heads"))
        strata = strata.join(heads, "_key", "left").withColumn("heads", F.coalesce("heads", no_heads))
    else:
        strata, want = strata.withColumn("heads", no_heads), want.withColumn("heads", no_heads) if own else want

    blocks = want if own else want.join(strata, "_key")
    blocks = blocks.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / BLOCK))))
    blocks = blocks.select("_key", "stratum", "nulls", "chol", "points", "heads", (F.col("before") + F.col("b") * BLOCK).alias("start"),
                           F.least(F.col("rows") - F.col("b") * BLOCK, F.lit(BLOCK)).cast("int").alias("len"))
    if not own or asked > MUCH * (want.agg(F.sum("n")).first()[0] or 0):
        # a given number: few small rows make much work, and would else be read by a single task
        blocks = blocks.repartition(tasks, "_key", "start")
    types = ["string" if categorical[i] else "double" for i in range(k)]
    schema = "_key string, _stratum string, " + ", ".join(f"c{i} {t}" for i, t in enumerate(types)) + "".join(
        f", r{i} double, b{i} bigint" for i in large)
    n_q = model.n_quantiles

    def upto_one(upto: np.ndarray, lo: np.ndarray, hi: np.ndarray, cat: np.ndarray) -> np.ndarray:
        """Cumulative counts of each list [lo, hi) as shares, those of categories (``cat``) at the temperature."""
        size = hi - lo
        if temperature is None or not cat.any():
            return upto / np.repeat(upto[hi[size > 0] - 1], size[size > 0])
        out = upto_one(upto, lo, hi, np.zeros(len(lo), dtype=bool))
        lo, size = lo[cat & (size > 0)], size[cat & (size > 0)]
        if not len(lo):
            return out
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        starts = np.cumsum(size) - size
        n = np.diff(upto[at], prepend=0.0)
        n[starts] = upto[lo]
        if temperature <= TEMPERATURE_ARGMAX:   # the first of the largest
            inside = np.arange(len(at)) - np.repeat(starts, size)
            top = np.where(n == np.repeat(np.maximum.reduceat(n, starts), size), inside, len(at))
            out[at] = inside >= np.repeat(np.minimum.reduceat(top, starts), size)
            return out
        w = np.power(n / np.repeat(upto[lo + size - 1], size), 1.0 / temperature)
        for j in range(1, size.max()):   # place by place, so that a list's sums do not depend on its neighbours
            more = starts[size > j] + j
            w[more] += w[more - 1]
        out[at] = w / np.repeat(w[starts + size - 1], size)
        return out

    def above(sorted_lists: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
        """First place in each list [lo, hi) with an entry above q, else hi."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            up = sorted_lists[mid] > q[open_]
            hi[open_[up]], lo[open_[~up]] = mid[up], mid[~up] + 1
        return lo

    def by_column(lists: pa.ListArray, many: int) -> tuple[list[np.ndarray], list[pa.Array]]:
        """Of each column the struct of every row (or -1), and the structs' fields."""
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        owner, fields = np.repeat(np.arange(many), sizes), flat.flatten()
        which = fields[0].to_numpy(zero_copy_only=False)
        at = np.full((k, many), -1)
        at[which, owner] = np.arange(len(which))
        return list(at), fields

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.num_rows
            if not many:
                continue
            start, length = (batch.column(c).to_numpy().astype(np.int64) for c in ("start", "len"))
            nulls, chol = (batch.column(c).flatten().to_numpy().reshape(many, *s) for c, s in (("nulls", (k,)), ("chol", (k, k))))
            at, (which, large_, x, s, upto) = by_column(batch.column("points"), many)
            held, (_, *head) = by_column(batch.column("heads"), many)
            (total, width, buckets_, first_), large_ = (c.to_numpy() for c in head), large_.to_numpy(zero_copy_only=False)
            (x_at, x), (s_at, s), (u_at, upto) = [(c.offsets.to_numpy().astype(np.int64), c.values) for c in (x, s, upto)]
            x, upto = x.to_numpy(zero_copy_only=False), upto.to_numpy(zero_copy_only=False)
            upto, u_at = upto[u_at[0]:u_at[-1]], u_at - u_at[0]
            cum = upto_one(upto, u_at[:-1], u_at[1:], np.isin(which.to_numpy(), [i for i in range(k) if categorical[i]]) & ~large_)
            ends = np.cumsum(length)
            for lo in range(0, int(ends[-1]), BATCH):
                pos = np.arange(lo, min(lo + BATCH, ends[-1]))
                of = np.searchsorted(ends, pos, "right")
                ids = start[of] + pos - (ends - length)[of]
                free = normals(ids, k, seed)
                holes = uniforms(ids, k, seed + 1_000_003) < nulls[of]
                out = [batch.column(c).take(pa.array(of)) for c in ("_key", "stratum")]
                rest = []
                for i in range(k):
                    u = norm_cdf(sum(chol[of, i, j] * free[:, j] for j in range(i + 1)))
                    e = at[i][of]
                    is_large = (e >= 0) & large_[e] if len(large_) else np.zeros(len(e), dtype=bool)
                    got = np.flatnonzero((e >= 0) & ~is_large & ~holes[:, i])
                    e, q = e[got], u[got]
                    first, last = u_at[e], u_at[e + 1]
                    if categorical[i]:
                        pick = np.full(len(ids), -1)
                        pick[got] = s_at[e] + np.minimum(above(cum, first, last, q), last - 1) - first
                        out.append(s.take(pa.array(pick, mask=pick < 0)))
                    else:
                        value, grid = np.full(len(ids), np.nan), upto[first] == 0   # quantile points: places on the grid
                        hit = np.where(grid, above(upto, first, last, q * n_q), above(cum, first, last, np.where(grid, np.inf, q)))
                        right = np.minimum(hit, last - 1)
                        left = np.where(grid & (hit < last), right - 1, right)
                        to_x = x_at[e] - first
                        with np.errstate(divide="ignore", invalid="ignore"):
                            slope = (x[to_x + right] - x[to_x + left]) / (upto[right] - upto[left])
                        value[got] = np.where(right > left, slope * (q * n_q - upto[left]), 0.0) + x[to_x + left]
                        out.append(pa.array(value))
                    if i in large:
                        h = held[i][of]
                        ask = is_large & (h >= 0) & ~holes[:, i]
                        places, buckets = np.full(len(ids), np.nan), -1 - ids   # without a place: a bucket that matches nothing
                        t, h = total[h[ask]], h[ask]
                        places[ask] = np.minimum(u[ask] * t, np.nextafter(t, 0))
                        buckets[ask] = first_[h] + np.minimum(np.floor(places[ask] / width[h]), buckets_[h] - 1).astype(np.int64)
                        rest.append((pa.array(places), pa.array(buckets)))
                names = ["_key", "_stratum", *[f"c{i}" for i in range(k)]]
                for i, (r, b) in zip(large, rest):
                    out, names = [*out, r, b], [*names, f"r{i}", f"b{i}"]
                yield pa.RecordBatch.from_arrays(out, names)

    out = blocks.mapInArrow(generate, schema).drop("_key", *([] if model.condition is not None else ["_stratum"]))
    for i in large:
        out = _looked_up(out, entries, i, categorical[i], min(max(-(-(asked + many_values) // MERGED), 1), MOST_TASKS))
    named = [F.col("_stratum").alias(model.condition)] if model.condition is not None else []
    return out.select(*named, *[F.nanvl(F.col(f"c{i}"), F.lit(None).cast("double")).alias(c) if not categorical[i]
                                else F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


# ------------------------------------------------------------------ the model's tables

def _named(model: TableModel) -> Column:
    return F.get(F.array(*[F.lit(c) for c in model.columns]), F.col("column"))


def quantile_rows(model: TableModel) -> DataFrame:
    """G1: (stratum, column_name, i, q) of the continuous columns, every point of the grid."""
    smooth = [i for i, c in enumerate(model.columns) if model.meta["kinds"][c] != "categorical" and not model.meta["discrete"][c]]
    p = model.strata.select("stratum", F.explode("points").alias("p")).select("stratum", "p.*").filter(F.col("column").isin(smooth))
    e = p.select("stratum", _named(model).alias("column_name"), F.posexplode(F.arrays_zip("x", "upto")).alias("j", "e"), "upto")
    nxt = F.coalesce(F.get("upto", F.col("j") + 1), F.col("e.upto") + 1)
    return e.select("stratum", "column_name", F.explode(F.sequence(F.col("e.upto").cast("int"), (nxt - 1).cast("int"))).alias("i"),
                    F.col("e.x").alias("q"))


def category_rows(model: TableModel, temperature: float | None = None) -> DataFrame:
    """(stratum, column_name, value, p) of the categorical columns."""
    from tabfid.operators.synth import TEMPERATURE_ARGMAX

    cat = [i for i, c in enumerate(model.columns) if model.meta["kinds"][c] == "categorical"]
    p = model.strata.select("_key", F.explode("points").alias("p")).select("_key", "p.*").filter(F.col("column").isin(cat) & ~F.col("large"))
    few = p.select("_key", "column", "upto", F.posexplode(F.arrays_zip("s", "upto")).alias("j", "e"))
    few = few.select("_key", "column", F.col("e.s").alias("s"), (F.col("e.upto") - F.coalesce(F.get("upto", F.col("j") - 1), F.lit(0.0))).alias("n"))
    rows = few.unionByName(model.values.filter(F.col("column").isin(cat)).select("_key", "column", "s", F.col("n").cast("double").alias("n")))
    by = ["_key", "column"]
    if temperature is not None and temperature <= TEMPERATURE_ARGMAX:
        mode = rows.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "s")).alias("m")).select(*by, F.col("m.s").alias("mode"))
        w = rows.join(mode, by).withColumn("p", (F.col("s") == F.col("mode")).cast("double"))
    else:
        w = rows.withColumn("w", F.pow("n", F.lit(1.0 / (temperature or 1.0))))
        w = w.join(w.groupBy(*by).agg(F.sum("w").alias("total")), by).withColumn("p", F.col("w") / F.col("total"))
    return w.join(model.strata.select("_key", "stratum"), "_key").select("stratum", _named(model).alias("column_name"), F.col("s").alias("value"), "p")
