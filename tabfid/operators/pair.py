"""The (real, synthetic) pair and the shared scale-safe building blocks.

* ``TablePair``   - both tables, zero-filled as the evaluator expects (op M5).
* ``side_agg``    - one aggregate over both tables with side-conditional expressions.
* ``stats_long``  - turn a one-row ``<column>__<stat>`` result into one row per column.
* ``cdf_table``   - per column and distinct value: counts and cumulative counts of both
  sides, built with a *bucketed* prefix sum so no task ever holds a whole column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.functions.exprs import is_numeric, zero_fill_col

SIDE = "_syn"  # 0 = real row, 1 = synthetic row
# fixed side names used in long results
REAL, SYN = "real", "synthetic"


@dataclass
class TablePair:
    """Real and synthetic tables with the same columns."""

    real: DataFrame
    synthetic: DataFrame
    columns: list[str] = field(default_factory=list)
    zero_fill: bool = True

    def __post_init__(self):
        if not self.columns:
            syn_cols = set(self.synthetic.columns)
            self.columns = [c for c in self.real.columns if c in syn_cols]
        missing = [c for c in self.columns if c not in self.real.columns or c not in self.synthetic.columns]
        if missing:
            raise ValueError(f"columns missing from one side: {missing}")
        types = {f.name: f.dataType for f in self.real.schema.fields}
        if self.zero_fill:
            self.real = self.real.select(*[zero_fill_col(c, types[c]) for c in self.columns])
            self.synthetic = self.synthetic.select(
                *[zero_fill_col(c, types[c]) for c in self.columns])
        else:
            self.real = self.real.select(*self.columns)
            self.synthetic = self.synthetic.select(*self.columns)

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.real.schema.fields
                if is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)]

    @property
    def categorical(self) -> list[str]:
        return [f.name for f in self.real.schema.fields if isinstance(f.dataType, T.StringType)]

    def tagged(self, cols: list[str] | None = None, as_double: bool = False) -> DataFrame:
        """Union of both sides with a 0/1 ``_syn`` tag (one scan of each table)."""
        cols = cols or self.columns
        sel = [F.col(c).cast("double").alias(c) if as_double else F.col(c) for c in cols]
        r = self.real.select(F.lit(0).cast("int").alias(SIDE), *sel)
        s = self.synthetic.select(F.lit(1).cast("int").alias(SIDE), *sel)
        return r.unionByName(s)


def on_side(c: Column | str, side: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.col(SIDE) == side, c)


def side_agg(pair: TablePair, cols: list[str], stats: dict) -> DataFrame:
    """One aggregate over both tables, computed once per side.

    ``stats`` maps a stat name to ``fn(column) -> aggregate Column``; the result is one
    row with columns ``<col>__<stat>__<side>`` (side 0 = real, 1 = synthetic).  The
    side is a pivot value, so each aggregate appears once in the plan (narrow buffers
    stay inside whole-stage codegen) instead of once per side behind a CASE.
    """
    t = pair.tagged(cols)
    aggs = [fn(F.col(c)).alias(f"{c}__{name}") for c in cols for name, fn in stats.items()]
    wide = t.groupBy().pivot(SIDE, [0, 1]).agg(*aggs)
    if len(aggs) == 1:   # pivot names a single aggregate by the pivot value only
        a = aggs[0]
        name = f"{cols[0]}__{list(stats)[0]}"
        return wide.select(*[F.col(f"`{s}`").alias(f"{name}__{s}") for s in (0, 1)])
    return wide.select(*[F.col(f"`{s}_{c}__{name}`").alias(f"{c}__{name}__{s}")
                         for c in cols for name in stats for s in (0, 1)])


def stats_long(row_df: DataFrame, cols: list[str], out: dict[str, str]) -> DataFrame:
    """One row per column from a wide one-row aggregate.

    ``out`` maps output name -> wide suffix (e.g. ``{"real_mean": "mean__0"}``).
    """
    structs = [F.struct(F.lit(c).alias("column_name"),
                        *[F.col(f"{c}__{suffix}").alias(name) for name, suffix in out.items()])
               for c in cols]
    return row_df.select(F.inline(F.array(*structs)))


def melt(df: DataFrame, cols: list[str], ids: list[str] | None = None,
         name: str = "column_name", value: str = "value") -> DataFrame:
    """Wide -> long (``unpivot``); values cast to double."""
    ids = ids or []
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return cast.unpivot(ids, cols, name, value)


def _bucketize(t: DataFrame, cols: list[str], n_buckets: int, accuracy: int, tasks: int = 0) -> DataFrame:
    """Add ``<c>__b`` range-bucket ids from approximate quantiles of each column.

    Boundaries come from one ``percentile_approx`` pass (k x n_buckets numbers reach the
    driver: a bounded amount).  Repeated boundaries are dropped, so a value that holds a
    third of the rows gets its own bucket instead of breaking the ranges.  ``tasks``: least number of
    partitions of the result.
    """
    spread = t.repartition(tasks) if tasks and t.rdd.getNumPartitions() < tasks else t
    if n_buckets <= 1:
        return spread.select("*", *[F.lit(0.0).alias(f"{c}__b") for c in cols])
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = t.agg(*[F.percentile_approx(c, probs, accuracy).alias(c) for c in cols]).first()
    splits = []
    for c in cols:
        qs = sorted({float(v) for v in (row[c] or []) if v is not None and not math.isnan(v)})
        qs = [q for q in qs if not math.isinf(q)]
        splits.append([-math.inf] + qs + [math.inf])
    bz = Bucketizer(splitsArray=splits, inputCols=list(cols),
                    outputCols=[f"{c}__b" for c in cols], handleInvalid="keep")
    return bz.transform(spread)


#: Values counted by one task, at most; up to ``ENTRIES_SPREAD`` values in all Spark's own tasks are taken.
ENTRIES, ENTRIES_SPREAD, MOST_TASKS = 4_000_000, 16_000_000, 10_000
PARALLEL_MIN_ROWS = 200_000   # below this, one bucket per column is cheaper than a quantile pass


def cdf_table(pair: TablePair, cols: list[str] | None = None,
              rows_per_bucket: int = 2_000_000, max_buckets: int = 4096,
              n_rows: int | None = None) -> DataFrame:
    """Joint empirical CDF of both sides over the pooled distinct values of each column.

    Columns: column_name, value, n_real, n_syn, cum_real, cum_syn, tot_real, tot_syn,
    next_value (next larger pooled value of the same column, null for the last).

    Plan: range buckets per column -> ``groupBy(column, bucket, value)`` with map-side
    partial counts (ties collapse before the shuffle) -> a tiny per-bucket table with
    running offsets (k x buckets rows, broadcast) -> running sums inside each
    ``(column, bucket)`` only.  A task sorts one bucket, never a whole column.
    """
    cols = cols or pair.numeric
    t = pair.tagged(cols, as_double=True)
    if n_rows is None:
        n_rows = t.count()
    n_buckets = max(1, min(max_buckets, math.ceil(n_rows / max(1, rows_per_bucket))))
    if n_rows >= PARALLEL_MIN_ROWS:
        # enough (column, bucket) window partitions to keep every core busy
        par = t.sparkSession.sparkContext.defaultParallelism
        n_buckets = max(n_buckets, min(max_buckets, math.ceil(2 * par / max(1, len(cols)))))
    entries = n_rows * len(cols)
    # a task's memory must not grow with its file split
    tasks = min(MOST_TASKS, math.ceil(entries / ENTRIES)) if entries > ENTRIES_SPREAD else 0
    tb = _bucketize(t, cols, n_buckets, accuracy=max(10_000, 20 * n_buckets), tasks=tasks)
    long = tb.select(SIDE, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"),
                 F.col(f"{c}__b").cast("int").alias("bucket")) for c in cols])))
    # explicit (no-op) filter: the join below would infer it on one branch only, and the
    # two uses of ``counts`` would then not share one exchange
    long = long.where(F.col("bucket").isNotNull() & F.col("value").isNotNull())
    counts = long.groupBy("column_name", "bucket", "value").agg(
        F.sum(1 - F.col(SIDE)).alias("n_real"), F.sum(F.col(SIDE)).alias("n_syn"))
    # per-bucket table: k x buckets rows at most -> safe to broadcast
    btab = counts.groupBy("column_name", "bucket").agg(
        F.sum("n_real").alias("b_real"), F.sum("n_syn").alias("b_syn"),
        F.min("value").alias("b_min"))
    wb = Window.partitionBy("column_name").orderBy("bucket")
    wprev = wb.rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy("column_name")
    btab = btab.select(
        "column_name", "bucket",
        F.coalesce(F.sum("b_real").over(wprev), F.lit(0)).alias("off_real"),
        F.coalesce(F.sum("b_syn").over(wprev), F.lit(0)).alias("off_syn"),
        F.sum("b_real").over(wall).alias("tot_real"),
        F.sum("b_syn").over(wall).alias("tot_syn"),
        F.lead("b_min").over(wb).alias("next_b_min"))
    joined = counts.join(F.broadcast(btab), ["column_name", "bucket"])
    if entries > ENTRIES_SPREAD:   # about a bucket in a task, however many buckets there are
        joined = joined.repartition(min(MOST_TASKS, 4 * n_buckets * len(cols)), "column_name", "bucket")
    w = Window.partitionBy("column_name", "bucket").orderBy("value")
    wrun = w.rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        "column_name", "value", "n_real", "n_syn",
        (F.col("off_real") + F.sum("n_real").over(wrun)).alias("cum_real"),
        (F.col("off_syn") + F.sum("n_syn").over(wrun)).alias("cum_syn"),
        "tot_real", "tot_syn",
        F.coalesce(F.lead("value").over(w), F.col("next_b_min")).alias("next_value"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], **cdf_kw) -> DataFrame:
    """Linear-interpolated quantiles (numpy/pandas 'linear', SQL quantile_cont) of each
    column, exact at any size: nulls and NaN are ignored; h = (n-1) p; the values at
    ranks floor(h) and ceil(h) are read off the bucketed CDF table (each distinct value
    emits only the requested ranks it covers).  Result: one row per column with
    ``q0, q1, ...`` in the order of ``probs`` plus ``n``."""
    base = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
                       for c in cols])
    pair = TablePair(base, base.limit(0), columns=list(cols), zero_fill=False)
    cdf = cdf_table(pair, cols, **cdf_kw)
    n = F.col("tot_real")
    wanted = []
    for i, p in enumerate(probs):
        h = (n - 1).cast("double") * F.lit(float(p))
        wanted += [F.struct(F.lit(i).alias("i"), F.lit(0).alias("hi"), F.floor(h).alias("r")),
                   F.struct(F.lit(i).alias("i"), F.lit(1).alias("hi"), F.ceil(h).alias("r"))]
    first, last = F.col("cum_real") - F.col("n_real"), F.col("cum_real") - 1
    hits = cdf.where(F.col("n_real") > 0).select(
        "column_name", "value", "tot_real",
        F.explode(F.filter(F.array(*wanted), lambda s: (s["r"] >= first) & (s["r"] <= last))).alias("s"))
    aggs = [F.first("tot_real").alias("n")]
    for i, p in enumerate(probs):
        lo = F.max(F.when((F.col("s.i") == i) & (F.col("s.hi") == 0), F.col("value")))
        hi = F.max(F.when((F.col("s.i") == i) & (F.col("s.hi") == 1), F.col("value")))
        aggs += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    g = hits.groupBy("column_name").agg(*aggs)
    out = [F.col("column_name"), F.col("n").cast("long").alias("n")]
    for i, p in enumerate(probs):
        h = (F.col("n") - 1).cast("double") * F.lit(float(p))
        frac = h - F.floor(h)
        out.append((F.col(f"_lo{i}") + frac * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}"))
    return g.select(*out)


SMALL_RUNNING = 1_000_000


def running_sums(df: DataFrame, part: list[str], order: list[str], weights: list[str],
                 small_limit: int = SMALL_RUNNING, n: int | None = None) -> DataFrame:
    """Running sums of ``weights`` (``<w>_cum``) and totals (``<w>_tot``) per ``part``
    in ``order``, for a table of *distinct* keys (e.g. category counts).

    Up to ``small_limit`` rows: windows per ``part``.  Larger: ``repartitionByRange``
    on (part, order), partition ids fixed by a reliable checkpoint (folder from
    ``spark.checkpoint.dir``), per-(part, partition) totals -> offsets on that small
    table (broadcast), windows only inside one range partition."""
    from tabfid.session import ensure_checkpoint_dir
    n = df.count() if n is None else n
    wall = Window.partitionBy(*part)
    if n <= small_limit:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(f"{c}_cum") for c in weights],
                         *[F.sum(c).over(wall).alias(f"{c}_tot") for c in weights])
    ensure_checkpoint_dir(df.sparkSession)
    parts = max(2, n // small_limit + 1)
    ranged = df.repartitionByRange(parts, *part, *order).withColumn("_pid", F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)
    sizes = ranged.groupBy(*part, "_pid").agg(*[F.sum(c).alias(f"_s_{c}") for c in weights])
    wp = Window.partitionBy(*part).orderBy("_pid")
    sizes = sizes.select(*part, "_pid",
                         *[F.coalesce(F.sum(f"_s_{c}").over(wp.rowsBetween(Window.unboundedPreceding, -1)),
                                      F.lit(0)).alias(f"_o_{c}") for c in weights],
                         *[F.sum(f"_s_{c}").over(Window.partitionBy(*part)).alias(f"{c}_tot") for c in weights])
    j = ranged.join(F.broadcast(sizes), [*part, "_pid"])   # one row per (part, range partition)
    w = Window.partitionBy(*part, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*df.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(w)).alias(f"{c}_cum") for c in weights],
                    *[F.col(f"{c}_tot") for c in weights])
