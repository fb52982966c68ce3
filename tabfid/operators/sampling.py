"""Repeatable splits and samples (ops H1-H6).

Every choice comes from the portable row hash of a caller-given unique key, never from
``rand()``, so results do not depend on partitioning and survive task retries.
Exact-size samples use a *hash cut*: rows are counted per (stratum, hash bucket), the
bucket where the running count crosses the quota is found on that small table, and
only rows of that one bucket are ranked.  No global sort, no window over a stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfid.functions.exprs import free_names
from tabfid.functions.hashing import MOD_OUT, portable_hash

HASH_BITS = 31                 # the portable hash takes values in [0, 2^31)
BUCKET_BITS = 20
FEW_STRATA = 10_000             # quotas given on the driver that are broadcast


def train_test_split(df: DataFrame, keys: list[str], test_size: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """H1: rows whose hash falls under ``test_size`` of the hash range are the test
    set.  A projection + filter: no shuffle."""
    cut = F.lit(int(test_size * MOD_OUT))
    h = portable_hash(*keys, seed=seed)
    return df.where(h >= cut), df.where(h < cut)


def split_label(df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """H1 as a column: ``split`` = 'train' / 'test'."""
    h = portable_hash(*keys, seed=seed)
    return df.withColumn("split", F.when(h < F.lit(int(test_size * MOD_OUT)), "test").otherwise("train"))


def take_by_hash(df: DataFrame, keys: list[str], quota: int | DataFrame,
                 strata: list[str] | None = None, seed: int = 42, few: bool = False) -> DataFrame:
    """Exactly ``quota`` rows (per stratum) with the smallest (hash, keys).

    ``quota`` is an int (no strata) or a DataFrame (strata..., quota); with ``few`` strata
    their quotas and cuts are broadcast, so that no row is gathered by its stratum.  Keys must be unique per row.  Strata with fewer rows than their quota are taken whole.
    """
    strata = strata or []
    # 2^20 hash buckets: the bucket-count table has at most a million rows per stratum, and the
    # one bucket that is ranked has about a million of 10^12 rows
    h = portable_hash(*keys, seed=seed)
    _H, _B, need, last, rn = free_names(df, "_h", "_hb", "_need", "_last", "_rn")
    d = df.withColumns({_H: h, _B: F.shiftright(h, HASH_BITS - BUCKET_BITS).cast("int")})
    counts = d.groupBy(*strata, _B).agg(F.count(F.lit(1)).alias("_cnt"))
    if isinstance(quota, int):
        if strata:
            raise ValueError("an int quota cannot be used with strata; pass a quota table")
        counts = counts.withColumn("_quota", F.lit(int(quota)).cast("long"))
    else:
        qdf = quota.select(*strata, F.col("quota").cast("long").alias("_quota"))
        counts = counts.join(F.broadcast(qdf) if few else qdf, strata)
    w = Window.partitionBy(*strata).orderBy(_B) if strata else Window.orderBy(_B)
    run = counts.select(*strata, _B, "_quota", F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, 0))
                        .alias("_cum"), "_cnt")
    status = run.select(*strata, _B, (F.col("_cum") - F.col("_cnt")).alias("_prev"), "_cum", "_quota")
    status = status.where(F.col("_prev") < F.col("_quota")).select(
        *strata, _B, F.when(F.col("_cum") <= F.col("_quota"), F.lit(None).cast("long"))
        .otherwise(F.col("_quota") - F.col("_prev")).alias(need))
    # per stratum one cut: buckets below it are taken whole, the bucket at it is ranked
    cut = status.groupBy(*strata).agg(F.max(_B).alias(last), F.max(F.struct(_B, need))[need].alias(need))
    if few or not strata:   # without strata one row
        cut = F.broadcast(cut)
    j = d.join(cut, strata) if strata else d.join(cut, F.lit(True))
    full = j.where((F.col(_B) < F.col(last)) | ((F.col(_B) == F.col(last)) & F.col(need).isNull()))
    part = j.where((F.col(_B) == F.col(last)) & F.col(need).isNotNull())
    wr = Window.partitionBy(*strata, _B).orderBy(_H, *keys)
    part = part.withColumn(rn, F.row_number().over(wr)).where(F.col(rn) <= F.col(need)).drop(rn)
    out = full.unionByName(part)
    return out.drop(_H, _B, need, last)


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """H2: exactly ``n`` rows without replacement (all rows when n >= rows)."""
    return take_by_hash(df, keys, int(n), seed=seed)


def match_size(real: DataFrame, n_synthetic: int, keys: list[str], seed: int = 42) -> DataFrame:
    """H2: real rows to compare with a synthetic table of ``n_synthetic`` rows."""
    return sample_rows(real, keys, n_synthetic, seed)


def rows_to_generate(n_rows: int, mode: str = "default", value: float | None = None) -> int:
    """H3: default max(1, int(0.25 n)); percent max(1, int(n p)); exact min(k, n)."""
    if mode == "default":
        return max(1, int(0.25 * n_rows))
    if mode == "percent":
        return max(1, int(n_rows * float(value)))
    if mode == "exact":
        return min(int(value), n_rows)
    raise ValueError(f"unknown mode {mode!r}")


def head_rows(df: DataFrame, order_by: list[str], max_rows: int | None = None) -> DataFrame:
    """H4: first ``max_rows`` rows by an explicit key (None = no cap)."""
    if max_rows is None:
        return df
    return df.orderBy(*order_by).limit(max_rows)


def resize(df: DataFrame, keys: list[str], total: int, n_rows: int | None = None,
           seed: int = 42) -> DataFrame:
    """H5: exactly ``total`` rows: a hash sample when there are too many; otherwise each
    row is repeated ceil(total / n) times (``replica`` column) and the surplus is cut
    by hash.  Output keeps a ``replica`` column (0 when not repeated)."""
    n = n_rows if n_rows is not None else df.count()
    if n == 0:
        return df.withColumn("replica", F.lit(0).cast("int")).limit(0)
    if total <= n:
        return sample_rows(df, keys, total, seed).withColumn("replica", F.lit(0).cast("int"))
    reps = math.ceil(total / n)
    rep = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return take_by_hash(rep, [*keys, "replica"], total, seed=seed)


def quotas(counts: dict, total: int) -> dict:
    """H6: ratios normalised to shares of ``total``, each at least 1."""
    s = float(sum(counts.values()))
    return {k: max(1, int(v / s * total)) for k, v in counts.items()}


def exact_quotas(counts: dict, total: int) -> dict:
    """H6 + H5: quotas whose sum is ``total`` - what rounding leaves over or takes too much goes to
    or comes from the largest ones (each keeps at least 1 while total allows it)."""
    q = quotas(counts, total)
    order = sorted(q, key=lambda k: (-q[k], str(k)))
    short = total - sum(q.values())
    for i in range(abs(short)):
        k = order[i % len(order)] if short > 0 else max(order, key=lambda x: q[x])
        q[k] += 1 if short > 0 else -1
    return q


def stratified_sample(df: DataFrame, keys: list[str], column: str, ratios: dict, total: int,
                      seed: int = 42) -> DataFrame:
    """H6: per value of ``column`` exactly its quota of rows (by hash)."""
    q = quotas(ratios, total)
    spark = df.sparkSession
    dt = df.schema[column].dataType.simpleString()
    qdf = spark.createDataFrame([(k, v) for k, v in q.items()], f"{column} {dt}, quota long")
    return take_by_hash(df, keys, qdf, strata=[column], seed=seed, few=len(q) <= FEW_STRATA)
