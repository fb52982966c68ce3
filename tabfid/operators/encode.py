"""Category encoding with fitted dictionaries (ops E1-E8).

A dictionary is a DataFrame ``(value string, code long)``.  Codes are numbered on the
*distinct* table, never on raw rows.  Small dictionaries are numbered in one task;
large ones (``index_sorted``) by range partitions plus per-partition offsets after a
reliable checkpoint.  Lookups are joins; a dictionary of up to ``BROADCAST_VALUES`` values is broadcast, so
that rows are not gathered by a few values, others are left to Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfid.functions.exprs import free_names
from tabfid.session import ensure_checkpoint_dir, shared_table

# usual values for folding on request
RARE_SHARE = 0.0001
HEAD_SHARE = 0.95
HEAD_MAX = 50
OTHER = "other"          # rare/tail bucket of E2/E4
UNSEEN = "Other"         # unseen bucket of E7

SMALL_DICT = 1_000_000   # number in one task below this size
BROADCAST_VALUES = 10_000


@dataclass
class Encoder:
    column: str
    method: str              # 'label' or 'factorize'
    dictionary: DataFrame    # (value, code)
    size: int
    fill: str | None         # most-frequent fill for missing values
    folded: bool             # rare/tail values map to OTHER
    kept: DataFrame | None   # values kept before folding (None = all)


def index_sorted(df: DataFrame, order: list, small_limit: int = SMALL_DICT,
                 n: int | None = None, code: str = "code") -> DataFrame:
    """0-based position of each row of a *distinct* table in ``order``.

    Up to ``small_limit`` rows: one window task.  Larger: ``repartitionByRange`` ->
    partition ids are fixed by a reliable checkpoint -> per-partition counts (a table
    with one row per partition) -> offsets -> local row numbers + offset.
    """
    n = df.count() if n is None else n
    if n <= small_limit:
        return df.withColumn(code, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    ensure_checkpoint_dir(df.sparkSession)
    parts = max(2, n // small_limit + 1)
    ranged = df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = ranged.join(F.broadcast(sizes.select("_pid", "_off")), "_pid")
    w = Window.partitionBy("_pid").orderBy(*order)
    return j.withColumn(code, (F.col("_off") + F.row_number().over(w) - 1).cast("long")).drop("_pid", "_off")


def category_table(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with counts (nulls excluded)."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))


def _counted(df: DataFrame, col: str) -> tuple[DataFrame, int, int, int]:
    """(E8 table, rows, rows with a value, categories): the rows are counted by value once, into a small written table."""
    every = shared_table(df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")), "categories")
    st = every.agg(F.sum("count").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("count"))).alias("nn"),
                   F.count("value").alias("k")).first()
    return every.where(F.col("value").isNotNull()), st["rows"] or 0, st["nn"] or 0, st["k"]


def _mode(counts: DataFrame) -> str | None:
    r = counts.orderBy(F.desc("count"), "value").limit(1).collect()
    return r[0]["value"] if r else None


def fit_label_encoder(df: DataFrame, col: str, min_share: float | None = None) -> Encoder:
    """E1 + E2: most-frequent fill for missing values, then codes = rank in the sorted
    distinct values.  With ``min_share`` (``RARE_SHARE``, say), values seen fewer than
    max(1, int(rows * min_share)) times fold to 'other', at any table size."""
    counts, rows, nn, k = _counted(df, col)
    fill = _mode(counts) if nn < rows else None
    if fill is not None:
        counts = counts.unionByName(
            counts.sparkSession.createDataFrame([(fill, rows - nn)], "value string, count long")
        ).groupBy("value").agg(F.sum("count").alias("count"))
    folded = min_share is not None
    kept = None
    if folded:
        min_count = max(1, int(rows * min_share))
        kept_df = counts.where(F.col("count") >= min_count).select("value")
        n_kept = kept_df.count()
        if n_kept < k:
            kept = kept_df
            values = kept_df.unionByName(counts.sparkSession.createDataFrame([(OTHER,)], "value string")).distinct()
        else:
            folded = False
            values = counts.select("value")
    else:
        values = counts.select("value")
    size = values.count()
    dictionary = index_sorted(values, ["value"], n=size)
    return Encoder(col, "label", dictionary, size, fill, folded, kept)


def _small(table: DataFrame, size: int) -> DataFrame:
    return F.broadcast(table) if size <= BROADCAST_VALUES else table


def _lookup(df: DataFrame, enc: Encoder, on: str, out: str) -> DataFrame:
    (v,) = free_names(df, "_v")
    d = enc.dictionary.select(F.col("value").alias(v), F.col("code").alias(out))
    return df.join(_small(d, enc.size), F.col(on) == F.col(v), "left").drop(v)


def _prepared(df: DataFrame, enc: Encoder, val: str) -> DataFrame:
    v = F.col(enc.column).cast("string")
    if enc.fill is not None:
        v = F.coalesce(v, F.lit(enc.fill))
    d = df.withColumn(val, v)
    if enc.folded and enc.kept is not None:
        kv, keep = free_names(d, "_kv", "_keep")
        k = enc.kept.select(F.col("value").alias(kv), F.lit(True).alias(keep))
        d = d.join(_small(k, enc.size), F.col(val) == F.col(kv), "left").withColumn(
            val, F.when(F.col(keep), F.col(val)).otherwise(F.lit(OTHER))).drop(kv, keep)
    return d


def apply_encoder(df: DataFrame, enc: Encoder) -> DataFrame:
    """Replace the column by its code (long)."""
    val, out = free_names(df, "_val", "_code_out")
    d = _lookup(_prepared(df, enc, val), enc, val, out)
    return d.withColumn(enc.column, F.col(out)).drop(val, out)


def fit_factorize_encoder(df: DataFrame, col: str, order_key: list[str], coverage: float | None = None,
                          max_kept: int = HEAD_MAX) -> Encoder:
    """E3 + E4: the reference's "onehot" = one integer code per category in order of
    first appearance (by ``order_key``).  With ``coverage`` (``HEAD_SHARE``, say) only the most
    frequent categories are kept (count desc, value asc) until their cumulative share
    reaches it or ``max_kept`` are kept; the rest fold to 'other', at any table size."""
    v = F.col(col).cast("string")
    counts, rows, nn, k = _counted(df, col)
    fill = _mode(counts) if nn < rows else None
    if fill is not None:
        v = F.coalesce(v, F.lit(fill))
    kept = None
    folded = False
    if coverage is not None:
        top = counts.orderBy(F.desc("count"), "value").limit(max_kept).collect()
        keep, cum = [], 0
        for r in top:
            cum += r["count"]
            keep.append(r["value"])
            if cum / nn >= coverage or len(keep) >= max_kept:
                break
        if len(keep) < k:
            folded = True
            kept = df.sparkSession.createDataFrame([(x,) for x in keep], "value string")
            v = F.when(v.isin(keep), v).otherwise(F.lit(OTHER))
    first = df.select(v.alias("value"), F.struct(*order_key).alias("_pos")).groupBy("value").agg(
        F.min("_pos").alias("_first"))
    size = first.count()
    dictionary = index_sorted(first, ["_first"], n=size).select("value", "code")
    return Encoder(col, "factorize", dictionary, size, fill, folded, kept)


def one_hot(df: DataFrame, col: str, categories: list[str], prefix: str | None = None) -> DataFrame:
    """E3 (true one-hot): a 0/1 column per kept category (bounded list)."""
    p = prefix or col
    return df.withColumns({f"{p}_{c}": (F.col(col).cast("string") == F.lit(c)).cast("int") for c in categories})


def invert_encoder(df: DataFrame, enc: Encoder) -> DataFrame:
    """E5: null -> 0, round half-even, clip to [0, K-1], look the value up."""
    c = enc.column
    code = F.least(F.greatest(F.rint(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)),
                   F.lit(float(max(enc.size - 1, 0)))).cast("long")
    at, v = free_names(df, "_c", "_v")
    dd = enc.dictionary.select(F.col("value").alias(v), F.col("code").alias(at))
    return df.withColumn(at, code).join(_small(dd, enc.size), at, "left").withColumn(c, F.col(v)).drop(at, v)


def fit_joint_encoder(real: DataFrame, synthetic: DataFrame, col: str) -> Encoder:
    """Dictionary over the union of both tables' values (as strings)."""
    u = real.select(F.col(col).cast("string").alias(col)).unionByName(
        synthetic.select(F.col(col).cast("string").alias(col)))
    values = u.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    size = values.count()
    return Encoder(col, "label", index_sorted(values, ["value"], n=size), size, None, False, None)


def fit_with_unseen(train: DataFrame, col: str) -> Encoder:
    """Dictionary of the training values plus 'Other'; unseen values map to 'Other'."""
    values = train.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("value")).unionByName(
        train.sparkSession.createDataFrame([(UNSEEN,)], "value string")).distinct()
    size = values.count()
    return Encoder(col, "label", index_sorted(values, ["value"], n=size), size, None, False, None)


def apply_with_unseen(df: DataFrame, enc: Encoder) -> DataFrame:
    """E7 apply: unknown (or null) values take the code of 'Other'."""
    val, out = free_names(df, "_val", "_code_out")
    d = _lookup(df.withColumn(val, F.col(enc.column).cast("string")), enc, val, out)
    other = enc.dictionary.where(F.col("value") == UNSEEN).first()["code"]
    return d.withColumn(enc.column, F.coalesce(F.col(out), F.lit(other).cast("long"))).drop(val, out)
