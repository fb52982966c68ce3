"""Training-log analytics on a log table (run_id, epoch, batch, metric, value).

Windows are partitioned by run over *per-epoch* tables (one row per run and epoch),
never over raw batch rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATIENCE = 5            # fixed: epochs without improvement before stopping (L3)
TAIL_SHARE = 0.1        # fixed: last 10 % of epochs form the trial score (L2)


def epoch_means(log: DataFrame) -> DataFrame:
    """L1: mean of every batch metric per (run, epoch)."""
    return log.groupBy("run_id", "epoch", "metric").agg(F.avg("value").alias("value"))


def epoch_totals(log: DataFrame) -> DataFrame:
    """L1: sum over metrics of the epoch means (the total loss)."""
    return epoch_means(log).groupBy("run_id", "epoch").agg(F.sum("value").alias("total"))


def _metric_epochs(log: DataFrame, metric: str) -> DataFrame:
    return epoch_means(log.where(F.col("metric") == metric)).select("run_id", "epoch", "value")


def trial_scores(log: DataFrame, metric: str = "loss", tail_share: float = TAIL_SHARE) -> DataFrame:
    """L2: score = -mean of the metric over the last max(1, int(10 % of epochs)) epochs."""
    e = _metric_epochs(log, metric)
    w = Window.partitionBy("run_id")
    e = e.select("run_id", "epoch", "value", F.count(F.lit(1)).over(w).alias("n"),
                 F.row_number().over(w.orderBy(F.desc("epoch"))).alias("rk"))
    tail = F.greatest(F.lit(1), F.floor(F.col("n") * tail_share))
    return e.where(F.col("rk") <= tail).groupBy("run_id").agg(
        (-F.avg("value")).alias("score"), F.first("n").alias("epochs"))


def early_stopping(log: DataFrame, metric: str = "loss", patience: int = PATIENCE) -> DataFrame:
    """L3: best-so-far per run; an epoch improves when its value is below the best of
    all earlier epochs; training stops at the first epoch that is the ``patience``-th in
    a row without improvement (null = never).  Gaps-and-islands over the epoch table."""
    e = _metric_epochs(log, metric)
    w = Window.partitionBy("run_id").orderBy("epoch")
    prev_best = F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("improved", prev_best.isNull() | (F.col("value") < prev_best))
    e = e.withColumn("grp", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("streak", F.row_number().over(Window.partitionBy("run_id", "grp").orderBy("epoch")) - 1)
    return e.groupBy("run_id").agg(
        F.min(F.when(F.col("streak") >= patience, F.col("epoch"))).alias("stop_epoch"),
        F.min("value").alias("best_value"),
        F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"),
        F.count(F.lit(1)).alias("epochs"))


SINGLE_WINDOW_TRIALS = 1_000_000


def best_trial(scores: DataFrame, order: str = "run_id", buckets: int | None = None) -> DataFrame:
    """L4: history in trial order with the running best (first best wins; a null score
    counts as -inf) and the best trial so far.

    Up to a million trials one ordered window; beyond that (or with ``buckets``) a
    bucketed prefix maximum: range buckets of ``order``, the best of each bucket, a
    running best over the small bucket table (broadcast), and windows only inside a
    bucket - the running maximum is associative, like the running sums of the CDF."""
    key = F.struct(F.coalesce(F.col("score"), F.lit(float("-inf"))).alias("s"), (-F.col(order)).alias("o"))
    n = scores.count() if buckets is None else None
    if buckets is None and n <= SINGLE_WINDOW_TRIALS:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        h = scores.select(order, "score", F.max(key).over(w).alias("b"))
    else:
        from pyspark.ml.feature import Bucketizer
        nb = buckets or max(2, n // SINGLE_WINDOW_TRIALS + 1)
        qs = scores.approxQuantile(order, [i / nb for i in range(1, nb)], 0.001)
        splits = [float("-inf")] + sorted(set(float(q) for q in qs)) + [float("inf")]
        d = Bucketizer(splits=splits, inputCol="_o", outputCol="_b").transform(
            scores.withColumn("_o", F.col(order).cast("double"))).withColumn("_b", F.col("_b").cast("int"))
        d = d.withColumn("_k", key)
        per = d.groupBy("_b").agg(F.max("_k").alias("_bk"))       # one row per bucket
        wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("_b", F.max("_bk").over(wb).alias("_prev"))
        w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        j = d.join(F.broadcast(per), "_b")
        run = F.max("_k").over(w)
        best = F.when(F.col("_prev").isNull(), run).otherwise(F.greatest(run, F.col("_prev")))
        h = j.select(order, "score", best.alias("b"))
    return h.select(order, "score", F.col("b.s").alias("best_score"), (-F.col("b.o")).alias("best_trial"))


def run_summary(log: DataFrame) -> DataFrame:
    """Last value of every metric per run (largest (epoch, batch))."""
    return log.groupBy("run_id", "metric").agg(
        F.max_by("value", F.struct("epoch", "batch")).alias("last_value"),
        F.max("epoch").alias("last_epoch"))
