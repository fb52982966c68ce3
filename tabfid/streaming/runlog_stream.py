"""Training logs as streams.

A training job appends log rows (run_id, epoch, batch, metric, value) while it runs; the
monitor keeps the per-epoch means (L1), the last value per metric (L5) and the
early-stopping decision (L3) up to date.

* L1/L5 are streaming aggregations (state = one row per key, updated each trigger).
* L3 is a custom stateful operator (``applyInPandasWithState``): per run it keeps
  (best value, epochs since the last improvement, stop epoch, last epoch) - four
  numbers, so state does not grow with the log.  Epoch rows of a run must arrive in
  epoch order; an epoch at or before the last one seen is ignored.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tabfid.operators.runlog import PATIENCE
from tabfid.session import ensure_checkpoint_dir

LOG_SCHEMA = "run_id long, epoch long, batch long, metric string, value double"
EPOCH_SCHEMA = "run_id long, epoch long, value double"


def epoch_means_stream(log: DataFrame) -> DataFrame:
    """L1 on a stream: running mean per (run, epoch, metric)."""
    return log.groupBy("run_id", "epoch", "metric").agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("batches"))


def run_summary_stream(log: DataFrame) -> DataFrame:
    """L5 on a stream: last value per (run, metric) by (epoch, batch)."""
    return log.groupBy("run_id", "metric").agg(
        F.max_by("value", F.struct("epoch", "batch")).alias("last_value"), F.max("epoch").alias("last_epoch"))


_OUT = "run_id long, stop_epoch long, best_value double, best_epoch long, epochs long"
_STATE = "best double, best_epoch long, streak long, stop long, last long, epochs long"


def _early_stop_fn(patience: int):
    def fn(key, pdfs, state):
        if state.exists:
            best, best_epoch, streak, stop, last, epochs = state.get
        else:
            best, best_epoch, streak, stop, last, epochs = None, None, 0, None, None, 0
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values("epoch")
        for e, v in zip(rows["epoch"].tolist(), rows["value"].tolist()):
            if last is not None and e <= last:
                continue
            last = e
            epochs += 1
            if best is None or v < best:
                best, best_epoch, streak = v, e, 0
            else:
                streak += 1
                if stop is None and streak >= patience:
                    stop = e
        state.update((best, best_epoch, streak, stop, last, epochs))
        yield pd.DataFrame({"run_id": [key[0]], "stop_epoch": [stop], "best_value": [best],
                            "best_epoch": [best_epoch], "epochs": [epochs]})
    return fn


def early_stopping_stream(epochs: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """L3 as a stateful streaming operator over per-epoch rows (run_id, epoch, value)."""
    return epochs.groupBy("run_id").applyInPandasWithState(
        _early_stop_fn(patience), _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_stream_to_table(spark: SparkSession, stream: DataFrame, key: list[str],
                        name: str | None = None) -> DataFrame:
    """Run a streaming query over everything available (availableNow trigger).

    Each micro-batch's updated rows are written with ``foreachBatch`` to
    ``<checkpoint dir>/stream-out-<name>/_batch=<id>`` (overwrite: a replayed batch
    rewrites the same folder, so the sink is idempotent); the result keeps the latest
    row per ``key``."""
    from pyspark.sql import Window
    name = name or uuid.uuid4().hex[:12]
    root = ensure_checkpoint_dir(spark)
    out_dir = f"{root}/stream-out-{name}"

    def sink(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{out_dir}/_batch={batch_id}")

    q = (stream.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{root}/stream-ckpt-{name}").trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out_dir)
    w = Window.partitionBy(*key).orderBy(F.desc("_batch"))
    return res.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_batch")


def stage_for_stream(df: DataFrame, path: str, order: str, files: int = 8) -> str:
    """Append rows to ``path`` in ``files`` ascending ranges of ``order``, one write
    after the other, so a file stream (oldest file first, one per trigger) sees them
    in that order (test and replay helper; the ranges come from approximate quantiles)."""
    qs = df.approxQuantile(order, [i / files for i in range(1, files)], 0.001)
    edges = sorted(set(qs))
    lo = None
    for hi in edges + [None]:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(order) > lo)
        if hi is not None:
            cond = cond & (F.col(order) <= hi)
        df.where(cond).coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)
        lo = hi
    return path
