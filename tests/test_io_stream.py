import pytest
from pyspark.sql import functions as F

from tabfid.operators import runlog as rl
from tabfid.operators import schema as sch
from tabfid.session import ensure_checkpoint_dir
from tabfid.sources import io
from tabfid.streaming import runlog_stream as rs
from tests.conftest import SF001


def test_load_dispatch_and_errors(spark):
    df = io.load_table(spark, f"{SF001}/nation.parquet")
    assert df.count() == 25
    with pytest.raises(ValueError):
        io.load_table(spark, "/x/data.xlsx")


def test_csv_round_trip(spark):
    src = spark.read.parquet(f"{SF001}/orders.parquet")
    path = f"{ensure_checkpoint_dir(spark)}/t-orders.csv"
    io.write_table(src, path)
    back = io.load_table(spark, path, schema=src.schema)
    assert back.exceptAll(src).count() == 0 and src.exceptAll(back).count() == 0


def test_table_info_and_preview(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, float("nan"))], "a long, b double")
    info = {r["column_name"]: r["non_null"] for r in io.table_info(df).collect()}
    assert info == {"a": 3, "b": 1}
    assert [r["a"] for r in io.preview(df, 2, ["a"]).collect()] == [1, 2]


def test_schema_ops(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet")
    t = sch.infer_types(df)
    assert t["l_quantity"] == "Continuous" and t["l_shipdate"] == "Datetime" and t["l_returnflag"] == "Categorical"
    assert sch.apply_overrides(t, {"l_linenumber": "Ordinal"})["l_linenumber"] == "Ordinal"
    with pytest.raises(ValueError):
        sch.apply_overrides(t, {"l_linenumber": "Nope"})
    assert sch.group_by_prefix(["a_b", "c"]) == [("a", "a_b"), ("other", "c")]
    plan = {r["column_name"]: r["ref_type"] for r in sch.narrow_plan(
        spark.createDataFrame([(0, -5, 70000)], "a long, b long, c long")).collect()}
    assert plan == {"a": "uint8", "b": "int8", "c": "uint32"}
    kept = sch.select_columns(df, exclude=["l_tax"])
    back = sch.restore_columns(kept, df.schema)
    assert back.columns[-1] == "l_tax" and back.where(F.col("l_tax").isNotNull()).count() == 0


def test_stream_early_stopping_matches_batch(spark):
    rows = [(r, e, 0, "loss", float(v)) for r in range(3)
            for e, v in enumerate([5, 4, 4.5, 4.4, 4.3, 4.2, 4.1, 4.0, 3.9][: 6 + r])]
    log = spark.createDataFrame(rows, "run_id long, epoch long, batch long, metric string, value double")
    batch = {r["run_id"]: (r["stop_epoch"], r["best_value"]) for r in rl.early_stopping(log).collect()}
    ep = rl.epoch_means(log).select("run_id", "epoch", "value")
    path = rs.stage_for_stream(ep, f"{ensure_checkpoint_dir(spark)}/t-stream", "epoch", files=3)
    stream = spark.readStream.schema(ep.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["run_id"]: (r["stop_epoch"], r["best_value"])
           for r in rs.run_stream_to_table(spark, rs.early_stopping_stream(stream), ["run_id"]).collect()}
    assert got == batch
