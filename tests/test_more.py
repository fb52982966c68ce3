import pytest
from pyspark.sql import functions as F

from tabfid.operators import encode as enc
from tabfid.operators import schema as sch
from tabfid.operators import synth
from tabfid.operators.pair import TablePair
from tabfid.plans.report import evaluate_all
from tabfid.session import ensure_checkpoint_dir
from tests.conftest import SF001


def test_rare_and_head_folding(spark):
    vals = [f"v{i}" for i in range(30) for _ in range(i + 1)]        # v29 most frequent
    df = spark.createDataFrame([(x,) for x in vals], "c string")
    e = enc.fit_label_encoder(df, "c", min_share=0.05)
    kept = {r["value"] for r in e.dictionary.collect()}
    min_count = int(len(vals) * 0.05)
    assert "other" in kept and all(f"v{i}" in kept for i in range(30) if i + 1 >= min_count)
    coded = enc.apply_encoder(df, e)
    assert coded.where(F.col("c").isNull()).count() == 0
    f = enc.fit_factorize_encoder(df.withColumn("pos", F.monotonically_increasing_id()), "c", ["pos"],
                                  coverage=0.95, max_kept=3)
    assert f.size == 4 and f.folded


def test_nothing_folds_unasked_at_any_size(spark):
    df = spark.range(60_000).select(F.concat(F.lit("v"), F.col("id") % 1500).alias("c"), "id")
    assert enc.fit_label_encoder(df, "c").size == 1500
    assert enc.fit_factorize_encoder(df, "c", ["id"]).size == 1500


def test_unseen_and_one_hot(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    e = enc.fit_with_unseen(train, "c")
    codes = {r["value"]: r["code"] for r in e.dictionary.collect()}
    got = sorted(r["c"] for r in enc.apply_with_unseen(test, e).collect())
    assert got == sorted([codes["a"], codes["Other"], codes["Other"]])
    oh = enc.one_hot(train, "c", ["a", "b"]).collect()
    assert sorted((r["c_a"], r["c_b"]) for r in oh) == [(0, 1), (1, 0)]


def test_narrow_types_casts(spark):
    df = spark.createDataFrame([(1, 300, -5, 1.5)], "a long, b long, c long, d double")
    out = sch.narrow_types(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["tinyint", "smallint", "tinyint", "float"]


def test_report_records_failures(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_quantity", "l_tax", "l_returnflag")
    pair = TablePair(li, li)
    rep = evaluate_all(pair, ["l_quantity", "l_tax"], target="l_returnflag", keys=["no_such_key"])
    rows = rep.collect()
    assert any(r["metric"] == "ml_utility" and r["error"] for r in rows)
    assert any(r["metric"] == "ks_statistic" and r["value"] == 0.0 for r in rows)
    assert any(r["metric"] == "overall_score" and r["value"] is not None for r in rows)


def test_copula_save_load_round_trip(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_quantity", "l_returnflag", "l_shipdate")
    m = synth.fit_copula(df)
    base = f"{ensure_checkpoint_dir(spark)}/models-test"
    synth.save_model(spark, m, base, "li", "v1")
    m2 = synth.load_model(spark, base, "li", "v1")
    a = synth.sample_copula(spark, m, 300, seed=5)
    b = synth.sample_copula(spark, m2, 300, seed=5)
    assert a.exceptAll(b).count() == 0
