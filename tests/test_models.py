import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfid.operators import multivariate as mv
from tabfid.operators import runlog as rl
from tabfid.operators import score as sc
from tabfid.operators import synth
from tabfid.operators.pair import TablePair
from tests.conftest import SF001


def test_correlation_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 3))
    a[:, 1] += a[:, 0]
    b = rng.normal(size=(150, 3))
    sch = "x double, y double, z double"
    pair = TablePair(spark.createDataFrame(a.tolist(), sch), spark.createDataFrame(b.tolist(), sch))
    long = {(r["col_i"], r["col_j"]): r for r in mv.correlation_long(pair).collect()}
    cr, cs = np.corrcoef(a.T), np.corrcoef(b.T)
    names = ["x", "y", "z"]
    for i, p in enumerate(names):
        for j, q in enumerate(names):
            assert long[(p, q)]["real_corr"] == pytest.approx(cr[i, j], abs=1e-12)
            assert long[(p, q)]["synthetic_corr"] == pytest.approx(cs[i, j], abs=1e-12)
    d = cr - cs
    exp_sim = max(0.0, min(1.0, 1 - np.linalg.norm(d) / np.sqrt(6)))
    assert mv.correlation_similarity(pair).first()[0] == pytest.approx(exp_sim)
    r = mv.correlation_distance(pair).first()
    assert r["correlation_distance_rmse"] == pytest.approx(np.sqrt(np.mean(d ** 2)))


def test_identical_tables_closed_forms(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_tax")
    pair = TablePair(df, df)
    assert mv.correlation_similarity(pair).first()[0] == pytest.approx(1.0)
    d = mv.duplicate_rows(pair).first()
    assert d["copied_rows_pct"] == pytest.approx(100.0)


def test_constant_column_excluded(spark):
    a = spark.createDataFrame([(float(i), 1.0, float(i * i)) for i in range(20)], "a double, b double, c double")
    pair = TablePair(a, a)
    long = {(r["col_i"], r["col_j"]): r for r in mv.correlation_long(pair).collect()}
    assert long[("b", "b")]["real_corr"] == 0.0 and long[("a", "b")]["real_corr"] == 0.0
    assert mv.correlation_similarity(pair).first()[0] == pytest.approx(1.0)


def test_pca_reference_mode_zero_for_shift(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 5)).tolist()
    b = (rng.normal(size=(300, 5)) + 0.5).tolist()
    sch = ", ".join(f"c{i} double" for i in range(5))
    pair = TablePair(spark.createDataFrame(a, sch), spark.createDataFrame(b, sch))
    assert mv.pca_similarity(pair).first()["pca_similarity"] == 0.0
    ev = mv.pca_similarity(pair, mode="explained_variance").first()["pca_similarity"]
    assert 0.0 <= ev <= 1.0
    same = TablePair(spark.createDataFrame(a, sch), spark.createDataFrame(a, sch))
    assert mv.pca_similarity(same, mode="explained_variance").first()["pca_similarity"] == pytest.approx(1.0)


def test_scores_labels_and_ties(spark):
    m = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
                              "correlation_similarity double, correlation_distance_rmse double, "
                              "correlation_distance_mae double, duplicate_rows_percentage double, "
                              "nearest_neighbor_mean double, nearest_neighbor_std double")
    d = sc.quality_details(m).first()
    assert d["structural"] == 1.0 and d["utility"] == 0.5 and d["focus_area"] == "Utility"
    assert d["overall_score"] == pytest.approx(0.875) and d["overall_label"] == "Very Good"
    assert sc.similarity_score(m).first()[0] == pytest.approx(0.8)
    rows = {r["dimension"]: r["colour"] for r in sc.dimension_table(sc.quality_details(m)).collect()}
    assert rows == {"Structural": "green", "Distribution": "green", "Privacy": "green", "Utility": "orange"}


def _log(spark, values):
    return spark.createDataFrame([(1, e, 0, "loss", float(v)) for e, v in enumerate(values)],
                                 "run_id long, epoch long, batch long, metric string, value double")


def test_early_stopping_matches_loop(spark):
    vals = [5, 4, 4.5, 4.2, 4.1, 4.3, 4.0, 4.05, 4.1, 4.2, 4.3, 4.4, 3.0]
    r = rl.early_stopping(_log(spark, vals)).first()
    best, streak, stop = None, 0, None
    for e, v in enumerate(vals):
        if best is None or v < best:
            best, streak = v, 0
        else:
            streak += 1
            if stop is None and streak >= 5:
                stop = e
    assert r["stop_epoch"] == stop and r["best_value"] == 3.0


def test_trial_score_tail(spark):
    r = rl.trial_scores(_log(spark, list(range(20))), "loss").first()
    assert r["score"] == pytest.approx(-18.5)   # last int(10% of 20) = 2 epochs: 18, 19


def test_copula_partition_invariant_and_conditional(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_quantity", "l_discount", "l_returnflag")
    m = synth.fit_copula(df)
    a = synth.sample_copula(spark, m, 500, seed=3)
    b = synth.sample_copula(spark, m, 500, seed=3, num_partitions=7)
    assert a.exceptAll(b).count() == 0
    mc = synth.fit_copula(df, condition="l_returnflag")
    out = synth.sample_copula(spark, mc, {"A": 10, "R": 30})
    got = {r["l_returnflag"]: r["count"] for r in out.groupBy("l_returnflag").count().collect()}
    assert got == {"A": 10, "R": 30}
    cold = synth.sample_copula(spark, m, 200, temperature=0.3)
    assert cold.select("l_returnflag").distinct().count() == 1


def test_best_trial_bucketed_equals_single_window(spark):
    rows = [(i, None if i % 11 == 0 else float((i * 37) % 101)) for i in range(1, 400)]
    sc_df = spark.createDataFrame(rows, "run_id long, score double")
    a = sorted(tuple(r) for r in rl.best_trial(sc_df).collect())
    b = sorted(tuple(r) for r in rl.best_trial(sc_df, buckets=7).collect())
    assert a == b
    assert a[-1][2] == 100.0


def test_generator_with_nulls_codes_and_null_stratum(spark):
    rows = [(None if i % 4 == 0 else float(i), (i * 7) % 131, None, "x" if i % 3 else None, None, ["a", None, "b"][i % 3])
            for i in range(3000)]
    df = spark.createDataFrame(rows, "num double, code int, gone double, cat string, gone_cat string, grp string")
    m = synth.fit_copula(df)
    out = synth.sample_copula(spark, m, 2000).cache()
    assert out.dtypes == df.dtypes and out.count() == 2000
    assert out.filter("gone is not null or gone_cat is not null").count() == 0
    assert abs(out.filter("num is null").count() / 2000 - 0.25) < 0.04
    assert out.select("code").distinct().exceptAll(df.select("code").distinct()).count() == 0
    by = synth.fit_copula(df, condition="grp")
    cond = synth.sample_copula(spark, by, {"a": 10, None: 7})
    assert sorted(str(r["grp"]) for r in cond.collect()) == ["None"] * 7 + ["a"] * 10


def test_r2_of_large_close_labels(spark):
    from tabfid.operators.utility import r2_score
    rng = np.random.default_rng(1)
    y = 1e9 + rng.normal(0, 0.1, 2000)
    p = y + rng.normal(0, 0.01, 2000)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "label double, prediction double")
    want = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert r2_score(df).first()["r2"] == pytest.approx(want, abs=1e-6)


def test_every_code_can_be_generated(spark, tmp_path):
    """An integer column of 3,000 codes, one of them rare: all common codes and the rare one are generated."""
    df = spark.range(0, 300_000).select(
        F.when(F.col("id") % 10_000 == 0, F.lit(-5)).otherwise((F.col("id") % 3_000).cast("int")).alias("code"),
        (F.col("id") % 97).cast("double").alias("x"))
    model = synth.fit_copula(df, types={"code": "Ordinal"})
    synth.save_model(spark, model, str(tmp_path), "m", "1")
    for m in (model, synth.load_model(spark, str(tmp_path), "m", "1")):
        got = {r["code"]: r["count"] for r in synth.sample_copula(spark, m, 120_000, seed=3).groupBy("code").count().collect()}
        assert set(got) <= {-5, *range(3_000)} and len(got) > 2_990
        assert 2 <= got[-5] <= 40  # 30 of 300,000 rows: 12 expected


def test_forest_trains_on_points_that_stand_for_all_rows(spark, monkeypatch):
    """Past the bound rows of equal features are one point: few points, no row and no label lost, same lesson learnt."""
    from tabfid.operators import utility as ut
    df = spark.range(6000).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS a", "CAST((id * 37) % 6000 AS DOUBLE) / 10 AS b")
    df = df.withColumn("y", F.col("a") * 10 + F.when(F.col("b") > 300, 5.0).otherwise(0.0) + F.col("k") % 3)
    d = df.select("a", "b", F.col("y").alias("label"))
    whole, same = ut.training_points(d, ["a", "b"], "regression", 32)
    assert whole.count() == 6000 and same(d) is d
    monkeypatch.setattr(ut, "POINTS", 1000)
    points, binned = ut.training_points(d, ["a", "b"], "regression", 32)
    n, w, s = points.agg(F.count("*"), F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).first()
    assert n <= 1300 and w == 6000 and s == pytest.approx(d.agg(F.sum("label")).first()[0])
    assert binned(d).select("b").distinct().count() <= 32
    c = d.withColumn("label", F.floor(F.col("a") / 3).cast("double"))
    points, _ = ut.training_points(c, ["a", "b"], "classification", 32)
    assert points.count() <= 1300
    got = {r[0]: r[1] for r in points.groupBy("label").agg(F.sum("weight")).collect()}
    assert got == {r[0]: r[1] for r in c.groupBy("label").count().collect()}
    r = ut.ml_utility(df, df, "y", ["k"], "regression", num_trees=5, max_depth=5).first()
    assert r["real_score"] > 0.9 and r["synthetic_score"] > 0.9


def test_prepared_features_read_the_rows_once(spark, tmp_path):
    from tabfid.operators import utility as ut
    rows = [(i, float(i % 7), "abc"[i % 3], i % 2) for i in range(60)]
    spark.createDataFrame(rows, "k int, x double, s string, y int").write.parquet(f"{tmp_path}/rows")
    d = spark.read.parquet(f"{tmp_path}/rows")
    (train, other), _ = ut.prepare_features(d.where("k < 40"), [d], ["x", "s"])
    for t in (train, other):
        assert t._jdf.queryExecution().sparkPlan().toString().count(f"file:{tmp_path}/rows") == 1
    assert {(r["s"], r["n"]) for r in other.groupBy("s").count().withColumnRenamed("count", "n").collect()} == {(1, 20), (2, 20), (3, 20)}
    lab, size = ut._label(d, d, "s", "classification")
    assert size == 3 and lab(d)._jdf.queryExecution().sparkPlan().toString().count(f"file:{tmp_path}/rows") == 1
