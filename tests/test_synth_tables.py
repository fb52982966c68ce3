"""The table-backed model gives what the driver's model gives, and goes past its bounds."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfid.operators import synth, synth_tables


def frame(spark, n=4000):
    x = F.hash("id", F.lit(3))
    df = spark.range(n).select(
        (F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.pmod(x, F.lit(4))))).alias("g"),
        (F.pmod(x, F.lit(1000)) / 10.0).alias("price"),
        F.when(F.col("id") % 11 > 0, F.floor(F.pmod(x, F.lit(1000)) / 30).cast("int")).alias("code"),
        F.when(F.col("id") % 13 > 0, F.concat(F.lit("k"), F.pmod(F.hash("id"), F.lit(9)))).alias("kind"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(x, F.lit(90_000))).alias("at"),
        F.lit(None).cast("double").alias("void"))
    return df


def both(spark, monkeypatch, condition):
    df = frame(spark)
    small = synth.fit_copula(df, condition=condition)
    monkeypatch.setattr(synth, "MAX_POINTS", 1)
    monkeypatch.setattr(synth, "MAX_CATEGORIES", 1)
    tables = synth.fit_copula(df, condition=condition)
    assert isinstance(small, synth.CopulaModel) and isinstance(tables, synth_tables.TableModel)
    return small, tables


def rows(df):
    plain = lambda v: round(v, 5) if isinstance(v, float) else v.replace(microsecond=0) if hasattr(v, "microsecond") else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("condition", [None, "g"])
def test_same_model_and_sample(spark, monkeypatch, condition):
    monkeypatch.setattr(synth_tables, "PART", 300)
    monkeypatch.setattr(synth_tables, "BLOCK", 128)
    small, tables = both(spark, monkeypatch, condition)
    smooth = synth.quantile_table(spark, small).filter("column_name <> 'code'")  # discrete columns have their values
    assert rows(smooth) == rows(synth.quantile_table(spark, tables))
    for t in (None, 0.3, 0.8):
        a, b = rows(synth.category_table(spark, small, t)), rows(synth.category_table(spark, tables, t))
        b = [r for r in b if r[3] > 0 or t == 0.3]
        assert [r[:3] for r in a] == [r[:3] for r in b]
        assert np.allclose([r[3] for r in a], [r[3] for r in b])
    chol = {r["stratum"]: np.array(r["chol"]) for r in tables.strata.select("stratum", "chol").collect()}
    for s, c in small.corr.items():
        k = len(small.columns)
        assert np.allclose(synth._cholesky(c).ravel(), chol[None if condition is None and s == synth.ALL and s not in chol else s], atol=1e-6), s
        assert len(c) == k
    n = {None: 100, "g0": 700, "g2": 300, "g3": 5} if condition else 900
    for t in (None, 0.8, 0.3):
        a, b = synth.sample_copula(spark, small, n, 5, t), synth.sample_copula(spark, tables, n, 5, t)
        assert a.dtypes == b.dtypes
        ra, rb = rows(a), rows(b)
        same = sum((Counter(ra) & Counter(rb)).values())  # but for places at the end of a value's share
        assert len(ra) == len(rb) and same >= 0.995 * len(ra), (same, len(ra))


def test_many_values_keep_their_shares(spark, monkeypatch):
    """A column's values all in the table of values: one of a third of the rows, many of one row each."""
    monkeypatch.setattr(synth, "MAX_CATEGORIES", 100)
    monkeypatch.setattr(synth_tables, "WIDE", 20)
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 5).cast("long").alias("code"),
        F.when(F.col("id") % 5 < 2, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 6000)).alias("name"))
    model = synth.fit_copula(df)
    out = synth.sample_copula(spark, model, 60_000, 3).cache()
    assert out.filter("code IS NULL OR name IS NULL").count() == 0
    assert out.join(df.select("code").distinct(), "code", "left_anti").count() == 0
    assert out.join(df.select("name").distinct(), "name", "left_anti").count() == 0
    assert out.filter("code = 7").count() / 60_000 == pytest.approx(1 / 3, abs=0.01)
    assert out.filter("name = 'hot'").count() / 60_000 == pytest.approx(0.4, abs=0.01)
    # 20,000 codes of one row each, 40,000 draws: a share of 1 - e^-2 is drawn
    assert out.filter("code <> 7").select("code").distinct().count() / 20_000 == pytest.approx(1 - np.exp(-2), abs=0.01)
    lo = out.filter("code <> 7 AND code < 75000").count() / out.filter("code <> 7").count()
    assert lo == pytest.approx(0.5, abs=0.02)
    cold = synth.sample_copula(spark, model, 500, 3, temperature=0.2)
    assert cold.select("name").distinct().collect()[0][0] == "hot"
    warm = synth.sample_copula(spark, model, 60_000, 3, temperature=2.0)
    share = 12_000 ** 0.5 / (12_000 ** 0.5 + 3_600 * 5 ** 0.5 / 1)
    assert warm.filter("name = 'hot'").count() / 60_000 == pytest.approx(share, abs=0.02)


def test_many_strata(spark):
    """More conditions than the driver's model takes; quotas met exactly for each."""
    n, groups = 40_000, 8_000
    df = spark.range(n).select((F.col("id") % groups).alias("g"), (F.col("id") / 7.0).alias("x"), (F.col("id") % 5).cast("int").alias("y"),
                               F.concat(F.lit("k"), F.col("id") % 3).alias("z"))
    model = synth.fit_copula(df, condition="g")
    assert isinstance(model, synth_tables.TableModel)
    out = synth.sample_copula(spark, model, synth_tables.proportional_quota(model, n // 2), 3)
    got = {r[0]: r[1] for r in out.groupBy("g").count().collect()}
    assert sum(got.values()) == n // 2 and set(got.values()) <= {2, 3}
    some = synth.sample_copula(spark, model, {str(g): 1 + g % 4 for g in range(0, groups, 2)}, 3)
    assert {r[0]: r[1] for r in some.groupBy("g").count().collect()} == {str(g): 1 + g % 4 for g in range(0, groups, 2)}
    span = df.groupBy(F.col("g").cast("string").alias("g")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.collect_set("y").alias("ys"))
    bad = some.join(span, "g").filter("x < lo - 1e-9 OR x > hi + 1e-9 OR NOT array_contains(ys, y)")
    assert bad.count() == 0
    with pytest.raises(ValueError, match="no fitted stratum"):
        synth.sample_copula(spark, model, {"none": 3})


def test_versions(spark, monkeypatch, tmp_path):
    """Save, list, overwrite, delete; a reader that started before a save keeps the old version."""
    from tabfid.operators import model_store as ms

    small, tables = both(spark, monkeypatch, "g")
    base = str(tmp_path)
    assert ms.list_versions(spark, base, "m").collect() == []
    first = synth.save_model(spark, small, base, "m", "v1")
    reader = synth.load_model(spark, base, "m", "v1")
    synth.save_model(spark, tables, base, "m", "v2")
    loaded = synth.load_model(spark, base, "m")
    assert isinstance(loaded, synth_tables.TableModel)
    n = {"g0": 50, None: 30}
    assert rows(synth.sample_copula(spark, loaded, n, 2)) == rows(synth.sample_copula(spark, tables, n, 2))
    assert rows(synth.sample_copula(spark, reader, n, 2)) == rows(synth.sample_copula(spark, small, n, 2))
    # a save that is not published yet does not count
    spark.range(3).write.parquet(f"{base}/m/v1/half/quantiles")
    assert ms.find_version(spark, base, "m", "v1") == (first, "rows")
    second = synth.save_model(spark, tables, base, "m", "v1")
    assert ms.find_version(spark, base, "m", "v1") == (second, "tables")
    assert spark.read.parquet(f"{first}/quantiles").count() > 0  # readers of the old save go on
    assert ms.remove_overwritten(spark, base, "m") == 1 and not (tmp_path / first.split("/")[-1]).exists()
    ms.delete_version(spark, base, "m", "v1")
    assert [r["version"] for r in ms.list_versions(spark, base, "m").collect()] == ["v2"]
    assert not (tmp_path / "m" / "v1").exists()
    with pytest.raises(ValueError, match="no saved version"):
        synth.load_model(spark, base, "m", "v1")
    synth.save_model(spark, small, base, "m", "v1")
    assert ms.find_version(spark, base, "m")[1] == "rows"


def test_unordered_categories_keep_their_joint_table(spark, tmp_path):
    n = 20_000
    a = F.pmod(F.hash("id"), F.lit(4))
    noise = F.pmod(F.hash("id", F.lit(5)), F.lit(10))
    b = F.get(F.array(*[F.lit(x) for x in "mknl"]), F.when(noise > 0, a).otherwise(F.pmod(F.hash("id", F.lit(8)), F.lit(4))))
    df = spark.range(n).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("a"), a)).alias("a"), b.alias("b"),
                               F.concat(F.lit("f"), F.pmod(F.hash("id", F.lit(6)), F.lit(3))).alias("free"),
                               (F.pmod(F.hash("id", F.lit(7)), F.lit(1000)) + F.when(b == "m", 800).otherwise(0)).cast("double").alias("x"))
    model = synth.fit_copula(df)
    assert [(c, p) for c, p, _ in model.tree[synth.ALL]] == [("b", "a")]
    base = str(tmp_path)
    synth.save_model(spark, model, base, "m", "v")
    for m in (model, synth.load_model(spark, base, "m", "v")):
        out = synth.sample_copula(spark, m, n, 4).cache()
        was, now = ({(r[0], r[1]): r[2] for r in d.groupBy("a", "b").count().collect()} for d in (df, out))
        assert sum(abs(was.get(k, 0) - now.get(k, 0)) for k in was.keys() | now.keys()) / (2 * n) < 0.02
        shares = {r[0]: r[1] / n for r in out.groupBy("free").count().collect()}
        assert all(abs(v - 1 / 3) < 0.02 for v in shares.values())
    assert synth.sample_copula(spark, model, 50, 4, temperature=0.3).select("b").distinct().count() == 1
    by = df.withColumn("s", F.pmod(F.hash("x", "a"), F.lit(2)).cast("string"))
    cond = synth.fit_copula(by, condition="s")
    assert set(cond.tree) == {"0", "1"}
    out = synth.sample_copula(spark, cond, {"0": 9000, "1": 9000}, 4)
    now = {(r[0], r[1]): r[2] for r in out.groupBy("a", "b").count().collect()}
    assert sum(abs(was.get(k, 0) / n - now.get(k, 0) / 18_000) for k in was.keys() | now.keys()) / 2 < 0.02


def test_small_strata_are_fitted_together(spark, monkeypatch):
    """Strata of few rows get what the aggregates per stratum give, without 1,001 quantiles for each; large ones beside them."""
    n = 3_000
    df = spark.range(n).select(F.when(F.col("id") < 700, F.lit("big")).otherwise(F.when(F.col("id") % 400 > 0, F.concat(F.lit("s"), F.col("id") % 400))).alias("g"),
                               F.when(F.col("id") % 5 > 0, F.pmod(F.hash("id"), F.lit(50)) / 10.0).alias("x"), (F.col("id") % 3).cast("int").alias("y"),
                               F.when(F.col("id") % 4 > 0, F.concat(F.lit("k"), F.pmod(F.hash("id", F.lit(2)), F.lit(3)))).alias("z"))
    monkeypatch.setattr(synth, "MAX_POINTS", 1)

    def strata(model):
        out = {}
        for r in model.strata.collect():
            assert r["_key"] not in out
            out[r["_key"]] = (r["stratum"], r["n"], np.round(r["nulls"], 9).tolist(), sorted([p["column"], p["large"], p["x"] if p["s"] is None or p["s"][0] is None else p["s"], p["upto"]] for p in r["points"]),
                              np.round(r["chol"], 5).tolist())
        return out

    few = [strata(synth.fit_copula(df, condition="g"))]
    monkeypatch.setattr(synth_tables, "FEW", 0)
    few.append(strata(synth.fit_copula(df, condition="g")))
    assert few[0].keys() == few[1].keys() and len(few[0]) == 401
    for key, (stratum, rows_, nulls, points, chol) in few[0].items():
        other = few[1][key]
        assert (stratum, rows_, nulls, points) == other[:4], key
        assert np.allclose(chol, other[4], atol=2e-5), key
    monkeypatch.setattr(synth_tables, "FEW", 512)

    def asked(*a, **b):
        raise AssertionError("quantiles of each small stratum")

    monkeypatch.setattr(synth_tables.F, "percentile_approx", asked)
    base = df.filter("g <> 'big' OR g IS NULL").select(F.col("g").alias("_g"), F.col("x").alias("c0"))
    kinds = {"x": "continuous"}
    model = synth_tables.fit_tables(base, ["x"], kinds, {"x": False}, {"x": "double"}, "g", 1000, 10_000)
    assert model.strata.count() == 400


def test_few_strata_are_counted_once_and_scored_where_their_rows_are(spark, monkeypatch):
    """With few strata the values are counted and ranked in one shuffle and the rows are not dealt to be scored; the
    model is that of the path for many strata."""
    n = 4_000
    name = F.when(F.col("id") % 3 > 0, F.concat(F.lit("é\U0001f600z").substr(1 + F.pmod(F.hash("id"), F.lit(4)), F.lit(1)), F.col("id") % 900))
    df = spark.range(n).select((F.col("id") % 2).cast("string").alias("g"), F.when(F.col("id") % 4 > 0, -F.col("id") * 3).otherwise(7).alias("code"),
                               F.when(F.col("id") % 1_000 == 1, F.concat(name, F.repeat(F.lit("x"), 80))).otherwise(name).alias("name"),
                               (F.col("id") / 3.0).alias("x"), F.lit(None).cast("string").alias("void"))
    monkeypatch.setattr(synth, "MAX_CATEGORIES", 10)
    monkeypatch.setattr(synth_tables, "SMALL_VALUES", 100)
    monkeypatch.setattr(synth_tables, "FEW", 50)
    monkeypatch.setattr(synth_tables, "RANGE", 60)

    def facts(model):
        strata = {r["_key"]: (r["n"], r["nulls"], sorted([p["column"], p["large"], p["x"], p["s"], p["upto"]] for p in r["points"]), r["chol"]) for r in model.strata.collect()}
        return strata, sorted((tuple(r) for r in model.values.select("_key", "column", "x", "s", "n", "before").collect()), key=repr)

    many = []
    with monkeypatch.context() as m:
        m.setattr(synth_tables, "MOST_STRATA", 0)
        many = facts(synth.fit_copula(df, condition="g"))

    def again(*a, **b):
        raise AssertionError("the values are counted by a second shuffle")

    monkeypatch.setattr(synth_tables, "count_values", again)
    monkeypatch.setattr(synth, "count_values", again)
    strata, values = facts(synth.fit_copula(df, condition="g"))
    assert values == many[1] and strata.keys() == many[0].keys() == {"=0", "=1"}
    for key, (rows_, nulls, points, chol) in strata.items():
        assert (rows_, nulls, points) == many[0][key][:3] and np.allclose(chol, many[0][key][3])
    plain = Counter((r["g"], i, r[c]) for r in df.collect() for i, c in enumerate(("code", "name")) if r[c] is not None)
    want = []
    for g in "01":
        for i in range(2):
            before = 0
            for v, k in sorted((v, k) for (h, j, v), k in plain.items() if (h, j) == (g, i)):
                want.append((f"={g}", i, float(v) if i == 0 else None, v if i else None, k, before))
                before += k
    assert values == sorted(want, key=repr)


def test_strata_in_order_take_their_quota_without_a_join(spark, monkeypatch):
    """Strata of few rows come out of the fit in the order of their keys: a proportional quota is drawn from them without
    any shuffle of the model, with the rows that the join with a table of quotas gives."""
    monkeypatch.setattr(synth, "MAX_POINTS", 1)
    monkeypatch.setattr(synth_tables, "MERGED", 700)
    monkeypatch.setattr(synth_tables, "BLOCK", 3)
    n = 5_000
    df = spark.range(n).select(F.when(F.col("id") % 900 > 0, F.concat(F.lit("s"), F.col("id") % 900)).alias("g"), (F.col("id") / 7.0).alias("x"),
                               F.concat(F.lit("k"), F.col("id") % 3).alias("z"))
    model = synth.fit_copula(df, condition="g")
    assert model.strata.orderBy("_key").select("before").collect()[-1][0] == n - model.strata.orderBy(F.desc("_key")).first()["n"]
    for total in (n, n // 3, 2 * n + 7):
        quota = synth_tables.proportional_quota(model, total)
        out = synth.sample_copula(spark, model, quota, 3, 0.8)
        if total <= 2 * n:
            assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert rows(out) == rows(synth.sample_copula(spark, model, quota.select("stratum", "rows"), 3, 0.8))
        assert out.count() == total
    cold = rows(synth.sample_copula(spark, model, synth_tables.proportional_quota(model, 100), 3, 0.2))
    assert len(cold) == 100
