"""Queries for generation."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from tabfid.operators import model_store, synth, synth_tables
from tabfid.operators.sampling import quotas, rows_to_generate
from tabfid.plans.catalog import register
from tabfid.plans.fixtures import lineitem_with_nulls, table
from tabfid.plans.synthesize import synthesize
from tabfid.session import ensure_checkpoint_dir, shared_table

GEN_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "l_shipdate", "l_linenumber"]
CATS = ["l_returnflag", "l_linestatus"]


def _li(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*GEN_COLS)


G1C_SQL = "\nUNION ALL\n".join(
    f"SELECT '__all__' AS stratum, '{c}' AS column_name, {c} AS value, count(*) / sum(count(*)) OVER () AS p "
    f"FROM lineitem GROUP BY {c}" for c in CATS)


@register("g1_fit_categories", G1C_SQL, doubles=["p"])
def q_g1c(spark, sf_dir):
    """G1: fitted category probabilities of the copula model."""
    return synth.category_table(spark, synth.fit_copula(_li(spark, sf_dir)))


@register("g1_fit_quantiles", None)
def q_g1q(spark, sf_dir):
    """G1: fitted quantile tables (1,001 points per continuous/datetime column)."""
    return synth.quantile_table(spark, synth.fit_copula(_li(spark, sf_dir)))


@register("g2_sample", None)
def q_g2(spark, sf_dir):
    """The default number of rows (25 % of the table) sampled from the fitted model."""
    li = _li(spark, sf_dir)
    n = rows_to_generate(li.count())
    return synth.sample_copula(spark, synth.fit_copula(li), n, seed=42)


G2N_SQL = ("SELECT CAST(greatest(1, floor(0.25 * count(*))) AS BIGINT) AS n_rows, true AS codes_seen, true AS flags_seen, "
           "true AS in_range, true AS null_share_close, true AS mean_close FROM lineitem")


@register("g2_sample_checks", G2N_SQL)
def q_g2c(spark, sf_dir):
    """G2 on a table with nulls and an integer-coded category: every code and flag was seen in the
    table, prices stay in its range, and the null share and the mean are within 2 % of the table's."""
    li = lineitem_with_nulls(spark, sf_dir).select("l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber")
    n = rows_to_generate(li.count())
    out = synth.sample_copula(spark, synth.fit_copula(li), n, seed=11)

    def facts(d):
        return d.agg(F.count(F.lit(1)).alias("n"), F.collect_set("l_linenumber").alias("codes"),
                     F.collect_set("l_returnflag").alias("flags"), F.min("l_extendedprice").alias("lo"),
                     F.max("l_extendedprice").alias("hi"), F.avg("l_extendedprice").alias("mean"),
                     F.avg(F.col("l_quantity").isNull().cast("double")).alias("nulls"))  # some codes and flags

    a, b = facts(li).alias("a"), facts(out).alias("b")
    return b.join(F.broadcast(a), F.lit(True)).select(
        F.col("b.n").alias("n_rows"), (F.size(F.array_except("b.codes", "a.codes")) == 0).alias("codes_seen"),
        (F.size(F.array_except("b.flags", "a.flags")) == 0).alias("flags_seen"),
        ((F.col("b.lo") >= F.col("a.lo")) & (F.col("b.hi") <= F.col("a.hi"))).alias("in_range"),
        (F.abs(F.col("b.nulls") - F.col("a.nulls")) < 0.02).alias("null_share_close"),
        (F.abs(F.col("b.mean") / F.col("a.mean") - 1) < 0.02).alias("mean_close"))


@register("g6_conditional_total",
          "SELECT CAST(greatest(1, floor(0.25 * count(*))) AS BIGINT) AS n_rows, true AS restored FROM lineitem")
def q_g6c(spark, sf_dir):
    """G6 with a condition: exactly the wanted number of rows, excluded column back as nulls."""
    li = table(spark, sf_dir, "lineitem").select(*GEN_COLS, "l_orderkey")
    out, _ = synthesize(li, exclude=["l_orderkey"], condition="l_returnflag", ratios={"A": 5, "N": 3, "R": 2}, seed=7)
    return out.agg(F.count(F.lit(1)).alias("n_rows"), (F.count("l_orderkey") == 0).alias("restored"))


G3_SQL = "\nUNION ALL\n".join(
    f"SELECT '__all__' AS stratum, '{c}' AS column_name, value, pow(p, 1 / 0.8) / sum(pow(p, 1 / 0.8)) OVER () AS p "
    f"FROM (SELECT {c} AS value, count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY {c}) AS x"
    for c in CATS)


@register("g3_temperature_table", G3_SQL, doubles=["p"])
def q_g3(spark, sf_dir):
    """Category probabilities at temperature 0.8 (p^(1/T) renormalised)."""
    return synth.category_table(spark, synth.fit_copula(_li(spark, sf_dir)), temperature=0.8)


@register("g3_temperature_sample", None)
def q_g3s(spark, sf_dir):
    """Rows sampled at temperature 0.2 (categories take their mode)."""
    li = _li(spark, sf_dir)
    return synth.sample_copula(spark, synth.fit_copula(li), rows_to_generate(li.count()), temperature=0.2)


G4_SQL = """WITH n AS (SELECT greatest(1, CAST(floor(0.25 * count(*)) AS BIGINT)) AS total FROM lineitem),
q(l_returnflag, r) AS (VALUES ('A', 5), ('N', 3), ('R', 2))
SELECT l_returnflag, CAST(greatest(1, floor(r / 10.0 * total)) AS BIGINT) AS count FROM q, n"""


@register("g4_conditional_counts", G4_SQL)
def q_g4(spark, sf_dir):
    """Conditional sampling with l_returnflag A:N:R = 5:3:2; rows per value."""
    li = _li(spark, sf_dir)
    n = rows_to_generate(li.count())
    model = synth.fit_copula(li, condition="l_returnflag")
    out = synth.sample_copula(spark, model, quotas({"A": 5, "N": 3, "R": 2}, n))
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("count"))


@register("g6_synthesize", None)
def q_g6(spark, sf_dir):
    """End to end - types, fit, sample 25 %, restore the excluded column."""
    li = table(spark, sf_dir, "lineitem").select(*GEN_COLS, "l_orderkey")
    out, _ = synthesize(li, exclude=["l_orderkey"], seed=7)
    return out


@register("g7_save_load", G1C_SQL, doubles=["p"])
def q_g7(spark, sf_dir):
    """Save the fitted model as parquet under <dir>/<name>/<version>, load it back."""
    base = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    model = synth.fit_copula(_li(spark, sf_dir))
    synth.save_model(spark, model, base, "lineitem", "v1")
    return synth.category_table(spark, synth.load_model(spark, base, "lineitem", "v1"))


G7V_SQL = """SELECT version, CAST(count(*) AS BIGINT) AS categories FROM (
  SELECT DISTINCT 'all' AS version, l_returnflag AS v FROM lineitem
  UNION ALL SELECT DISTINCT 'returned', l_returnflag FROM lineitem WHERE l_returnflag = 'R') GROUP BY version"""


@register("g7_versions", G7V_SQL)
def q_g7v(spark, sf_dir):
    """Three versions saved, one of them overwritten and one deleted; the categories of each version that is left."""
    base = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag")
    every, some = (synth.fit_copula(d) for d in (flags, flags.filter("l_returnflag = 'R'")))
    for version, model in (("all", some), ("returned", some), ("gone", every), ("all", every)):
        synth.save_model(spark, model, base, "flags", version)
    model_store.delete_version(spark, base, "flags", "gone")
    out = None
    for r in model_store.list_versions(spark, base, "flags").orderBy("version").collect():
        loaded = synth.category_table(spark, synth.load_model(spark, base, "flags", r["version"]))
        one = loaded.agg(F.count(F.lit(1)).alias("categories")).select(F.lit(r["version"]).alias("version"), "categories")
        out = one if out is None else out.unionByName(one)
    return out


def _many_values(spark, sf_dir):
    """Four rows for each line: an integer code that a third of the rows share and no other two have in common, and
    a name that is ``hot`` on about half of the lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    li = li.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    own = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 4 + F.col("copy")
    return li.select(F.when(own % 3 == 0, F.lit(7)).otherwise(own).cast("long").alias("code"),
                     F.when(F.col("l_returnflag") == "N", F.lit("hot")).otherwise(F.concat(F.lit("n"), own)).alias("name"), "l_quantity")


G2V_SQL = """SELECT CAST(4 * count(*) AS BIGINT) AS n_rows, true AS values_seen, true AS hot_code_share, true AS hot_name_share,
true AS rare_code_share, true AS rare_name_share, true AS no_nulls FROM lineitem"""


@register("g2_many_values", G2V_SQL)
def q_g2v(spark, sf_dir):
    """G1-G3 with more values than the driver's model takes: as many rows as there were.  Every code and name was seen;
    the frequent ones have their share; of values seen once 1 - 1/e are drawn, within 2 % of the rows."""
    df = _many_values(spark, sf_dir)
    n = df.count()
    out = shared_table(synth.sample_copula(spark, synth.fit_copula(df), n, seed=5), "sampled")   # generated once, read three times

    def facts(d):
        return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("code") == 7).alias("hot_code"),
                     F.count_if(F.col("name") == "hot").alias("hot_name"),
                     F.count_if(F.col("code").isNull() | F.col("name").isNull()).alias("nulls"))

    a, b = facts(df), facts(out)
    rare = []
    for c in ("code", "name"):   # rows of both tables counted together: one shuffle, no join of the values
        j = df.select(F.col(c).alias("v"), F.lit(0).alias("side")).unionByName(out.select(F.col(c).alias("v"), F.lit(1).alias("side")))
        j = j.groupBy("v").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        rare.append(j.agg(F.count_if(F.col("n0") == 0).alias(f"{c}_new"), F.count_if(F.col("n0") == 1).alias(f"{c}_once"),
                          F.count_if((F.col("n0") == 1) & (F.col("n1") > 0)).alias(f"{c}_drawn")))
    one = F.broadcast  # each table has one row
    j = a.select(*[F.col(c).alias(f"was_{c}") for c in a.columns]).join(one(b), F.lit(True)).join(one(rare[0]), F.lit(True)).join(one(rare[1]), F.lit(True))

    def share(c):
        return F.abs(F.col(f"{c}_drawn") / F.col(f"{c}_once") - (1 - math.exp(-1))) < 0.02

    return j.select(
        F.col("n").alias("n_rows"), (F.col("code_new") + F.col("name_new") == 0).alias("values_seen"),
        (F.abs(F.col("hot_code") - F.col("was_hot_code")) < 0.02 * F.col("n")).alias("hot_code_share"),
        (F.abs(F.col("hot_name") - F.col("was_hot_name")) < 0.02 * F.col("n")).alias("hot_name_share"),
        share("code").alias("rare_code_share"), share("name").alias("rare_name_share"), (F.col("nulls") == 0).alias("no_nulls"))


G4M_SQL = """WITH d AS (SELECT CAST((l_orderkey * 10 + l_linenumber) * 8 + l_partkey % 8 AS VARCHAR) AS cell, l_quantity FROM lineitem)
SELECT cell, CAST(4 * count(*) AS BIGINT) AS n_rows, min(l_quantity) AS least, max(l_quantity + 3) AS most, true AS in_range FROM d GROUP BY cell"""


@register("g4_many_conditions", G4M_SQL)
def q_g4m(spark, sf_dir):
    """G4 with about one condition for each line of an order (nearly as many as lineitem has rows): the fitted
    number of rows for each value, generated from the model's own table of strata, within the value's range."""
    li = table(spark, sf_dir, "lineitem")
    df = li.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 8 + F.col("l_partkey") % 8).cast("string").alias("cell"), F.explode(F.array(
        *[(F.col("l_quantity") + i).cast("double") for i in range(4)])).alias("quantity"), "l_extendedprice", "l_discount", "l_returnflag")
    model = synth.fit_copula(df, condition="cell")
    out = synth.sample_copula(spark, model, synth_tables.proportional_quota(model, df.count()), seed=5)
    got = out.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"), F.min("quantity").alias("lo"), F.max("quantity").alias("hi"))
    was = df.groupBy("cell").agg(F.min("quantity").alias("least"), F.max("quantity").alias("most"))
    return got.join(was, "cell").select("cell", "n_rows", "least", "most", (
        (F.col("lo") >= F.col("least") - 1e-9) & (F.col("hi") <= F.col("most") + 1e-9)).alias("in_range"))


G1J_SQL = """SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS joint_kept, true AS unordered, true AS joint_of_third_kept FROM lineitem"""


@register("g2_joint_categories", G1J_SQL)
def q_g2j(spark, sf_dir):
    """G1/G2 on unordered categories: a kind that is a permutation of another one in nine of ten rows, and a third that
    follows the second.  The joint tables of neighbours are kept within 2 %, where equal names in order tell little."""
    li = table(spark, sf_dir, "lineitem")
    a = F.pmod(F.col("l_partkey"), F.lit(4)).cast("int")
    b = F.when(F.pmod("l_suppkey", F.lit(10)) > 0, F.get(F.array(*[F.lit(x) for x in "mknl"]), a)).otherwise(
        F.get(F.array(*[F.lit(x) for x in "klmn"]), F.pmod("l_orderkey", F.lit(4)).cast("int")))
    df = li.select(F.concat(F.lit("a"), a).alias("a"), b.alias("b"), F.when(b.isin("k", "n"), F.lit("z")).otherwise(F.lit("y")).alias("c"),
                   "l_quantity")
    n = df.count()
    out = synth.sample_copula(spark, synth.fit_copula(df), n, seed=9)

    def apart(x, y):
        """Half of the sum of the differences between the shares of both joint tables."""
        was, now = (d.groupBy(x, y).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, d in enumerate((df, out)))
        return was.join(now, [x, y], "full").agg((F.sum(F.abs(F.coalesce("n0", F.lit(0)) - F.coalesce("n1", F.lit(0)))) / (2.0 * n)).alias("d")).first()["d"]

    return out.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(apart("a", "b") < 0.02).alias("joint_kept"),
        F.lit(abs(df.groupBy().agg(F.corr(F.ascii(F.substring("a", 2, 1)).cast("double"), F.ascii("b").cast("double"))).first()[0] or 0.0) < 0.5).alias("unordered"),
        F.lit(apart("b", "c") < 0.02).alias("joint_of_third_kept"))
