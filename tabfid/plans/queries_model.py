"""Queries for utility (U), scores and reports (Q) and training-log analytics (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfid.functions.hashing import portable_hash_sql
from tabfid.operators import runlog as rl
from tabfid.operators import score as sc
from tabfid.operators import utility as ut
from tabfid.operators.sampling import train_test_split
from tabfid.plans.catalog import register
from tabfid.plans.fixtures import (PAIR_CATEGORICAL, PAIR_NUMERIC, ROW_KEYS, lineitem_halves, lineitem_pair,
                                   table, training_log)
from tabfid.plans.queries_multi import J1_SQL, J2_SQL, _nn_sql
from tabfid.plans.report import evaluate_all, fidelity_metrics, metrics_frame
from tabfid.plans.sqltext import pair_cte

NUM = PAIR_NUMERIC
ALL = PAIR_NUMERIC + PAIR_CATEGORICAL
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]

# ---------------------------------------------------------------- U: utility


@register("u1_utility_classification", None)
def q_u1(spark, sf_dir):
    """Random forests (100 trees, depth 10) on real-train vs synthetic, accuracy on
    the real test split (target l_returnflag)."""
    cols = [*ROW_KEYS, *FEATURES, "l_returnflag"]
    real, syn = lineitem_halves(spark, sf_dir, columns=cols)
    return ut.ml_utility(real, syn, "l_returnflag", ROW_KEYS, "classification", features=FEATURES)


@register("u2_utility_regression", None)
def q_u2(spark, sf_dir):
    """Random forest regression of l_extendedprice, R^2 on the real test split."""
    feats = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    cols = [*ROW_KEYS, *feats, "l_extendedprice"]
    real, syn = lineitem_halves(spark, sf_dir, columns=cols)
    return ut.ml_utility(real, syn, "l_extendedprice", ROW_KEYS, "regression", features=feats)


@register("u4_utility_macro_f1", None)
def q_u4(spark, sf_dir):
    """U4: macro-F1 utility with 50 trees."""
    cols = [*ROW_KEYS, *FEATURES, "l_returnflag"]
    real, syn = lineitem_halves(spark, sf_dir, columns=cols)
    return ut.f1_utility(real, syn, "l_returnflag", ROW_KEYS)


_TEST_ROWS = (f"SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 0 AND {portable_hash_sql(ROW_KEYS)} < {int(0.2 * 2147483648)}")


PLANTED_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, true AS real_learns, true AS synthetic_learns, ({_TEST_ROWS}) AS n_test"
                                for m in ("accuracy", "macro_f1", "r2"))


@register("u1_u2_u4_planted_signal", PLANTED_SQL)
def q_u_planted(spark, sf_dir):
    """U1, U2, U4 on targets that the features tell: a band of the quantity (three classes, far above the share of the
    commonest), and a price that is linear in quantity and tax.  Both models learn them (20 trees)."""
    real, syn = lineitem_halves(spark, sf_dir, columns=[*ROW_KEYS, *FEATURES])
    band = F.concat(F.lit("band"), F.least(F.floor(F.col("l_quantity") / 18), F.lit(2)))
    worth = F.col("l_quantity") * 100 + F.col("l_tax") * 1000
    r, s = (d.withColumns({"band": band, "worth": worth}) for d in (real, syn))
    one = ut.ml_utility(r, s, "band", ROW_KEYS, "classification", num_trees=20, max_depth=6, features=FEATURES)
    two = ut.f1_utility(r, s, "band", ROW_KEYS, num_trees=20, max_depth=6, features=FEATURES).withColumn("n_test", F.lit(None).cast("long"))
    three = ut.ml_utility(r, s, "worth", ROW_KEYS, "regression", num_trees=20, max_depth=6, features=FEATURES)
    cols = ["metric", "real_score", "synthetic_score", "n_test"]
    rows = one.select(*cols).unionByName(two.select(*cols)).unionByName(three.select(*cols))
    n = one.select(F.col("n_test").alias("n")).first()["n"]
    return rows.select("metric", (F.col("real_score") >= 0.8).alias("real_learns"), (F.col("synthetic_score") >= 0.7).alias("synthetic_learns"),
                       F.coalesce("n_test", F.lit(n)).cast("long").alias("n_test"))


@register("u1_utility_bounds", f"SELECT 'accuracy' AS metric, true AS beats_nothing, true AS in_range, ({_TEST_ROWS}) AS n_test")
def q_u1b(spark, sf_dir):
    """The flag is drawn apart from the features, so on the real test split both forests are about as good as the
    share of the commonest class (less 3 %), and no better than chance allows."""
    r = q_u1(spark, sf_dir)
    real, _ = lineitem_halves(spark, sf_dir, columns=[*ROW_KEYS, "l_returnflag"])
    test = train_test_split(real, ROW_KEYS, 0.2, 42)[1]
    most = test.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("most"))
    ok = F.col("real_score").between(0, 1) & F.col("synthetic_score").between(0, 1)
    return r.join(F.broadcast(most), F.lit(True)).select(
        "metric", (F.col("real_score") >= F.col("most") - 0.03).alias("beats_nothing"), ok.alias("in_range"), "n_test")


U3_SQL = (f"WITH r AS (SELECT *, {portable_hash_sql(['o_orderkey'])} < {int(0.2 * 2147483648)} AS is_test FROM orders), "
          f"s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM r WHERE NOT is_test), "
          f"d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
          f"(SELECT o_orderpriority AS v FROM r WHERE NOT is_test UNION SELECT 'Other') AS x)\n"
          f"SELECT o_orderkey, (o_totalprice - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS o_totalprice, "
          f"CAST(coalesce(d.code, (SELECT code FROM d WHERE v = 'Other')) AS BIGINT) AS o_orderpriority "
          f"FROM r CROSS JOIN s LEFT JOIN d ON d.v = r.o_orderpriority WHERE is_test")


@register("u3_prepare_features", U3_SQL, doubles=["o_totalprice"])
def q_u3(spark, sf_dir):
    """The test split of orders, scaled and coded with the training split's state."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    train, test = train_test_split(o, ["o_orderkey"], 0.2, 42)
    (_, out), _ = ut.prepare_features(train, [test], ["o_totalprice", "o_orderpriority"])
    return out


U5C_SQL = """WITH cm AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS p, count(*) AS n
  FROM labels GROUP BY 1, 2),
by_y AS (SELECT y AS c, sum(n) AS ny, sum(CASE WHEN y = p THEN n END) AS tp FROM cm GROUP BY 1),
by_p AS (SELECT p AS c, sum(n) AS np FROM cm GROUP BY 1),
per AS (SELECT coalesce(by_y.c, by_p.c) AS c, coalesce(tp, 0) AS tp, coalesce(ny, 0) AS ny, coalesce(np, 0) AS np
  FROM by_y FULL JOIN by_p ON by_y.c = by_p.c)
SELECT sum(tp) / sum(ny) AS accuracy,
  avg(CASE WHEN ny + np > 0 THEN 2 * tp / (ny + np) ELSE 0.0 END) AS macro_f1 FROM per"""


@register("u5_classification_metrics", U5C_SQL, doubles=["accuracy", "macro_f1"])
def q_u5c(spark, sf_dir):
    """Accuracy and macro-F1 of a predictions table (labels: quality vs toxic)."""
    lab = table(spark, sf_dir, "labels")
    return ut.classification_report(lab, "quality", "toxic")


U5R_SQL = """WITH p AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS yhat
  FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT avg(y) AS mean FROM p),
a AS (SELECT sum((y - mean) * (y - mean)) AS sst, sum((y - yhat) * (y - yhat)) AS ssr FROM p, m)
SELECT CASE WHEN sst > 0 THEN 1 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM a"""


@register("u5_r2", U5R_SQL, doubles=["r2"])
def q_u5r(spark, sf_dir):
    """R^2 of a predictions table (price vs quantity x retail price)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    pred = li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    return ut.r2_score(pred)


# ---------------------------------------------------------------- Q: scores and reports

def _j5_all_sql() -> str:
    cp = ", ".join(ALL)
    return (f"WITH {pair_cte(ALL)},\ni AS (SELECT {cp} FROM real INTERSECT SELECT {cp} FROM syn)\n"
            f"SELECT (SELECT count(*) FROM i) / (SELECT count(*) FROM syn) * 100 AS duplicate_rows_percentage")


Q2_SQL = f"""WITH j1 AS ({J1_SQL}), j2 AS ({J2_SQL}), j5 AS ({_j5_all_sql()}), j6 AS ({_nn_sql()}),
m AS (SELECT * FROM j1, j2, j5, j6),
c AS (SELECT
  least(greatest(0.6 * correlation_similarity + 0.25 * greatest(0.0, 1 - least(correlation_distance_rmse, 1.0))
    + 0.15 * greatest(0.0, 1 - least(correlation_distance_mae, 1.0)), 0.0), 1.0) AS structural,
  least(greatest(0.7 * greatest(0.0, 1 - least(nearest_neighbor_mean / 10, 1.0))
    + 0.3 * greatest(0.0, 1 - least(nearest_neighbor_std / 5, 1.0)), 0.0), 1.0) AS distribution,
  greatest(0.0, 1 - duplicate_rows_percentage / 100) AS privacy, 0.5 AS utility FROM m),
o AS (SELECT *, least(greatest(0.35 * structural + 0.25 * distribution + 0.15 * privacy + 0.25 * utility, 0.0), 1.0)
  AS overall_score, least(structural, distribution, privacy, utility) AS low FROM c)
SELECT overall_score, {{lab:overall_score}} AS overall_label, structural, distribution, privacy, utility,
  {{lab:structural}} AS structural_label, {{lab:distribution}} AS distribution_label,
  {{lab:privacy}} AS privacy_label, {{lab:utility}} AS utility_label,
  CASE WHEN structural = low THEN 'Structural' WHEN distribution = low THEN 'Distribution'
       WHEN privacy = low THEN 'Privacy' ELSE 'Utility' END AS focus_area,
  CASE WHEN structural = low THEN '{sc.ADVICE['structural']}' WHEN distribution = low THEN '{sc.ADVICE['distribution']}'
       WHEN privacy = low THEN '{sc.ADVICE['privacy']}' ELSE '{sc.ADVICE['utility']}' END AS advice
FROM o"""


def _label_sql(c: str) -> str:
    parts = " ".join(f"WHEN {c} >= {b} THEN '{n}'" for b, n in sc.LABELS)
    return f"CASE {parts} ELSE '{sc.LOWEST_LABEL}' END"


for _c in ("overall_score", "structural", "distribution", "privacy", "utility"):
    Q2_SQL = Q2_SQL.replace("{lab:" + _c + "}", _label_sql(_c))


def _metrics(spark, sf_dir, with_pca: bool = False):
    pair = lineitem_pair(spark, sf_dir, ALL)
    m = fidelity_metrics(pair, NUM)
    if not with_pca:
        m.pop("pca_similarity", None)
    return metrics_frame(spark, m)


Q2_DOUBLES = ["overall_score", "structural", "distribution", "privacy", "utility"]


@register("q2_q4_quality_details", Q2_SQL, doubles=Q2_DOUBLES)
def q_q2(spark, sf_dir):
    """Q2-Q4: category scores, overall score, labels and advice from J1/J2/J5/J6 of
    the lineitem pair (utility 0.5 as in the reference)."""
    return sc.quality_details(_metrics(spark, sf_dir))


Q5_SQL = (f"WITH d AS ({Q2_SQL})\n" + "\nUNION ALL\n".join(
    f"SELECT '{c.capitalize()}' AS dimension, {c} AS score, {_label_sql(c)} AS rating, "
    f"CASE WHEN {c} >= 0.8 THEN 'green' WHEN {c} >= 0.6 THEN 'yellow' WHEN {c} >= 0.4 THEN 'orange' "
    f"ELSE 'red' END AS colour FROM d" for c in sc.CATEGORIES))


@register("q5_dimension_table", Q5_SQL, doubles=["score"])
def q_q5(spark, sf_dir):
    """Q5: dimension table with rating and colour band."""
    return sc.dimension_table(sc.quality_details(_metrics(spark, sf_dir)))


# reference-mode PCA similarity is 0 where the sides' means differ at all (the real means are 0), as they do here
Q1_SQL = f"""WITH j1 AS ({J1_SQL}), j2 AS ({J2_SQL}), j5 AS ({_j5_all_sql()}), j6 AS ({_nn_sql()})
SELECT least(greatest(0.25 * correlation_similarity + 0.25 * greatest(0.0, 1 - least(correlation_distance_rmse, 1.0))
  + 0.2 * greatest(0.0, 1 - least(nearest_neighbor_mean / 10, 1.0)) + 0.2 * 0.0
  + 0.1 * greatest(0.0, 1 - duplicate_rows_percentage / 100), 0.0), 1.0) AS similarity_score FROM j1, j2, j5, j6"""


@register("q1_similarity_score", Q1_SQL, doubles=["similarity_score"])
def q_q1(spark, sf_dir):
    """Q1: weighted similarity score from J1, J2, J5, J6 and J7."""
    return sc.similarity_score(_metrics(spark, sf_dir, with_pca=True))


SECTIONS = {"duplicate_rows_percentage": "privacy", "nearest_neighbor_mean": "privacy", "nearest_neighbor_std": "privacy",
            "correlation_distance_rmse": "correlation", "correlation_distance_mae": "correlation",
            "correlation_similarity": "correlation", "similarity_score": "similarity"}
Q8_SQL = (f"WITH m AS (SELECT * FROM ({J1_SQL}), ({J2_SQL}), ({_j5_all_sql()}), ({_nn_sql()}), ({Q1_SQL}))\n" + "\nUNION ALL\n".join(
    f"SELECT '{s}' AS section, '{k}' AS key, CAST({k} AS DOUBLE) AS value FROM m" for k, s in SECTIONS.items())
    + "".join(f"\nUNION ALL SELECT 'classifier', '{k}', 1.0" for k in ("real_f1", "synthetic_f1", "utility_score")))


def _summary(spark, sf_dir):
    """Q8 with the classifier section (U4: target l_returnflag, 20 trees)."""
    real, syn = lineitem_halves(spark, sf_dir, columns=[*ROW_KEYS, *FEATURES, "l_returnflag"])
    f1 = ut.f1_utility(real, syn, "l_returnflag", ROW_KEYS, num_trees=20, max_depth=5, features=FEATURES)
    return sc.summary(_metrics(spark, sf_dir, with_pca=True), f1)


@register("q8_summary", None)
def q_q8(spark, sf_dir):
    """Q8: nested summary (classifier, privacy, correlation, similarity) with measured values."""
    return _summary(spark, sf_dir)


@register("q8_summary_checks", Q8_SQL, doubles=["value"])
def q_q8c(spark, sf_dir):
    """Q8 by value; the classifier's (three equally frequent classes drawn apart from the features) read 1 if F1 is
    between a fifth and a half and the ratio between a half and two."""
    f1 = F.col("value").between(0.2, 0.5) & (F.col("key") != "utility_score")
    ratio = F.col("value").between(0.5, 2.0) & (F.col("key") == "utility_score")
    value = F.when(F.col("section") == "classifier", F.when(f1 | ratio, 1.0).otherwise(0.0)).otherwise(F.col("value"))
    return _summary(spark, sf_dir).withColumn("value", value)


@register("q6_full_report", None)
def q_q6(spark, sf_dir):
    """Q6: the full report (every metric with the ML utility of l_returnflag, 20 trees; failures recorded, never fatal)."""
    real, _ = lineitem_halves(spark, sf_dir, columns=[*ROW_KEYS, *[c for c in ALL if c not in ROW_KEYS]])
    return evaluate_all(lineitem_pair(spark, sf_dir, ALL), NUM, target="l_returnflag", keys=ROW_KEYS, keyed_real=real,
                        num_trees=20, max_depth=5)


# ---------------------------------------------------------------- L: training-log analytics

LOG_CTE = ("log AS (SELECT user_id AS run_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS epoch, "
           "event_id AS batch, event_type AS metric, value FROM events)")
LOSS = "error"


@register("l1_epoch_means",
          f"WITH {LOG_CTE}\nSELECT run_id, epoch, metric, avg(value) AS value FROM log GROUP BY 1, 2, 3",
          doubles=["value"])
def q_l1(spark, sf_dir):
    """L1: mean of each metric per run and epoch."""
    return rl.epoch_means(training_log(spark, sf_dir))


@register("l1_epoch_totals",
          f"WITH {LOG_CTE}, m AS (SELECT run_id, epoch, metric, avg(value) AS value FROM log GROUP BY 1, 2, 3)\n"
          "SELECT run_id, epoch, sum(value) AS total FROM m GROUP BY 1, 2", doubles=["total"])
def q_l1b(spark, sf_dir):
    """L1: sum of the metric means per run and epoch."""
    return rl.epoch_totals(training_log(spark, sf_dir))


L_EPOCHS = (f"WITH {LOG_CTE}, e AS (SELECT run_id, epoch, avg(value) AS value FROM log "
            f"WHERE metric = '{LOSS}' GROUP BY 1, 2)")

L2_SQL = (L_EPOCHS + ", r AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, "
          "row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS rk FROM e)\n"
          "SELECT run_id, -avg(value) AS score, CAST(max(n) AS BIGINT) AS epochs FROM r "
          "WHERE rk <= greatest(1, floor(n * 0.1)) GROUP BY run_id")


@register("l2_trial_scores", L2_SQL, doubles=["score"])
def q_l2(spark, sf_dir):
    """L2: trial score = -mean loss of the last 10 % of epochs (loss = 'error' events)."""
    return rl.trial_scores(training_log(spark, sf_dir), LOSS)


L3_SQL = (L_EPOCHS + ", a AS (SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY epoch "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e), "
          "b AS (SELECT *, prev IS NULL OR value < prev AS improved FROM a), "
          "c AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run_id ORDER BY epoch "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM b), "
          "d AS (SELECT *, row_number() OVER (PARTITION BY run_id, grp ORDER BY epoch) - 1 AS streak FROM c)\n"
          "SELECT run_id, min(CASE WHEN streak >= 5 THEN epoch END) AS stop_epoch, min(value) AS best_value, "
          "arg_min(epoch, (value, epoch)) AS best_epoch, count(*) AS epochs FROM d GROUP BY run_id")


@register("l3_early_stopping", L3_SQL, doubles=["best_value"])
def q_l3(spark, sf_dir):
    """L3: best loss so far and the epoch where 5 epochs without improvement stop a run."""
    return rl.early_stopping(training_log(spark, sf_dir), LOSS)


L4_SQL = (f"WITH s AS ({L2_SQL}), h AS (SELECT run_id, score, max((coalesce(score, '-inf'::DOUBLE), -run_id)) "
          "OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM s)\n"
          "SELECT run_id, score, b[1] AS best_score, -b[2] AS best_trial FROM h")


@register("l4_best_trial", L4_SQL, doubles=["score", "best_score"])
def q_l4(spark, sf_dir):
    """L4: trial history with the running best (first best wins)."""
    return rl.best_trial(rl.trial_scores(training_log(spark, sf_dir), LOSS), "run_id").select(
        "run_id", "score", "best_score", "best_trial")


@register("l5_run_summary",
          f"WITH {LOG_CTE}\nSELECT run_id, metric, arg_max(value, (epoch, batch)) AS last_value, "
          "max(epoch) AS last_epoch FROM log GROUP BY 1, 2", doubles=["last_value"])
def q_l5(spark, sf_dir):
    """Last value of each metric per run."""
    return rl.run_summary(training_log(spark, sf_dir))
