"""Query catalog: each registered function runs one operator on the test tables."""

from __future__ import annotations

from tabfid.operators import univariate as uni
from tabfid.plans.catalog import register
from tabfid.plans.fixtures import PAIR_NUMERIC, lineitem_pair
from tabfid.plans.report import evaluate, evaluate_all, short_evaluation_table
from tabfid.plans.sqltext import melted_cte, pair_cte
from tabfid.plans import (queries_base, queries_model, queries_multi, queries_synth,  # noqa: F401
                          queries_transform, queries_uni)

NUM = PAIR_NUMERIC


def _side_stats_sql(stats: dict[str, str]) -> str:
    """per-side stats over melted real/syn, joined on column_name"""
    r = ", ".join(f"{fn} AS real_{name}" for name, fn in stats.items())
    s = ", ".join(f"{fn} AS synthetic_{name}" for name, fn in stats.items())
    return (f"WITH {pair_cte()},\n{melted_cte('mr', 'real', NUM)},\n{melted_cte('ms', 'syn', NUM)},\n"
            f"r AS (SELECT column_name, {r} FROM mr GROUP BY column_name),\n"
            f"s AS (SELECT column_name, {s} FROM ms GROUP BY column_name)\n")


F5_SQL = _side_stats_sql({"mean": "avg(value)", "std": "stddev_samp(value)",
                          "min": "min(value)", "max": "max(value)"}) + """
SELECT column_name, real_mean, synthetic_mean, real_std, synthetic_std, real_min,
       synthetic_min, real_max, synthetic_max,
       abs((real_mean - synthetic_mean) / CASE WHEN real_mean <> 0 THEN real_mean ELSE 1e-10 END) * 100
         AS mean_diff_pct
FROM r JOIN s USING (column_name)"""


@register("f5_column_statistics", F5_SQL,
          doubles=["real_mean", "synthetic_mean", "real_std", "synthetic_std", "real_min",
                   "synthetic_min", "real_max", "synthetic_max", "mean_diff_pct"])
def q_f5(spark, sf_dir):
    """side-by-side mean/std/min/max per numeric column of the lineitem pair."""
    return uni.column_statistics(lineitem_pair(spark, sf_dir), NUM)


STATS = ["real_mean", "synthetic_mean", "real_std", "synthetic_std", "real_min", "synthetic_min", "real_max", "synthetic_max",
         "mean_diff_pct"]


def _long_sql(sql: str, part: str, measures: list[str], point: str = "CAST(NULL AS VARCHAR)", name: str = "column_name") -> str:
    """Rows (part, column_name, point, measure, value) of one part's SQL."""
    return "\nUNION ALL\n".join(f"SELECT '{part}' AS part, {name} AS column_name, {point} AS point, '{m}' AS measure, "
                                 f"CAST({m} AS DOUBLE) AS value FROM {part}" for m in measures)


Q7_PARTS = [("statistics", queries_uni.KS_SQL, ["ks_statistic", "ks_pvalue", "wasserstein", "n_real", "n_syn"], {}),
            ("correlation", queries_multi.J1_SQL, ["correlation_similarity"], {"name": "CAST(NULL AS VARCHAR)"}),
            ("column_stats", F5_SQL, STATS, {}),
            ("log_summary", queries_uni.F7_SQL, ["real_log_mean", "real_log_std", "synthetic_log_mean", "synthetic_log_std"], {}),
            ("cdf_curve", queries_uni.F9_SQL, ["value", "p"], {"point": "side || ':' || i"})]
Q7_SQL = ("WITH " + ",\n".join(f"{p} AS ({sql})" for p, sql, _, _ in Q7_PARTS) + "\n"
          + "\nUNION ALL\n".join(_long_sql(sql, p, ms, **kw) for p, sql, ms, kw in Q7_PARTS))


@register("q7_short_evaluation", Q7_SQL, doubles=["value"])
def q_q7(spark, sf_dir):
    """Q7: all five parts of the short evaluation in one table (part, column_name, point, measure, value)."""
    return short_evaluation_table(evaluate(lineitem_pair(spark, sf_dir, queries_model.ALL), NUM))


SCALARS = {"correlation_similarity": "j1", "correlation_distance_rmse": "j2", "correlation_distance_mae": "j2", "duplicate_rows_count": "j5",
           "duplicate_rows_percentage": "j5", "nearest_neighbor_mean": "j6", "nearest_neighbor_std": "j6", "similarity_score": "q1",
           "overall_score": "q2", "structural": "q2", "distribution": "q2", "privacy": "q2", "utility": "q2"}
Q6_SQL = (f"WITH ks AS ({queries_uni.KS_SQL}), js AS ({queries_uni._jsd_sql()}), cs AS ({F5_SQL}), j1 AS ({queries_multi.J1_SQL}), "
          f"j2 AS ({queries_multi.J2_SQL}), j6 AS ({queries_multi._nn_sql()}), q1 AS ({queries_model.Q1_SQL}), q2 AS ({queries_model.Q2_SQL}),\n"
          f"j5 AS (WITH {pair_cte(queries_model.ALL)}, b AS (SELECT * FROM real INTERSECT SELECT * FROM syn) SELECT (SELECT count(*) FROM b) AS duplicate_rows_count, "
          f"(SELECT count(*) FROM b) / (SELECT count(*) FROM syn) * 100 AS duplicate_rows_percentage)\n"
          + "\nUNION ALL\n".join(
              [f"SELECT '{m}' AS metric, column_name, CAST({m} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS error FROM {t}"
               for t, ms in (("ks", ["ks_statistic", "ks_pvalue", "wasserstein"]), ("js", ["jsd"]), ("cs", STATS)) for m in ms]
              + [f"SELECT '{m if t != 'q2' or m == 'overall_score' else m + '_score'}', NULL, CAST({m} AS DOUBLE), NULL FROM {t}"
                 for m, t in SCALARS.items()]
              + ["SELECT 'pca_similarity', NULL, 0.0, NULL"]))


@register("q6_report_values", Q6_SQL, doubles=["value"])
def q_q6v(spark, sf_dir):
    """Q6 without a target: every value of the report (the ML utility of q6_full_report has no SQL form)."""
    return evaluate_all(lineitem_pair(spark, sf_dir, queries_model.ALL), NUM)
