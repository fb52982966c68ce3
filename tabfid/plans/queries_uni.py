"""Queries for per-column fidelity (F1-F15) on the lineitem pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfid.operators import univariate as uni
from tabfid.operators.pair import TablePair
from tabfid.plans.catalog import register
from tabfid.plans.fixtures import PAIR_CATEGORICAL, PAIR_NUMERIC, lineitem_pair, table
from tabfid.plans.sqltext import melted_cte, pair_cte

NUM = PAIR_NUMERIC
CAT = PAIR_CATEGORICAL

BASE = (f"WITH {pair_cte()},\n{melted_cte('mr', 'real', NUM)},\n{melted_cte('ms', 'syn', NUM)},\n"
        "pooled AS (SELECT column_name, value, 1 AS r, 0 AS s FROM mr "
        "UNION ALL SELECT column_name, value, 0 AS r, 1 AS s FROM ms),\n"
        "cnt AS (SELECT column_name, value, sum(r) AS n_real, sum(s) AS n_syn FROM pooled GROUP BY 1, 2),\n"
        "cum AS (SELECT column_name, value, n_real, n_syn, "
        "sum(n_real) OVER w AS cum_real, sum(n_syn) OVER w AS cum_syn, "
        "sum(n_real) OVER (PARTITION BY column_name) AS tot_real, "
        "sum(n_syn) OVER (PARTITION BY column_name) AS tot_syn, "
        "lead(value) OVER (PARTITION BY column_name ORDER BY value) AS next_value FROM cnt "
        "WINDOW w AS (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")

KS_SQL = BASE + """,
per AS (SELECT column_name,
  max(abs(cum_real / tot_real - cum_syn / tot_syn)) AS ks_statistic,
  coalesce(sum(CASE WHEN next_value IS NOT NULL
      THEN abs(cum_real / tot_real - cum_syn / tot_syn) * (next_value - value) END), 0.0) AS wasserstein,
  CAST(max(tot_real) AS BIGINT) AS n_real, CAST(max(tot_syn) AS BIGINT) AS n_syn
  FROM cum GROUP BY column_name),
lam AS (SELECT *, sqrt(CAST(n_real AS DOUBLE) * n_syn / (n_real + n_syn)) * ks_statistic AS lam FROM per),
ser AS (SELECT column_name, sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * lam * lam)) AS s
  FROM lam, range(1, 101) AS t(j) GROUP BY column_name)
SELECT column_name, ks_statistic,
  CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2.0 * s, 0.0), 1.0) END AS ks_pvalue,
  wasserstein, n_real, n_syn
FROM lam JOIN ser USING (column_name)"""


@register("f1_f2_f4_ks_wasserstein", KS_SQL, doubles=["ks_statistic", "ks_pvalue", "wasserstein"])
def q_ks(spark, sf_dir):
    """two-sample KS statistic, its asymptotic p-value and Wasserstein-1 per
    numeric column, from one bucketed joint CDF table."""
    return uni.ks_wasserstein(lineitem_pair(spark, sf_dir), NUM)


EXACT_SQL = """WITH RECURSIVE mr AS (SELECT s_acctbal AS v FROM supplier WHERE s_suppkey % 3 = 0),
ms AS (SELECT s_acctbal + s_nationkey * 20 AS v FROM supplier WHERE s_suppkey % 3 > 0),
pooled AS (SELECT v, 1 AS r, 0 AS s FROM mr UNION ALL SELECT v, 0, 1 FROM ms),
cnt AS (SELECT v, sum(r) AS r, sum(s) AS s FROM pooled GROUP BY v),
cum AS (SELECT sum(r) OVER (ORDER BY v) AS cr, sum(s) OVER (ORDER BY v) AS cs, sum(r) OVER () AS n, sum(s) OVER () AS m FROM cnt),
h AS (SELECT CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, max(abs(cr * m - cs * n)) AS h FROM cum),
p AS (SELECT 0 AS s, CAST(0 AS BIGINT) AS i, CAST(1.0 AS DOUBLE) AS w, false AS far
  UNION ALL
  SELECT s + 1, j, sum(w * q), bool_or(abs(j * m - (s + 1 - j) * n) >= h) FROM (
    SELECT s, i + 1 AS j, w, (n - i) / CAST(n + m - s AS DOUBLE) AS q, n, m, h FROM p, h WHERE NOT far AND i < n
    UNION ALL
    SELECT s, i AS j, w, (m - (s - i)) / CAST(n + m - s AS DOUBLE) AS q, n, m, h FROM p, h WHERE NOT far AND s - i < m
  ) AS steps GROUP BY s, j)
SELECT 's_acctbal' AS column_name, CAST(h AS DOUBLE) / (n * m) AS ks_statistic, (SELECT sum(w) FROM p WHERE far) AS ks_pvalue,
       n AS n_real, m AS n_syn FROM h"""


@register("f2_exact_pvalue", EXACT_SQL, doubles=["ks_statistic", "ks_pvalue"])
def q_exact(spark, sf_dir):
    """F2 on a small pair (suppliers whose key 3 divides, and the others with a shifted balance): the exact p-value."""
    s = table(spark, sf_dir, "supplier")
    real = s.filter("s_suppkey % 3 = 0").select("s_acctbal")
    syn = s.filter("s_suppkey % 3 > 0").select((F.col("s_acctbal") + F.col("s_nationkey") * 20).alias("s_acctbal"))
    return uni.ks_wasserstein(TablePair(real, syn)).drop("wasserstein")


def _jsd_sql(bins: int = 50) -> str:
    return (f"WITH {pair_cte()},\n{melted_cte('mr', 'real', NUM)},\n{melted_cte('ms', 'syn', NUM)},\n"
            "rng0 AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM mr GROUP BY 1),\n"
            "rng AS (SELECT column_name, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, "
            "CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM rng0),\n"
            "pooled AS (SELECT column_name, value, 1 AS r, 0 AS s FROM mr "
            "UNION ALL SELECT column_name, value, 0, 1 FROM ms),\n"
            f"binned AS (SELECT p.column_name, least(CAST(floor((value - lo) * ({bins} / (hi - lo))) AS INTEGER), "
            f"{bins - 1}) AS bin, r, s FROM pooled p JOIN rng USING (column_name) WHERE value >= lo AND value <= hi),\n"
            "cnt AS (SELECT column_name, bin, sum(r) AS c_real, sum(s) AS c_syn FROM binned GROUP BY 1, 2),\n"
            f"grid AS (SELECT column_name, bin, (hi - lo) / {bins} AS width FROM rng, range(0, {bins}) AS t(bin)),\n"
            "g AS (SELECT g.column_name, g.bin, g.width, coalesce(c_real, 0) AS c_real, coalesce(c_syn, 0) AS c_syn "
            "FROM grid g LEFT JOIN cnt USING (column_name, bin)),\n"
            "g2 AS (SELECT *, sum(c_real) OVER (PARTITION BY column_name) AS n_real, "
            "sum(c_syn) OVER (PARTITION BY column_name) AS n_syn FROM g),\n"
            "d AS (SELECT column_name, n_syn, greatest(c_real / nullif(n_real * width, 0), 1e-10) AS dr, "
            "greatest(c_syn / nullif(n_syn * width, 0), 1e-10) AS ds FROM g2),\n"
            "pq AS (SELECT column_name, n_syn, dr / sum(dr) OVER (PARTITION BY column_name) AS p, "
            "ds / sum(ds) OVER (PARTITION BY column_name) AS q FROM d)\n"
            "SELECT column_name, CASE WHEN max(n_syn) > 0 THEN sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + "
            "q * ln(q / ((p + q) / 2))) / 2, 0.0)) END AS jsd FROM pq GROUP BY column_name")


@register("f3_jensen_shannon", _jsd_sql(), doubles=["jsd"])
def q_jsd(spark, sf_dir):
    """Jensen-Shannon distance of 50-bin densities on the real range."""
    return uni.jensen_shannon(lineitem_pair(spark, sf_dir), NUM)


def _describe_side(src: str, prefix: str) -> str:
    from tabfid.plans.sqltext import union_rows
    return union_rows([
        f"SELECT '{c}' AS column_name, count({c}) AS {prefix}_count, avg({c}) AS {prefix}_mean, "
        f"stddev_samp({c}) AS {prefix}_std, min({c}) AS {prefix}_min, quantile_cont({c}, 0.25) AS {prefix}_p25, "
        f"quantile_cont({c}, 0.5) AS {prefix}_p50, quantile_cont({c}, 0.75) AS {prefix}_p75, "
        f"max({c}) AS {prefix}_max FROM {src}" for c in NUM])


F6_SQL = (f"WITH {pair_cte()}, a AS ({_describe_side('real', 'real')}), "
          f"b AS ({_describe_side('syn', 'synthetic')})\nSELECT * FROM a JOIN b USING (column_name)")
F6_DOUBLES = [f"{s}_{n}" for s in ("real", "synthetic")
              for n in ("mean", "std", "min", "p25", "p50", "p75", "max")]


@register("f6_describe_pair", F6_SQL, doubles=F6_DOUBLES)
def q_f6(spark, sf_dir):
    """describe() of both sides side by side."""
    return uni.describe_pair(lineitem_pair(spark, sf_dir), NUM)


STATS_CTE = (f"WITH {pair_cte()},\n{melted_cte('mr', 'real', NUM)},\n{melted_cte('ms', 'syn', NUM)},\n"
             "r AS (SELECT column_name, avg(value) AS real_mean, stddev_samp(value) AS real_std, "
             "var_samp(value) AS var_real FROM mr GROUP BY 1),\n"
             "s AS (SELECT column_name, avg(value) AS synthetic_mean, stddev_samp(value) AS synthetic_std, "
             "var_samp(value) AS var_syn FROM ms GROUP BY 1),\n"
             "st AS (SELECT * FROM r JOIN s USING (column_name))\n")

F7_SQL = STATS_CTE + ("SELECT column_name, ln(abs(real_mean + 1e-10)) AS real_log_mean, "
                      "ln(real_std + 1e-10) AS real_log_std, ln(abs(synthetic_mean + 1e-10)) AS synthetic_log_mean, "
                      "ln(synthetic_std + 1e-10) AS synthetic_log_std FROM st")


@register("f7_log_summary", F7_SQL,
          doubles=["real_log_mean", "real_log_std", "synthetic_log_mean", "synthetic_log_std"])
def q_f7(spark, sf_dir):
    """log of |mean| and std per column and side."""
    return uni.log_summary(lineitem_pair(spark, sf_dir), NUM)


F8_SQL = BASE + """,
pts AS (SELECT column_name, 'real' AS side, value, cum_real / tot_real AS p FROM cum WHERE n_real > 0
        UNION ALL SELECT column_name, 'synthetic', value, cum_syn / tot_syn FROM cum WHERE n_syn > 0)
SELECT column_name, side, value,
  2 * ((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0)) - 1 AS x_norm, p
FROM pts WINDOW w AS (PARTITION BY column_name, side)"""


@register("f8_ecdf", F8_SQL, doubles=["value", "x_norm", "p"])
def q_f8(spark, sf_dir):
    """F8: empirical CDF per side with values normalised to [-1, 1]."""
    return uni.ecdf(lineitem_pair(spark, sf_dir), NUM)


F9_SQL = (f"WITH {pair_cte()},\n{melted_cte('mr', 'real', NUM)},\n{melted_cte('ms', 'syn', NUM)},\n"
          "rows_ AS (SELECT column_name, 'real' AS side, value FROM mr "
          "UNION ALL SELECT column_name, 'synthetic', value FROM ms),\n"
          "rk AS (SELECT column_name, side, value, "
          "row_number() OVER (PARTITION BY column_name, side ORDER BY value) - 1 AS rnk, "
          "count(*) OVER (PARTITION BY column_name, side) AS n FROM rows_),\n"
          "nm AS (SELECT DISTINCT column_name, side, n, least(1000, n) AS m FROM rk),\n"
          "idx AS (SELECT column_name, side, n, m, i, "
          "CASE WHEN m = 1 THEN 0 ELSE (i * (n - 1)) // (m - 1) END AS rnk FROM nm, range(0, 1000) AS t(i) "
          "WHERE i < m)\n"
          "SELECT idx.column_name, idx.side, CAST(i AS BIGINT) AS i, value, CAST(idx.rnk + 1 AS DOUBLE) / idx.n AS p "
          "FROM idx JOIN rk USING (column_name, side, rnk)")


@register("f9_cdf_curve", F9_SQL, doubles=["value", "p"])
def q_f9(spark, sf_dir):
    """CDF curve down-sampled to <= 1,000 evenly spaced ranks per side."""
    return uni.cdf_curve(lineitem_pair(spark, sf_dir), NUM, points=1000)


CAT_CNT = (f"WITH {pair_cte()},\n"
           "pooled AS (" + " UNION ALL ".join(
               [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, 1 AS r, 0 AS s FROM real "
                f"UNION ALL SELECT '{c}', CAST({c} AS VARCHAR), 0, 1 FROM syn" for c in CAT]) + "),\n"
           "cc AS (SELECT column_name, value, CAST(sum(r) AS BIGINT) AS n_real, CAST(sum(s) AS BIGINT) AS n_syn "
           "FROM pooled GROUP BY 1, 2)\n")

F10_SQL = CAT_CNT + (
    "SELECT column_name, value, n_real, n_syn, "
    "sum(n_real) OVER w / sum(n_real) OVER (PARTITION BY column_name) AS real_cdf, "
    "sum(n_syn) OVER w / sum(n_syn) OVER (PARTITION BY column_name) AS synthetic_cdf FROM cc "
    "WINDOW w AS (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@register("f10_categorical_cdf", F10_SQL, doubles=["real_cdf", "synthetic_cdf"])
def q_f10(spark, sf_dir):
    """cumulative share over sorted category values."""
    return uni.categorical_cdf(lineitem_pair(spark, sf_dir), CAT)


F11_SQL = CAT_CNT + """,
x AS (SELECT column_name, value, n_real, n_syn,
  n_real / sum(n_real) OVER (PARTITION BY column_name) AS real_share,
  n_syn / sum(n_syn) OVER (PARTITION BY column_name) AS synthetic_share,
  count(*) OVER (PARTITION BY column_name) AS n_cat,
  row_number() OVER (PARTITION BY column_name ORDER BY n_real DESC, value) AS rk_real,
  row_number() OVER (PARTITION BY column_name ORDER BY n_syn DESC, value) AS rk_syn FROM cc),
k AS (SELECT * FROM x WHERE n_cat <= 50 OR (rk_real <= 25 AND n_real > 0) OR (rk_syn <= 25 AND n_syn > 0))
SELECT column_name, value, real_share, synthetic_share,
  sum(real_share) OVER w AS real_cumsum, sum(synthetic_share) OVER w AS synthetic_cumsum FROM k
WINDOW w AS (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("f11_category_frequencies", F11_SQL,
          doubles=["real_share", "synthetic_share", "real_cumsum", "synthetic_cumsum"])
def q_f11(spark, sf_dir):
    """category shares on the union of categories with cumulative sums."""
    return uni.category_frequencies(lineitem_pair(spark, sf_dir), CAT)


F12_SQL = (f"WITH {pair_cte()},\n{melted_cte('mr', 'real', NUM)},\n{melted_cte('ms', 'syn', NUM)},\n"
           "b AS (SELECT column_name, 'real' AS side, value FROM mr "
           "UNION ALL SELECT column_name, 'synthetic', value FROM ms),\n"
           "prm AS (SELECT column_name, side, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo0, "
           "max(value) AS hi0 FROM b GROUP BY 1, 2),\n"
           "p2 AS (SELECT column_name, side, n, sd * pow(n, -0.2) AS bw, lo0, hi0 FROM prm WHERE sd > 0 AND n >= 2),\n"
           "p3 AS (SELECT column_name, side, n, bw, lo0 - 3.0 * bw AS lo, hi0 + 3.0 * bw AS hi FROM p2),\n"
           "grid AS (SELECT column_name, side, n, bw, i, lo + i * (hi - lo) / 199 AS x FROM p3, range(0, 200) AS t(i))\n"
           "SELECT g.column_name, g.side, CAST(g.i AS INTEGER) AS i, g.x, "
           "sum(exp(-0.5 * ((g.x - b.value) / g.bw) * ((g.x - b.value) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())) "
           "AS density FROM grid g JOIN b USING (column_name, side) GROUP BY g.column_name, g.side, g.i, g.x, g.n, g.bw")


@register("f12_kde_curves", F12_SQL, doubles=["x", "density:12"])
def q_f12(spark, sf_dir):
    """Gaussian KDE (Scott bandwidth) on 200 grid points per column and side."""
    return uni.kde_curves(lineitem_pair(spark, sf_dir), NUM)


F13_SQL = (f"WITH {pair_cte()},\n{melted_cte('mr', 'real', NUM)},\n{melted_cte('ms', 'syn', NUM)},\n"
           "b AS (SELECT column_name, 'real' AS side, value FROM mr "
           "UNION ALL SELECT column_name, 'synthetic', value FROM ms),\n"
           "r0 AS (SELECT column_name, side, min(value) AS lo, max(value) AS hi FROM b GROUP BY 1, 2),\n"
           "r AS (SELECT column_name, side, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, "
           "CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0),\n"
           "c AS (SELECT column_name, side, least(CAST(floor((value - lo) * (30 / (hi - lo))) AS INTEGER), 29) AS bin, "
           "count(*) AS cnt FROM b JOIN r USING (column_name, side) GROUP BY 1, 2, 3)\n"
           "SELECT r.column_name, r.side, CAST(t.bin AS INTEGER) AS bin, lo + t.bin * (hi - lo) / 30 AS lo_edge, "
           "lo + (t.bin + 1) * (hi - lo) / 30 AS hi_edge, CAST(coalesce(cnt, 0) AS BIGINT) AS count "
           "FROM r CROSS JOIN range(0, 30) AS t(bin) LEFT JOIN c ON c.column_name = r.column_name "
           "AND c.side = r.side AND c.bin = t.bin")


@register("f13_histograms", F13_SQL, doubles=["lo_edge", "hi_edge"])
def q_f13(spark, sf_dir):
    """30-bin histogram per column and side over its own range."""
    return uni.histograms(lineitem_pair(spark, sf_dir), NUM, bins=30)


F14_SQL = STATS_CTE + ("SELECT avg(abs(real_mean - synthetic_mean)) AS mean_diff, "
                       "avg(abs(real_std - synthetic_std)) AS std_diff FROM st")


@register("f14_mean_std_gap", F14_SQL, doubles=["mean_diff", "std_diff"])
def q_f14(spark, sf_dir):
    """mean over columns of |mean diff| and |std diff|."""
    return uni.mean_std_gap(lineitem_pair(spark, sf_dir), NUM)


F15_SQL = STATS_CTE + (
    "SELECT column_name, greatest(vr / vs, vs / vr) AS score FROM (SELECT column_name, "
    "CASE WHEN var_real <> 0 THEN var_real ELSE 1e-10 END AS vr, "
    "CASE WHEN var_syn <> 0 THEN var_syn ELSE 1e-10 END AS vs FROM st) AS v "
    "ORDER BY score DESC, column_name LIMIT 20")


@register("f15_most_changed_columns", F15_SQL, doubles=["score"])
def q_f15(spark, sf_dir):
    """columns ranked by variance ratio (top 20 is the feature)."""
    return uni.most_changed_columns(lineitem_pair(spark, sf_dir), NUM, top=20)


F11T_SQL = """WITH pooled AS (
  SELECT CAST(o_custkey AS VARCHAR) AS value, 1 AS r, 0 AS s FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 0, 1 FROM orders WHERE o_orderkey % 2 = 1),
cc AS (SELECT 'o_custkey' AS column_name, value, sum(r) AS n_real, sum(s) AS n_syn FROM pooled GROUP BY value),
x AS (SELECT column_name, value, n_real, n_syn,
  n_real / sum(n_real) OVER (PARTITION BY column_name) AS real_share,
  n_syn / sum(n_syn) OVER (PARTITION BY column_name) AS synthetic_share,
  count(*) OVER (PARTITION BY column_name) AS n_cat,
  row_number() OVER (PARTITION BY column_name ORDER BY n_real DESC, value) AS rk_real,
  row_number() OVER (PARTITION BY column_name ORDER BY n_syn DESC, value) AS rk_syn FROM cc),
k AS (SELECT * FROM x WHERE n_cat <= 50 OR (rk_real <= 25 AND n_real > 0) OR (rk_syn <= 25 AND n_syn > 0))
SELECT column_name, value, real_share, synthetic_share,
  sum(real_share) OVER w AS real_cumsum, sum(synthetic_share) OVER w AS synthetic_cumsum FROM k
WINDOW w AS (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("f11_category_frequencies_top", F11T_SQL,
          doubles=["real_share", "synthetic_share", "real_cumsum", "synthetic_cumsum"])
def q_f11t(spark, sf_dir):
    """F11 on a 1,500-category column (orders' customer, even vs odd orders): only the
    union of each side's top 25 categories is kept."""
    from pyspark.sql import functions as F
    from tabfid.operators.pair import TablePair
    from tabfid.plans.fixtures import table
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    pair = TablePair(o.where(F.col("o_orderkey") % 2 == 0), o.where(F.col("o_orderkey") % 2 == 1),
                     columns=["o_custkey"])
    return uni.category_frequencies(pair, ["o_custkey"])
