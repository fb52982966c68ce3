"""Per-column fidelity of a (real, synthetic) pair (ops F1-F15)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfid.functions.exprs import safe_div
from tabfid.operators.pair import SIDE, TablePair, cdf_table, running_sums, side_agg, stats_long

# fixed constants of the reference's metrics
MEAN_EPS = 1e-10          # denominator for a zero real mean (F5) and log terms (F7)
JSD_BINS = 50             # F3 histogram bins on the real range
JSD_FLOOR = 1e-10         # density floor before renormalising (F3)
KS_TERMS = 100            # terms of the Kolmogorov series (F2)
KDE_TERMS, KDE_BIN = 16, 0.5   # F12: powers summed per bin, and the bin's width in bandwidths


def column_statistics(pair: TablePair, cols: list[str] | None = None) -> DataFrame:
    """mean, std (n-1), min, max of both sides and ``mean_diff_pct``."""
    cols = cols or pair.numeric
    row = side_agg(pair, cols, {"mean": F.avg, "std": F.stddev_samp,
                                "min": F.min, "max": F.max})
    out = {}
    for stat in ("mean", "std", "min", "max"):
        out[f"real_{stat}"] = f"{stat}__0"
        out[f"synthetic_{stat}"] = f"{stat}__1"
    long = stats_long(row, cols, out)
    denom = F.when(F.col("real_mean") != 0, F.col("real_mean")).otherwise(F.lit(MEAN_EPS))
    return long.withColumn(
        "mean_diff_pct",
        F.abs((F.col("real_mean") - F.col("synthetic_mean")) / denom) * 100)

KS_MIN_LAMBDA = 0.2       # below this the Kolmogorov tail is 1 to 1e-10; series not used


def ks_pvalue(d: "F.Column", n_real: "F.Column", n_syn: "F.Column") -> "F.Column":
    """asymptotic two-sided p-value p = 2 sum_j (-1)^(j-1) exp(-2 j^2 lambda^2),
    lambda = sqrt(nr ns / (nr + ns)) * D, clipped to [0, 1]; 1 when lambda < 0.2."""
    en = n_real * n_syn / (n_real + n_syn)
    lam = F.sqrt(en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(-2.0 * j * j * lam * lam))
    p = F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0))
    return F.when(lam < KS_MIN_LAMBDA, F.lit(1.0)).otherwise(p)


KS_EXACT_ROWS = 10_000    # up to so many rows on either side the p-value is exact


def exact_ks_pvalue(d: float, n_real: int, n_syn: int) -> float:
    """P(D >= d) for two samples of these sizes from one continuous distribution.

    The pooled order of the rows is a lattice path from (0, 0) to (n_real, n_syn), all paths alike.  Diagonal by
    diagonal, ``inside[i]`` is the probability that the path is at (i, s - i) and has stayed below
    d; what steps out is added up, so that small values keep their digits.
    """
    g = math.gcd(n_real, n_syn)
    a, b = n_real // g, n_syn // g
    h = int(round(d * a * n_syn))  # D in units of 1 / lcm
    if h <= 0:
        return 1.0
    i = np.arange(n_real + 1, dtype=np.int64)
    inside, out = np.zeros(n_real + 1), 0.0
    inside[0] = 1.0
    for s in range(1, n_real + n_syn + 1):
        rest = n_real + n_syn - s + 1
        lo, hi = max(0, s - n_syn), min(n_real, s)
        nxt = np.zeros(hi - lo + 1)
        at = i[lo:hi + 1]
        up = at[at > 0]
        nxt[len(at) - len(up):] += inside[up - 1] * ((n_real - up + 1) / rest)
        nxt += inside[lo:hi + 1] * ((n_syn - (s - 1 - at)) / rest)
        far = np.abs(at * b - (s - at) * a) >= h
        out += float(nxt[far].sum())
        nxt[far] = 0.0
        inside[lo:hi + 1] = nxt
        if lo:
            inside[lo - 1] = 0.0
    return min(out, 1.0)


def ks_wasserstein(pair: TablePair, cols: list[str] | None = None, cdf: DataFrame | None = None,
                   **cdf_kw) -> DataFrame:
    """F1, F2, F4 from one joint CDF table.

    ks_statistic = max |F_real - F_syn| over pooled values; wasserstein = sum over
    consecutive pooled values of |F_real - F_syn| * gap.  The p-value is exact up to ``KS_EXACT_ROWS`` rows on
    the larger side (``exact_ks_pvalue``, one small computation per column), beyond the asymptotic form.
    """
    cols = cols or pair.numeric
    cdf = cdf if cdf is not None else cdf_table(pair, cols, **cdf_kw)
    diff = F.abs(safe_div(F.col("cum_real"), F.col("tot_real")) - safe_div(F.col("cum_syn"), F.col("tot_syn")))
    per = cdf.groupBy("column_name").agg(
        F.max(diff).alias("ks_statistic"),
        F.sum(F.when(F.col("next_value").isNotNull(),
                     diff * (F.col("next_value") - F.col("value")))).alias("wasserstein"),
        F.first("tot_real").alias("n_real"), F.first("tot_syn").alias("n_syn"))
    limit = KS_EXACT_ROWS

    def exact(d: pd.Series, n_real: pd.Series, n_syn: pd.Series) -> pd.Series:
        return pd.Series([exact_ks_pvalue(x, int(a), int(b)) if a and b and max(a, b) <= limit and x == x else None
                          for x, a, b in zip(d, n_real, n_syn)], dtype="float64")

    per = per.withColumn("_exact", F.pandas_udf(exact, "double")("ks_statistic", "n_real", "n_syn"))
    return per.select(
        "column_name", "ks_statistic",
        F.coalesce(F.nanvl("_exact", F.lit(None).cast("double")), ks_pvalue(
            F.col("ks_statistic"), F.col("n_real").cast("double"), F.col("n_syn").cast("double"))).alias("ks_pvalue"),
        F.coalesce(F.col("wasserstein"), F.lit(0.0)).alias("wasserstein"),
        F.col("n_real").cast("long").alias("n_real"), F.col("n_syn").cast("long").alias("n_syn"))


def _real_ranges(pair: TablePair, cols: list[str], side: int | None = 0) -> dict[str, tuple]:
    """min/max per column of one side (or both), one aggregate; k x 2 numbers."""
    df = pair.real if side == 0 else pair.synthetic
    row = df.agg(*[x for c in cols for x in (F.min(F.col(c).cast("double")).alias(f"{c}__lo"),
                                             F.max(F.col(c).cast("double")).alias(f"{c}__hi"))]).first()
    return {c: (row[f"{c}__lo"], row[f"{c}__hi"]) for c in cols}


def _numpy_range(lo, hi):
    """np.histogram range rule: an empty range is widened by 0.5 on both sides."""
    if lo is None:
        return None
    if lo == hi:
        return lo - 0.5, hi + 0.5
    return lo, hi


def _bin_expr(v: "F.Column", lo: float, hi: float, bins: int) -> "F.Column":
    """bin index as np.histogram computes it for equal bins; null outside [lo, hi]."""
    raw = F.floor((v - F.lit(lo)) * F.lit(bins / (hi - lo))).cast("int")
    return F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.least(raw, F.lit(bins - 1)))


def _grid(spark, cols: list[str], bins: int) -> DataFrame:
    """(column_name, bin) for every column and bin: k x bins rows."""
    return spark.createDataFrame([(c, b) for c in cols for b in range(bins)],
                                 "column_name string, bin int")


def jensen_shannon(pair: TablePair, cols: list[str] | None = None, bins: int = JSD_BINS) -> DataFrame:
    """Jensen-Shannon distance (natural log) between 50-bin densities on the real
    range; synthetic values outside it are dropped; densities floored at 1e-10 before
    renormalising.  Null when no synthetic value falls in the range."""
    cols = cols or pair.numeric
    ranges = {c: _numpy_range(*r) for c, r in _real_ranges(pair, cols).items()}
    cols = [c for c in cols if ranges[c] is not None]
    spark = pair.real.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, jsd double")
    t = pair.tagged(cols, as_double=True)
    long = t.select(SIDE, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 _bin_expr(F.col(c), ranges[c][0], ranges[c][1], bins).alias("bin"))
        for c in cols])))
    counts = long.where(F.col("bin").isNotNull()).groupBy("column_name", "bin").agg(
        F.sum(1 - F.col(SIDE)).alias("c_real"), F.sum(F.col(SIDE)).alias("c_syn"))
    width = spark.createDataFrame([(c, (ranges[c][1] - ranges[c][0]) / bins) for c in cols],
                                  "column_name string, width double")
    g = _grid(spark, cols, bins).join(counts, ["column_name", "bin"], "left").join(
        F.broadcast(width), "column_name").fillna(0, ["c_real", "c_syn"])
    wc = Window.partitionBy("column_name")
    g = g.select("column_name", "bin", "c_real", "c_syn", "width",
                 F.sum("c_real").over(wc).alias("n_real"), F.sum("c_syn").over(wc).alias("n_syn"))
    g = g.select("column_name", "n_syn",
                 F.greatest(safe_div(F.col("c_real"), F.col("n_real") * F.col("width")),
                            F.lit(JSD_FLOOR)).alias("dr"),
                 F.greatest(safe_div(F.col("c_syn"), F.col("n_syn") * F.col("width")),
                            F.lit(JSD_FLOOR)).alias("ds"))
    g = g.select("column_name", "n_syn",
                 (F.col("dr") / F.sum("dr").over(wc)).alias("p"),
                 (F.col("ds") / F.sum("ds").over(wc)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    g = g.select("column_name", "n_syn",
                 (F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)).alias("t"))
    return g.groupBy("column_name").agg(
        F.when(F.max("n_syn") > 0, F.sqrt(F.greatest(F.sum("t") / 2, F.lit(0.0)))).alias("jsd"))


def describe_pair(pair: TablePair, cols: list[str] | None = None, approx: bool | None = None) -> DataFrame:
    """describe() of both sides, side by side (one aggregate per side)."""
    from tabfid.sources.io import describe
    cols = cols or pair.numeric
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    r = describe(pair.real, cols, approx=approx).select(
        "column_name", *[F.col(n).alias(f"real_{n}") for n in names])
    s = describe(pair.synthetic, cols, approx=approx).select(
        "column_name", *[F.col(n).alias(f"synthetic_{n}") for n in names])
    return r.join(s, "column_name")


def log_summary(pair: TablePair, cols: list[str] | None = None) -> DataFrame:
    """ln|mean + 1e-10| and ln(std + 1e-10) per column and side."""
    st = column_statistics(pair, cols)
    out = [F.col("column_name")]
    for side in ("real", "synthetic"):
        out += [F.log(F.abs(F.col(f"{side}_mean") + MEAN_EPS)).alias(f"{side}_log_mean"),
                F.log(F.col(f"{side}_std") + MEAN_EPS).alias(f"{side}_log_std")]
    return st.select(*out)


def ecdf(pair: TablePair, cols: list[str] | None = None, cdf: DataFrame | None = None,
         **cdf_kw) -> DataFrame:
    """F8: empirical CDF per side, values normalised to [-1, 1] by that side's range.

    One point per distinct value (the top of each step).  A constant side gives null x.
    """
    cols = cols or pair.numeric
    cdf = cdf if cdf is not None else cdf_table(pair, cols, **cdf_kw)
    outs = []
    for side, n_col, cum, tot in (("real", "n_real", "cum_real", "tot_real"),
                                  ("synthetic", "n_syn", "cum_syn", "tot_syn")):
        s = cdf.where(F.col(n_col) > 0).select(
            "column_name", F.lit(side).alias("side"), "value",
            safe_div(F.col(cum), F.col(tot)).alias("p"))
        outs.append(s)
    pts = outs[0].unionByName(outs[1])
    # two rows per column; the points themselves are not gathered by column
    return pts.join(F.broadcast(_side_ranges(cdf)), ["column_name", "side"]).select(
        "column_name", "side", "value", (2 * safe_div(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) - 1).alias("x_norm"), "p")


def _side_ranges(cdf: DataFrame) -> DataFrame:
    """per column and side: min, max, n from the CDF table (k x 2 rows)."""
    r = cdf.where(F.col("n_real") > 0).groupBy("column_name").agg(
        F.lit("real").alias("side"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.first("tot_real").alias("n"))
    s = cdf.where(F.col("n_syn") > 0).groupBy("column_name").agg(
        F.lit("synthetic").alias("side"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.first("tot_syn").alias("n"))
    return r.unionByName(s)


def cdf_curve(pair: TablePair, cols: list[str] | None = None, points: int = 1000,
              cdf: DataFrame | None = None, **cdf_kw) -> DataFrame:
    """down-sampled CDF curve: m = min(points, n) evenly spaced ranks per side
    r_i = floor(i (n-1) / (m-1)) (each side uses its own n), value at that rank and
    p = (r_i + 1) / n.  Ranks come from the cumulative counts, so no row is ranked
    individually: each distinct value emits only the sample indexes it covers."""
    cols = cols or pair.numeric
    cdf = cdf if cdf is not None else cdf_table(pair, cols, **cdf_kw)
    outs = []
    for side, n_col, cum, tot in (("real", "n_real", "cum_real", "tot_real"),
                                  ("synthetic", "n_syn", "cum_syn", "tot_syn")):
        s = cdf.where(F.col(n_col) > 0).selectExpr(
            "column_name", f"'{side}' AS side", "value",
            f"CAST({tot} AS BIGINT) AS n", f"least(CAST({points} AS BIGINT), CAST({tot} AS BIGINT)) AS m",
            f"CAST({cum} - {n_col} AS BIGINT) AS lo_rank", f"CAST({cum} - 1 AS BIGINT) AS hi_rank")
        # exact integer arithmetic: smallest i with (i*(n-1)) div (m-1) >= lo_rank and
        # largest i with (i*(n-1)) div (m-1) <= hi_rank
        s = s.selectExpr(
            "column_name", "side", "value", "n", "m",
            "CASE WHEN m = 1 THEN (CASE WHEN lo_rank = 0 THEN 0 ELSE 1 END) "
            "ELSE (lo_rank * (m - 1) + n - 2) div (n - 1) END AS i_min",
            "CASE WHEN m = 1 THEN 0 "
            "ELSE least(((hi_rank + 1) * (m - 1) + n - 2) div (n - 1) - 1, m - 1) END AS i_max")
        s = s.where("i_min <= i_max").selectExpr(
            "column_name", "side", "value", "n", "m", "explode(sequence(i_min, i_max)) AS i")
        s = s.selectExpr(
            "column_name", "side", "i", "value",
            "CAST(CASE WHEN m = 1 THEN 0 ELSE (i * (n - 1)) div (m - 1) END + 1 AS DOUBLE) / n AS p")
        outs.append(s)
    return outs[0].unionByName(outs[1])


def category_counts(pair: TablePair, cols: list[str] | None = None) -> DataFrame:
    """(column_name, value, n_real, n_syn) for categorical columns, map-side combined."""
    cols = cols or pair.categorical
    t = pair.tagged(cols)
    long = t.select(SIDE, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in cols])))
    return long.groupBy("column_name", "value").agg(
        F.sum(1 - F.col(SIDE)).alias("n_real"), F.sum(F.col(SIDE)).alias("n_syn"))


def categorical_cdf(pair: TablePair, cols: list[str] | None = None,
                    small_limit: int = 1_000_000) -> DataFrame:
    """cumulative share over sorted category values, per side (running sums over
    the category count table; range-partitioned when it is large)."""
    cc = category_counts(pair, cols)
    r = running_sums(cc, ["column_name"], ["value"], ["n_real", "n_syn"], small_limit=small_limit)
    return r.select("column_name", "value", "n_real", "n_syn",
                    safe_div(F.col("n_real_cum"), F.col("n_real_tot")).alias("real_cdf"),
                    safe_div(F.col("n_syn_cum"), F.col("n_syn_tot")).alias("synthetic_cdf"))


def category_frequencies(pair: TablePair, cols: list[str] | None = None,
                         max_categories: int = 50, top_per_side: int = 25,
                         small_limit: int = 1_000_000) -> DataFrame:
    """normalised counts on the union of categories; when a column has more than
    ``max_categories`` categories, keep the union of each side's top 25 (count desc,
    value asc); cumulative shares over the sorted kept categories.

    Ranks are running counts over the category table (range-partitioned when large),
    so the only per-column window runs over at most ``max_categories`` kept rows."""
    cc = category_counts(pair, cols)
    n_cat = cc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_cat"),
                                          F.sum("n_real").alias("t_real"), F.sum("n_syn").alias("t_syn"))
    cc = cc.join(F.broadcast(n_cat), "column_name").withColumn("_one", F.lit(1))   # one row per column
    for side in ("real", "syn"):
        cc = cc.withColumn("_neg", -F.col(f"n_{side}"))
        cc = running_sums(cc, ["column_name"], ["_neg", "value"], ["_one"], small_limit=small_limit) \
            .withColumnRenamed("_one_cum", f"rk_{side}").drop("_one_tot", "_neg")
    keep = (F.col("n_cat") <= max_categories) | \
        ((F.col("rk_real") <= top_per_side) & (F.col("n_real") > 0)) | \
        ((F.col("rk_syn") <= top_per_side) & (F.col("n_syn") > 0))
    kept = cc.where(keep).select("column_name", "value",
                                 safe_div(F.col("n_real"), F.col("t_real")).alias("real_share"),
                                 safe_div(F.col("n_syn"), F.col("t_syn")).alias("synthetic_share"))
    w = Window.partitionBy("column_name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return kept.select("column_name", "value", "real_share", "synthetic_share",
                       F.sum("real_share").over(w).alias("real_cumsum"),
                       F.sum("synthetic_share").over(w).alias("synthetic_cumsum"))


KDE_GRID = 200
KDE_CUT = 3.0


def kde_curves(pair: TablePair, cols: list[str] | None = None, gridsize: int = KDE_GRID,
               cut: float = KDE_CUT, every_value: bool = False) -> DataFrame:
    """Gaussian KDE per column and side (Scott bandwidth n^(-1/5) * std(n-1)), on
    ``gridsize`` points from min - cut*bw to max + cut*bw.

    Rows are summed up in bins of half a bandwidth: of each bin the sums of the first ``KDE_TERMS`` powers of the
    distance u from its centre, in bandwidths.  A bin's curve is its series in Hermite polynomials,
    exp(-(t - u)^2 / 2) = exp(-t^2 / 2) sum_k He_k(t) u^k / k!.  With |u| <= 1/4 the terms left out are below
    1.09 (1/4)^K / sqrt(K!) = 6e-17 of a kernel's peak for K = 16, so the curve is exact to rounding.  Cost: one
    aggregate over the rows, then filled bins x gridsize.  ``every_value`` sums a kernel per distinct
    value instead (distinct values x gridsize), for comparison.
    """
    cols = cols or pair.numeric
    spark = pair.real.sparkSession
    st = side_agg(pair, cols, {"n": F.count, "std": F.stddev_samp, "lo": F.min, "hi": F.max}).first()
    params = {}
    for c in cols:
        for side in (0, 1):
            n = st[f"{c}__n__{side}"]
            sd = st[f"{c}__std__{side}"]
            if not n or sd is None or sd == 0 or n < 2:
                continue
            bw = sd * n ** (-1.0 / 5.0)
            params[(c, side)] = (float(st[f"{c}__lo__{side}"]) - cut * bw,
                                 float(st[f"{c}__hi__{side}"]) + cut * bw, float(bw), int(n))
    if not params:
        return spark.createDataFrame([], "column_name string, side string, i int, x double, density double")
    t = pair.tagged(cols, as_double=True)
    grids = {k: np.linspace(lo, hi, gridsize) for k, (lo, hi, bw, n) in params.items()}
    bws = {k: v[2] for k, v in params.items()}

    def of(c, i):
        """Parameter ``i`` of the row's side."""
        return F.when(F.col(SIDE) == 0, F.lit(params[c, 0][i] if (c, 0) in params else None).cast("double")).otherwise(
            F.lit(params[c, 1][i] if (c, 1) in params else None).cast("double"))

    long = t.select(SIDE, F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(c).alias("value"), of(c, 0).alias("lo"), of(c, 2).alias("bw")) for c in cols])))
    long = long.filter(F.col("bw").isNotNull() & F.col("value").isNotNull())
    if every_value:
        terms, width = 1, None
        sums = long.groupBy("column_name", SIDE, "value").agg(F.count(F.lit(1)).cast("double").alias("p0"))
    else:
        terms, width = KDE_TERMS, KDE_BIN
        far = (F.col("value") - F.col("lo")) / F.col("bw")
        long = long.withColumn("bin", F.floor(far / width)).withColumn("u", far - (F.col("bin") + 0.5) * width)
        powers = [F.lit(1.0)]
        for _ in range(terms - 1):
            powers.append(powers[-1] * F.col("u"))
        sums = long.groupBy("column_name", SIDE, "bin").agg(
            *[F.sum(p).alias(f"p{k}") for k, p in enumerate(powers)]).withColumnRenamed("bin", "value")
    lows = {k: v[0] for k, v in params.items()}

    def partial(batches):
        for pdf in batches:
            out = []
            for (c, side), g in pdf.groupby(["column_name", SIDE]):
                key = (c, int(side))
                bw, at = bws[key], g["value"].to_numpy().astype("float64")
                if width is not None:
                    at = lows[key] + (at + 0.5) * width * bw   # centres of the bins
                total = np.zeros(gridsize)
                moments = g[[f"p{k}" for k in range(terms)]].to_numpy()
                for lo in range(0, len(g), 4096):
                    z = (grids[key][None, :] - at[lo:lo + 4096, None]) / bw
                    before, he = np.zeros_like(z), np.ones_like(z)
                    series = moments[lo:lo + 4096, :1] * he
                    for k in range(1, terms):
                        before, he = he, z * he - (k - 1) * before
                        series = series + moments[lo:lo + 4096, k:k + 1] / math.factorial(k) * he
                    total += (np.exp(-0.5 * z * z) * series).sum(axis=0)
                out.append(pd.DataFrame({"column_name": c, SIDE: int(side), "i": np.arange(gridsize, dtype="int32"), "s": total}))
            if out:
                yield pd.concat(out, ignore_index=True)

    part = sums.mapInPandas(partial, f"column_name string, {SIDE} int, i int, s double")
    summed = part.groupBy("column_name", SIDE, "i").agg(F.sum("s").alias("s"))
    prm = spark.createDataFrame(
        [(c, side, float(lo), float(hi), float(bw), n) for (c, side), (lo, hi, bw, n) in params.items()],
        f"column_name string, {SIDE} int, lo double, hi double, bw double, n long")
    j = summed.join(F.broadcast(prm), ["column_name", SIDE])
    x = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(gridsize - 1)
    return j.select("column_name",
                    F.when(F.col(SIDE) == 0, "real").otherwise("synthetic").alias("side"),
                    "i", x.alias("x"),
                    (F.col("s") / (F.col("n") * F.col("bw") * F.lit(float(np.sqrt(2 * np.pi))))).alias("density"))


def histograms(pair: TablePair, cols: list[str] | None = None, bins: int = 30) -> DataFrame:
    """equal-width histogram per column and side over that side's own range."""
    cols = cols or pair.numeric
    spark = pair.real.sparkSession
    outs = []
    for side, df, name in ((0, pair.real, "real"), (1, pair.synthetic, "synthetic")):
        rng = {c: _numpy_range(*r) for c, r in _real_ranges(pair, cols, side).items()}
        cs = [c for c in cols if rng[c] is not None]
        if not cs:
            continue
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"),
                     _bin_expr(F.col(c).cast("double"), rng[c][0], rng[c][1], bins).alias("bin"))
            for c in cs])))
        counts = long.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
        edges = spark.createDataFrame(
            [(c, b, rng[c][0] + b * (rng[c][1] - rng[c][0]) / bins,
              rng[c][0] + (b + 1) * (rng[c][1] - rng[c][0]) / bins) for c in cs for b in range(bins)],
            "column_name string, bin int, lo_edge double, hi_edge double")
        h = edges.join(counts, ["column_name", "bin"], "left").select(
            "column_name", F.lit(name).alias("side"), "bin", "lo_edge", "hi_edge",
            F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
        outs.append(h)
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def mean_std_gap(pair: TablePair, cols: list[str] | None = None) -> DataFrame:
    """mean over columns of |mean_r - mean_s| and |std_r - std_s| (std n-1)."""
    st = column_statistics(pair, cols)
    return st.agg(F.avg(F.abs(F.col("real_mean") - F.col("synthetic_mean"))).alias("mean_diff"),
                  F.avg(F.abs(F.col("real_std") - F.col("synthetic_std"))).alias("std_diff"))


VAR_EPS = 1e-10


def most_changed_columns(pair: TablePair, cols: list[str] | None = None, top: int = 20) -> DataFrame:
    """score = max(var_r / var_s, var_s / var_r) (zero variance -> 1e-10); the top
    ``top`` columns by score desc, column asc."""
    cols = cols or pair.numeric
    row = side_agg(pair, cols, {"var": F.var_samp})
    long = stats_long(row, cols, {"var_real": "var__0", "var_syn": "var__1"})
    vr = F.when(F.col("var_real") != 0, F.col("var_real")).otherwise(VAR_EPS)
    vs = F.when(F.col("var_syn") != 0, F.col("var_syn")).otherwise(VAR_EPS)
    scored = long.select("column_name", F.greatest(vr / vs, vs / vr).alias("score"))
    return scored.orderBy(F.desc("score"), "column_name").limit(top)
