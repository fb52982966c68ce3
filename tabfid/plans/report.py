"""Full and short evaluation reports (ops Q6, Q7) over a (real, synthetic) pair."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfid.functions.exprs import zero_fill_col
from tabfid.operators import multivariate as mv
from tabfid.operators import score as sc
from tabfid.operators import univariate as uni
from tabfid.operators.neighbors import nearest_neighbor_distance
from tabfid.operators.pair import TablePair

REPORT_SCHEMA = "metric string, column_name string, value double, error string"


def fidelity_metrics(pair: TablePair, cols: list[str] | None = None, pca_components: int = 5,
                     ml_utility_score: float | None = None) -> dict:
    """Scalar metrics feeding the scores: J1, J2, J5, J6, J7 (+ optional utility).

    Each value is one aggregate job; only the scalars reach the driver."""
    cols = cols or pair.numeric
    out = {}
    g = mv.gram(pair, cols)                         # one Gram pass feeds J1, J2 and J7
    long = mv.correlation_long(pair, cols, g=g)
    out.update(mv.correlation_similarity(pair, cols, long=long).first().asDict())
    out.update(mv.correlation_distance(pair, cols, long=long).first().asDict())
    d = mv.duplicate_rows(pair).first()
    out["duplicate_rows_count"] = float(d["duplicate_rows_count"])
    out["duplicate_rows_percentage"] = d["duplicate_rows_percentage"]
    nn = nearest_neighbor_distance(pair, cols).first()
    out["nearest_neighbor_mean"], out["nearest_neighbor_std"] = nn["nearest_neighbor_mean"], nn["nearest_neighbor_std"]
    n_all = len(pair.columns)
    out["pca_similarity"] = mv.pca_similarity(pair, cols, min(pca_components, n_all),
                                              mo=mv.moments(pair, cols, g=g)).first()["pca_similarity"]
    if ml_utility_score is not None:
        out["ml_utility_score"] = float(ml_utility_score)
    return out


def metrics_frame(spark, metrics: dict) -> DataFrame:
    names = sorted(metrics)
    return spark.createDataFrame([tuple(float(metrics[n]) if metrics[n] is not None else None for n in names)],
                                 ", ".join(f"{n} double" for n in names))


def evaluate_all(pair: TablePair, cols: list[str] | None = None, target: str | None = None,
                 task: str = "classification", keys: list[str] | None = None, persist: bool = True,
                 utility_in_score: bool = False, keyed_real: DataFrame | None = None, num_trees: int = 100,
                 max_depth: int = 10) -> DataFrame:
    """Q6: every metric, one failing metric never stops the rest.

    Result: long table (metric, column_name, value, error).  Both sides are persisted
    once (memory and disk) and shared by all jobs, then released.  With ``target`` the ML utility is a section
    of the report: forests of ``num_trees`` trees, trained on the pair's columns; the real split needs the unique
    row ``keys``, from ``keyed_real`` (the real table with its keys) where the pair lacks them."""
    spark = pair.real.sparkSession
    cols = cols or pair.numeric
    if persist:
        pair = TablePair(pair.real.persist(StorageLevel.MEMORY_AND_DISK),
                         pair.synthetic.persist(StorageLevel.MEMORY_AND_DISK), columns=pair.columns,
                         zero_fill=False)
    rows: list[tuple] = []

    def run(name, fn):
        try:
            fn()
        except Exception as e:  # noqa: BLE001 - the report records the failure and goes on
            rows.append((name, None, None, f"{type(e).__name__}: {str(e)[:300]}"))

    def per_column(df: DataFrame, metric_cols: list[str], prefix: str = ""):
        for r in df.collect():  # one row per column: bounded
            for m in metric_cols:
                v = r[m]
                rows.append((f"{prefix}{m}", r["column_name"], float(v) if v is not None else None, None))

    def scalars(d: dict):
        for k, v in d.items():
            rows.append((k, None, float(v) if v is not None else None, None))

    run("ks_wasserstein", lambda: per_column(uni.ks_wasserstein(pair, cols),
                                             ["ks_statistic", "ks_pvalue", "wasserstein"]))
    run("jensen_shannon", lambda: per_column(uni.jensen_shannon(pair, cols), ["jsd"]))
    run("column_statistics", lambda: per_column(uni.column_statistics(pair, cols), [
        "real_mean", "synthetic_mean", "real_std", "synthetic_std", "real_min", "synthetic_min",
        "real_max", "synthetic_max", "mean_diff_pct"]))
    metrics: dict = {}

    def fid():
        metrics.update(fidelity_metrics(pair, cols))
        scalars(metrics)
    run("fidelity", fid)
    if target is not None and keys:
        from tabfid.operators.utility import ml_utility

        def util():
            real = pair.real
            if keyed_real is not None:
                types = {f.name: f.dataType for f in keyed_real.schema.fields}
                real = keyed_real.select(*[k for k in keys if k not in pair.columns],
                                         *[zero_fill_col(c, types[c]) for c in pair.columns])
            features = [c for c in pair.columns if c != target and c not in keys]
            u = ml_utility(real, pair.synthetic, target, keys, task, num_trees=num_trees, max_depth=max_depth,
                           features=features).first()
            rows.append((f"real_model_{u['metric']}", None, u["real_score"], None))
            rows.append((f"synthetic_model_{u['metric']}", None, u["synthetic_score"], None))
            rows.append(("relative_performance_percentage", None, u["relative_performance_pct"], None))
            metrics["ml_utility"] = u["relative_performance_pct"]
        run("ml_utility", util)

    def scores():
        m = dict(metrics)
        if utility_in_score and "ml_utility" in m:
            m["ml_utility_score"] = max(0.0, min(1.0, m["ml_utility"] / 100))
        mf = metrics_frame(spark, {k: v for k, v in m.items() if k != "ml_utility"})
        rows.append(("similarity_score", None, sc.similarity_score(mf).first()[0], None))
        det = sc.quality_details(mf, utility_from_ml=utility_in_score).first()
        for k in ("overall_score", *sc.CATEGORIES):
            rows.append((k if k == "overall_score" else f"{k}_score", None, det[k], None))
    run("scores", scores)
    if persist:
        pair.real.unpersist()
        pair.synthetic.unpersist()
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def evaluate(pair: TablePair, cols: list[str] | None = None, curve_points: int = 1000) -> dict:
    """Q7: short evaluation: KS (+p), correlation similarity, column statistics and the
    log-summary and CDF-curve tables for plots.  Values are DataFrames (lazy)."""
    cols = cols or pair.numeric
    cdf = uni.cdf_table(pair, cols)
    return {
        "statistics": uni.ks_wasserstein(pair, cols, cdf=cdf),
        "correlation": mv.correlation_similarity(pair, cols),
        "column_stats": uni.column_statistics(pair, cols),
        "log_summary": uni.log_summary(pair, cols),
        "cdf_curve": uni.cdf_curve(pair, cols, points=curve_points, cdf=cdf),
    }


def short_evaluation_table(parts: dict) -> DataFrame:
    """Q7 as one long table: (part, column_name, point, measure, value); ``point`` is the place on a
    curve as "side:rank", null elsewhere."""
    out = None
    for part, d in parts.items():
        name = F.col("column_name") if "column_name" in d.columns else F.lit(None).cast("string")
        marks = [c for c in ("side", "i", "rank") if c in d.columns]
        point = F.concat_ws(":", *[F.col(c).cast("string") for c in marks]) if marks else F.lit(None).cast("string")
        values = [c for c, t in d.dtypes if c not in ("column_name", *marks) and t in ("double", "float", "bigint", "int")]
        long = d.select(F.lit(part).alias("part"), name.alias("column_name"), point.alias("point"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in values])))
        out = long if out is None else out.unionByName(long)
    return out
