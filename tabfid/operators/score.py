"""Scores and report tables (ops Q1-Q5, Q8): expressions over a one-row metrics table.

The metrics table has (some of) the columns correlation_similarity,
correlation_distance_rmse, correlation_distance_mae, duplicate_rows_percentage,
nearest_neighbor_mean, nearest_neighbor_std, pca_similarity, ml_utility_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed weights, bands, labels and advice texts of the reference
SIMILARITY_WEIGHTS = {"correlation_similarity": 0.25, "correlation_distance": 0.25,
                      "nearest_neighbor": 0.2, "pca_similarity": 0.2, "duplicate_penalty": 0.1}
QUALITY_WEIGHTS = {"structural": 0.35, "distribution": 0.25, "privacy": 0.15, "utility": 0.25}
CATEGORIES = ["structural", "distribution", "privacy", "utility"]
LABELS = [(0.9, "Excellent"), (0.8, "Very Good"), (0.7, "Good"), (0.6, "Satisfactory"),
          (0.5, "Average"), (0.4, "Below Average"), (0.3, "Poor")]
LOWEST_LABEL = "Very Poor"
ADVICE = {
    "structural": "Consider using a model that better preserves the correlation structure of your data.",
    "distribution": "Try adjusting the model parameters to better match the real data distribution.",
    "privacy": "Your synthetic data has too many duplicates from the original dataset, which may pose privacy risks.",
    "utility": "The synthetic data may not be as useful for machine learning tasks as the original data.",
}
BANDS = [(0.8, "green"), (0.6, "yellow"), (0.4, "orange")]
LOWEST_BAND = "red"
DEFAULT_UTILITY = 0.5


def _m(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def similarity_score(metrics: DataFrame) -> DataFrame:
    """Q1: .25 corr_sim + .25 (1 - min(rmse, 1)) + .2 (1 - min(nn/10, 1)) + .2 pca +
    .1 (1 - dup%/100), clipped to [0, 1]; missing rmse -> 1, other missing -> 0."""
    return metrics.select(_similarity(metrics).alias("similarity_score"))


def _similarity(metrics: DataFrame) -> Column:
    w = SIMILARITY_WEIGHTS
    cs = _m(metrics, "correlation_similarity", 0.0)
    rmse = _m(metrics, "correlation_distance_rmse", 1.0)
    dup = _m(metrics, "duplicate_rows_percentage", 0.0)
    nn = _m(metrics, "nearest_neighbor_mean", 0.0)
    pca = _m(metrics, "pca_similarity", 0.0)
    s = (w["correlation_similarity"] * cs
         + w["correlation_distance"] * F.greatest(F.lit(0.0), 1 - F.least(rmse, F.lit(1.0)))
         + w["nearest_neighbor"] * F.greatest(F.lit(0.0), 1 - F.least(nn / 10, F.lit(1.0)))
         + w["pca_similarity"] * pca
         + w["duplicate_penalty"] * F.greatest(F.lit(0.0), 1 - dup / 100))
    return _clip01(s)


def quality_label(c: Column) -> Column:
    """Q3: score -> label."""
    out = F.lit(LOWEST_LABEL)
    for bound, name in reversed(LABELS):
        out = F.when(c >= bound, F.lit(name)).otherwise(out)
    return out


def colour_band(c: Column) -> Column:
    """Q5: >= .8 green, >= .6 yellow, >= .4 orange, else red."""
    out = F.lit(LOWEST_BAND)
    for bound, name in reversed(BANDS):
        out = F.when(c >= bound, F.lit(name)).otherwise(out)
    return out


def quality_details(metrics: DataFrame, utility_from_ml: bool = False) -> DataFrame:
    """Q2-Q4: category scores, overall score, labels and advice for the weakest category
    (ties -> first of structural, distribution, privacy, utility).

    The reference reads a utility value nothing sets, so utility is always 0.5; with
    ``utility_from_ml`` the metric ``ml_utility_score`` (in [0, 1]) is used when > 0."""
    cs = _m(metrics, "correlation_similarity", 0.0)
    rmse = _m(metrics, "correlation_distance_rmse", 1.0)
    mae = _m(metrics, "correlation_distance_mae", 1.0)
    dup = _m(metrics, "duplicate_rows_percentage", 0.0)
    nn = _m(metrics, "nearest_neighbor_mean", 0.0)
    nn_std = _m(metrics, "nearest_neighbor_std", 0.0)
    mlu = _m(metrics, "ml_utility_score", 0.0) if utility_from_ml else F.lit(0.0)
    structural = _clip01(0.6 * cs + 0.25 * F.greatest(F.lit(0.0), 1 - F.least(rmse, F.lit(1.0)))
                         + 0.15 * F.greatest(F.lit(0.0), 1 - F.least(mae, F.lit(1.0))))
    distribution = _clip01(0.7 * F.greatest(F.lit(0.0), 1 - F.least(nn / 10, F.lit(1.0)))
                           + 0.3 * F.greatest(F.lit(0.0), 1 - F.least(nn_std / 5, F.lit(1.0))))
    privacy = F.greatest(F.lit(0.0), 1 - dup / 100)
    utility = F.when(mlu > 0, mlu).otherwise(F.lit(DEFAULT_UTILITY))
    d = metrics.select(structural.alias("structural"), distribution.alias("distribution"),
                       privacy.alias("privacy"), utility.alias("utility"))
    w = QUALITY_WEIGHTS
    overall = _clip01(sum(w[c] * F.col(c) for c in CATEGORIES))
    low = F.least(*[F.col(c) for c in CATEGORIES])
    focus = F.lit(None).cast("string")
    for c in reversed(CATEGORIES):
        focus = F.when(F.col(c) == low, F.lit(c)).otherwise(focus)
    advice = F.lit(None).cast("string")
    for c in CATEGORIES:
        advice = F.when(F.col("_focus") == c, F.lit(ADVICE[c])).otherwise(advice)
    d = d.withColumns({"overall_score": overall, "_focus": focus})
    return d.select(
        "overall_score", quality_label(F.col("overall_score")).alias("overall_label"),
        *CATEGORIES, *[quality_label(F.col(c)).alias(f"{c}_label") for c in CATEGORIES],
        F.initcap("_focus").alias("focus_area"), advice.alias("advice"))


def dimension_table(details: DataFrame) -> DataFrame:
    """Q5: (dimension, score, rating, colour) per quality category."""
    rows = details.select(F.inline(F.array(*[
        F.struct(F.lit(c.capitalize()).alias("dimension"), F.col(c).alias("score")) for c in CATEGORIES])))
    return rows.select("dimension", "score", quality_label(F.col("score")).alias("rating"),
                       colour_band(F.col("score")).alias("colour"))


def summary(metrics: DataFrame, utility: DataFrame | None = None) -> DataFrame:
    """Q8: nested summary (classifier, privacy, correlation, similarity) as a long table
    (section, key, value) filled with the measured values (no placeholders).  ``utility`` is U4's row
    (``f1_utility``): macro-F1 of both models and their ratio."""
    m = metrics.withColumn("similarity_score", _similarity(metrics))
    items = [("privacy", "duplicate_rows_percentage"), ("privacy", "nearest_neighbor_mean"),
             ("privacy", "nearest_neighbor_std"), ("correlation", "correlation_distance_rmse"),
             ("correlation", "correlation_distance_mae"), ("correlation", "correlation_similarity"),
             ("similarity", "similarity_score")]
    items = [(s, k) for s, k in items if k in m.columns]
    out = m.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.col(k).cast("double").alias("value"))
        for s, k in items])))
    if utility is not None:
        out = out.unionByName(utility.select(F.lit("classifier").alias("section"), F.inline(F.array(*[
            F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
            for k, c in (("real_f1", "real_score"), ("synthetic_f1", "synthetic_score"), ("utility_score", "utility"))]))))
    return out
