"""Train-on-synthetic / test-on-real utility (ops U1-U5).

Features: numeric columns standardised with statistics of the real training split
(population std), categorical columns coded with the training dictionary plus 'Other'
(unseen -> 'Other').  Models are MLlib random forests, trained distributed.  The metric
arithmetic (accuracy, R^2, macro-F1) is plain aggregation over a predictions table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.functions.exprs import is_numeric
from tabfid.operators import encode as enc
from tabfid.operators import scale as sc
from tabfid.operators.sampling import train_test_split
from tabfid.session import shared_table

F1_FLOOR = 0.001        # U4 denominator floor
ROWS_PER_PART, LEAST_PARTS = 500_000, 16   # forest input: partitions by rows, never by cores
POINTS = 1_000_000      # rows up to which each is a training point of its own
QUANTILE_ACCURACY = 10_000


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows with prediction = label."""
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def r2_score(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """1 - SS_res / SS_tot (SS_tot = 0: 1 if SS_res = 0 else 0), one pass (``var_pop``
    keeps its precision where labels are large and close together)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = pred.agg((F.var_pop(y) * F.count(y)).alias("sst"), F.sum((y - p) * (y - p)).alias("ssr"))
    sst = F.col("sst")
    return a.select(F.when(sst > 0, 1 - F.col("ssr") / sst)
                    .when(F.col("ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r2"))


def macro_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Unweighted mean of per-class F1 over classes seen in labels or predictions
    (F1 = 2tp / (2tp + fp + fn), 0 when undefined).  Spark's 'f1' metric is weighted,
    so it is computed here from the (label, prediction) count table."""
    cm = pred.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    return _macro_from_counts(cm)


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro-F1 from one (label, prediction) count table."""
    cm = pred.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    per = _per_class(cm)
    return per.agg((F.sum("tp") / F.sum("ny")).alias("accuracy"), F.avg(_f1()).alias("macro_f1"))


def _per_class(cm: DataFrame) -> DataFrame:
    by_y = cm.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("ny"),
                                                 F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("tp"))
    by_p = cm.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("np"))
    return by_y.join(by_p, "c", "full").select(
        "c", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("ny", F.lit(0)).alias("ny"),
        F.coalesce("np", F.lit(0)).alias("np"))


def _f1():
    return F.when(F.col("ny") + F.col("np") > 0, 2 * F.col("tp") / (F.col("ny") + F.col("np"))).otherwise(0.0)


def _macro_from_counts(cm: DataFrame) -> DataFrame:
    return _per_class(cm).agg(F.avg(_f1()).alias("macro_f1"))


def prepare_features(train: DataFrame, others: list[DataFrame], features: list[str]):
    """Fit scaling/encoding on ``train`` and apply the same state to all tables."""
    types = {f.name: f.dataType for f in train.schema.fields}
    num = [c for c in features if is_numeric(types[c]) and not isinstance(types[c], T.BooleanType)]
    cat = [c for c in features if c not in num]
    st = sc.fit_scaler(train, num, "standard") if num else {}
    encs = {c: enc.fit_with_unseen(_values(train, c), c) for c in cat}
    outs = []
    for df in [train, *others]:
        d = sc.apply_scaler(df, st) if st else df
        for c, e in encs.items():
            d = enc.apply_with_unseen(d, e)
        outs.append(d)
    max_bins = max([32] + [e.size for e in encs.values()])
    return outs, max_bins


def _values(df: DataFrame, col: str) -> DataFrame:
    """The distinct values of a column as a table of their own: a dictionary over it does not read the rows again each
    time it is looked up."""
    return shared_table(df.select(col).distinct(), "values")


def _label(real: DataFrame, syn: DataFrame, target: str, task: str):
    if task == "classification":
        e = enc.fit_joint_encoder(_values(real, target), _values(syn, target), target)
        return (lambda df: enc.apply_encoder(df, e).withColumn("label", F.col(target).cast("double"))), e.size
    return (lambda df: df.withColumn("label", F.col(target).cast("double"))), 0


def _dealt(d: DataFrame, features: list[str]) -> DataFrame:
    """Partitions by a hash of the row, as many as the rows ask for, each in a fixed order."""
    parts = max(LEAST_PARTS, -(-d.count() // ROWS_PER_PART))
    d = d.withColumn("_h", F.xxhash64(*features, "label", "weight"))
    return d.repartition(parts, "_h").sortWithinPartitions("_h").drop("_h")


def training_points(d: DataFrame, features: list[str], task: str, max_bins: int):
    """(points with a ``weight``, function that brings other rows to the points' features).

    Up to ``POINTS`` rows, each is a point.  Beyond, features of more than ``max_bins`` values are cut at their
    quantiles, as the forest would do, and rows that it can then not tell apart (equal features; classes: and label)
    are dealt to as many points as keep the table at about ``POINTS``.  A point weighs its rows and has their mean
    label, so sums of labels, gains of splits and leaf values are those of all rows; only the bags draw points."""
    n = d.count()
    if n <= POINTS:
        return d.withColumn("weight", F.lit(1.0)), lambda x: x
    probs = [i / max_bins for i in range(1, max_bins)]
    row = d.agg(*[x for i, c in enumerate(features) for x in (
        F.approx_count_distinct(c, 0.02).alias(f"k{i}"), F.percentile_approx(c, probs, QUANTILE_ACCURACY).alias(f"q{i}"))]).first()
    cut = {c: [-float("inf"), *sorted({float(v) for v in row[f"q{i}"]}), float("inf")]
           for i, c in enumerate(features) if row[f"k{i}"] > max_bins}
    bins = Bucketizer(splitsArray=list(cut.values()), inputCols=list(cut), outputCols=[f"_bin_{c}" for c in cut], handleInvalid="keep") if cut else None

    def binned(x: DataFrame) -> DataFrame:
        return bins.transform(x).withColumns({c: F.col(f"_bin_{c}") for c in cut}).drop(*[f"_bin_{c}" for c in cut]) if cut else x

    if task == "classification":
        g = shared_table(binned(d).groupBy(*features, "label").agg(F.count(F.lit(1)).alias("_n")), "points")
        each = _pieces(g)
        g = g.withColumn("_p", F.least("_n", F.lit(each)))
        g = g.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_p")))).withColumn(
            "weight", (F.floor(F.col("_n") / F.col("_p")) + (F.col("_i") <= F.col("_n") % F.col("_p")).cast("long")).cast("double"))
        return g.select(*features, "label", "weight"), binned
    b = shared_table(binned(d), "binned")
    each = _pieces(b.select(*features).distinct())
    g = b.groupBy(*features, F.pmod(F.xxhash64("label"), F.lit(each)).alias("_i")).agg(
        F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return shared_table(g.select(*features, "label", "weight"), "points"), binned


def _pieces(groups: DataFrame) -> int:
    return max(1, POINTS // max(1, groups.count()))


def ml_utility(real: DataFrame, synthetic: DataFrame, target: str, keys: list[str],
               task: str = "classification", test_size: float = 0.2, num_trees: int = 100,
               max_depth: int = 10, seed: int = 42, features: list[str] | None = None,
               metric: str | None = None) -> DataFrame:
    """U1/U2 (U4 with metric='macro_f1', 50 trees): forests trained on the real training
    split and on the synthetic table, both scored on the held-out real split.

    Returns (metric, real_score, synthetic_score, relative_performance_pct, n_test)."""
    features = features or [c for c in real.columns if c != target and c not in keys]
    train, test = train_test_split(real, keys, test_size, seed)
    lab, _ = _label(real, synthetic, target, task)
    (tr, te, sy), max_bins = prepare_features(train, [test, synthetic], features)
    tr, te, sy = lab(tr), lab(te), lab(sy)
    tr, te, sy = (d.select(*[F.col(c).cast("double").alias(c) for c in features], "label") for d in (tr, te, sy))
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    # maxMemoryInMB: one pass over the points for all nodes of a level; node ids are walked, not kept per point and tree
    forest = dict(numTrees=num_trees, maxDepth=max_depth, seed=seed, maxBins=max_bins, weightCol="weight",
                  cacheNodeIds=False, maxMemoryInMB=1024)
    if task == "classification":
        est = RandomForestClassifier(**forest)
        metric = metric or "accuracy"
        score = accuracy if metric == "accuracy" else macro_f1
    elif task == "regression":
        est = RandomForestRegressor(**forest)
        metric = metric or "r2"
        score = r2_score
    else:
        raise ValueError(f"unknown task {task!r}")
    te = te.persist(StorageLevel.MEMORY_AND_DISK)

    def trained(d: DataFrame) -> float:
        d = d.persist(StorageLevel.MEMORY_AND_DISK)   # counted, cut at its quantiles and grouped
        points, binned = training_points(d, features, task, max_bins)
        # bagging draws by partition and row order: both are fixed by the rows themselves, so the
        # forest is the same on any cluster
        dealt = va.transform(_dealt(points, features)).select("features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        model = est.fit(dealt)
        dealt.unpersist()
        d.unpersist()
        return score(model.transform(va.transform(binned(te)).select("features", "label"))).first()[0]

    r, s = trained(tr), trained(sy)
    n_test = te.count()
    te.unpersist()
    rel = (s / r * 100.0) if r else 0.0
    spark = real.sparkSession
    return spark.createDataFrame([(metric, float(r), float(s), float(rel), int(n_test))],
                                 "metric string, real_score double, synthetic_score double, "
                                 "relative_performance_pct double, n_test long")


def f1_utility(real: DataFrame, synthetic: DataFrame, target: str, keys: list[str],
               test_size: float = 0.2, seed: int = 42, max_depth: int = 10, num_trees: int = 50,
               features: list[str] | None = None) -> DataFrame:
    """U4: macro-F1 with 50 trees, for any number of classes; utility = f1_syn / max(f1_real, 0.001)."""
    spark = real.sparkSession
    r = ml_utility(real, synthetic, target, keys, "classification", test_size, num_trees, max_depth, seed,
                   features, metric="macro_f1").first()
    return spark.createDataFrame(
        [("macro_f1", r["real_score"], r["synthetic_score"],
          float(r["synthetic_score"] / max(r["real_score"], F1_FLOOR)))],
        "metric string, real_score double, synthetic_score double, utility double")
