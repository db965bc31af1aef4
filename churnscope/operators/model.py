"""Baseline churn model: features, split, scaling, logistic regression, AUC.

Everything row-level stays a DataFrame expression or a stage of the ML
pipeline; the driver holds what the model itself consists of (its features'
names, coefficients and class weights).

* One aggregate over the materialised model rows, by class, side of the split
  and categories, gives the class weights, means, deviations and the category
  dictionary (``statistics``).
* The category dictionary is a DataFrame of ranks.  One-hot rows are sparse:
  ``sparse_features`` joins the ranks, with no limit on their number.
* Preprocessing (Unknown fill, Yes/No flags, one-hot with the alphabetically
  first value dropped, z-scoring with the population deviation of the training
  rows, balanced class weights) and the regression are stages of one
  ``PipelineModel``, so a saved model replays all of it.
* The 80/20 split is stratified: each class is cut at its own 20 % point in
  the order of the ids' digests, found from bucket counts.
* The objective is that of an inverse-regularisation strength C = 1 with the
  intercept penalised like any coefficient: the intercept is the coefficient of
  a constant feature.  ``gradient`` recomputes the objective's gradient in one
  pass; as the objective is strictly convex, a gradient of (nearly) zero
  certifies the optimum.
* AUC is the exact rank (Mann-Whitney) statistic computed with a
  distributed prefix sum over the distinct scores.
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    ElementwiseProduct, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexerModel, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.functions.dims import literal_frame
from churnscope.functions.scalar import round_fp, safe_div
from churnscope.functions.sequence import prefix_sum
from churnscope.session import checkpoint_dir
from churnscope.sources.sinks import exists

# --- fixed values: model configuration ---------------------------------------
NUMERIC_FEATURES = ["tenure", "MonthlyCharges"]
CATEGORICAL_FEATURES = ["Contract", "PaymentMethod"]
BOOLEAN_FEATURES = ["OnlineSecurity", "TechSupport"]
TEST_FRACTION = 0.2
MAX_ITER = 1000
TOP_K = 10
# -----------------------------------------------------------------------------

#: Largest entry of the gradient, per training row, at which a fit counts as converged.
GRADIENT_TOLERANCE = 1e-6


def training_set(df: DataFrame) -> DataFrame:
    """M1: model rows (tenure and charge present) with the 0/1 churn label."""
    return (df.where(F.col("tenure").isNotNull() & F.col("MonthlyCharges").isNotNull())
              .select("customerID",
                      F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("churn"),
                      *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, *BOOLEAN_FEATURES))


def medians(df: DataFrame) -> dict[str, float | None]:
    """Exact medians of the numeric features, at any number of rows and values.

    Values are counted, the counts summed up in value order across partitions,
    and the one or two middle values picked; only those reach the driver.
    """
    out = {}
    for c in NUMERIC_FEATURES:
        counts = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v"))
                    .agg(F.count(F.lit(1)).alias("n")))
        below = prefix_sum(counts, ["v"], "n", "below")
        total = df.where(F.col(c).isNotNull()).count()
        # the middle places (from 0): both for an even total
        low, high = (total - 1) // 2, total // 2
        hit = lambda p: (F.col("below") <= p) & (F.col("below") + F.col("n") > p)
        row = below.agg(F.max(F.when(hit(low), F.col("v"))).alias("low"),
                        F.max(F.when(hit(high), F.col("v"))).alias("high")).first()
        out[c] = (row.low + row.high) / 2 if total else None
    return out


def impute_encode(df: DataFrame, med: dict[str, float | None] | None = None) -> DataFrame:
    """M2: numeric NULL -> median, categorical NULL -> 'Unknown' (blanks kept),
    boolean 'Yes' -> 1 else 0.  ``med`` = {} where no number is NULL, as in a
    training set; without it the medians are computed."""
    med = med if med is not None else medians(df)
    out = df
    for c in NUMERIC_FEATURES:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(med.get(c)).cast("double")))
    for c in CATEGORICAL_FEATURES:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("Unknown")))
    for c in BOOLEAN_FEATURES:
        out = out.withColumn(c, F.when(F.col(c) == "Yes", 1).otherwise(0))
    return out


def materialised(df: DataFrame) -> DataFrame:
    """The frame computed once, in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def statistics(rows: DataFrame) -> DataFrame:
    """M2-M6 in one pass over split model rows: counts, sums and sums of squares by side, class and categories."""
    moments = [f(c).alias(name) for c in NUMERIC_FEATURES for name, f in (
        (f"sum_{c}", F.sum), (f"squares_{c}", lambda c: F.sum(F.col(c) * F.col(c))))]
    return impute_encode(rows, {}).groupBy("is_test", "churn", *CATEGORICAL_FEATURES).agg(
        F.count(F.lit(1)).alias("n"), *moments, *[F.sum(c).alias(f"sum_{c}") for c in BOOLEAN_FEATURES])


def dictionary(stats: DataFrame) -> DataFrame:
    """M3: (column, value, n, n_train, first): the values of each categorical feature, the dropped one marked."""
    train = F.when(F.col("is_test"), 0).otherwise(F.col("n"))
    parts = [stats.groupBy(F.lit(c).alias("column"), F.col(c).alias("value")).agg(F.sum("n").alias("n"), F.sum(train).alias("n_train"))
             for c in CATEGORICAL_FEATURES]
    values = parts[0].unionByName(parts[1])
    least = values.groupBy("column").agg(F.min("value").alias("least"))
    return values.join(least, "column").select("column", "value", "n", "n_train", (F.col("value") == F.col("least")).alias("first"))


def positions(values: DataFrame) -> DataFrame:
    """M3: (column, value, position) of the kept values, after the numeric and boolean features.

    Ranks come from a prefix sum over value ranges, so no task ranks them all."""
    kept = values.where(~F.col("first")).select("column", "value", F.lit(1).alias("one"))
    before = len(NUMERIC_FEATURES) + len(BOOLEAN_FEATURES)
    return prefix_sum(kept, ["column", "value"], "one", "before").select(
        "column", "value", (F.col("before") + before).cast("int").alias("position"))


def categories(df: DataFrame) -> dict[str, list[str]]:
    """Sorted distinct values of each categorical feature (after Unknown fill): what names a fitted model's features."""
    rows = df if "is_test" in df.columns else df.withColumn("is_test", F.lit(False))
    return _names(dictionary(statistics(rows)))


def _names(values: DataFrame) -> dict[str, list[str]]:
    found = values.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()
    return {c: next((r["values"] for r in found if r["column"] == c), []) for c in CATEGORICAL_FEATURES}


def feature_names(cats: dict[str, list[str]]) -> list[str]:
    """M3 order: numeric, boolean, then each categorical minus its first value."""
    names = list(NUMERIC_FEATURES) + list(BOOLEAN_FEATURES)
    for c in CATEGORICAL_FEATURES:
        names += [f"{c}_{v}" for v in cats[c][1:]]
    return names


def sparse_features(rows: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """M3: the rows with ``places`` and ``values``, the sparse one-hot vector's positions and entries other than 0.

    The category ranks are joined by value; Spark picks the join by their size.
    """
    if values is None:
        values = dictionary(statistics(rows if "is_test" in rows.columns else rows.withColumn("is_test", F.lit(False))))
    ranks = materialised(positions(values))
    out = impute_encode(rows, {})
    for c in CATEGORICAL_FEATURES:
        own = ranks.where(F.col("column") == c).select(F.col("value").alias(c), F.col("position").alias(f"_{c}"))
        out = out.join(own, c, "left")
    entries = [F.struct(F.lit(i).alias("place"), F.col(c).cast("double").alias("value"))
               for i, c in enumerate(NUMERIC_FEATURES + BOOLEAN_FEATURES)]
    entries += [F.struct(F.col(f"_{c}").alias("place"), F.lit(1.0).alias("value")) for c in CATEGORICAL_FEATURES]
    full = F.filter(F.array(*entries), lambda e: e["place"].isNotNull() & (e["value"] != 0))
    return out.withColumn("_full", full).select(
        *rows.columns, F.col("_full.place").alias("places"), F.col("_full.value").alias("values"))


def features_long(df: DataFrame) -> DataFrame:
    """M3 as a long frame (customerID, feature, value): one row per feature, zeros included."""
    base = training_set(df)
    cats = categories(materialised(base.select(*base.columns)))
    rows = impute_encode(base, {})
    value = lambda c: F.col(c).cast("double")
    entries = [F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in NUMERIC_FEATURES + BOOLEAN_FEATURES]

    def hot(c: str) -> Column:
        kept = F.lit(cats[c][1:]) if len(cats[c]) > 1 else F.array().cast("array<string>")
        return F.transform(kept, lambda v: F.struct(
            F.concat(F.lit(f"{c}_"), v).alias("feature"), (F.col(c) == v).cast("double").alias("value")))

    parts = [F.array(*entries), *map(hot, CATEGORICAL_FEATURES)]
    return rows.select("customerID", F.explode(F.concat(*parts)).alias("e")).select("customerID", "e.feature", "e.value")


#: leading hex digits of an id's digest that make one of 65,536 buckets
SPLIT_DIGITS = 4


def with_split(df: DataFrame, id_col: str = "customerID", label: str = "churn") -> DataFrame:
    """M4: ``is_test`` marks the first 20 % (rounded half up) of each class in
    the order of the ids' md5 digests.

    The place of the cut is found without ranking a class: digests are counted
    by bucket (at most 65,536 a class), and only the bucket that holds the cut
    is ranked.  Rows that repeat an id fall on one side; a NULL id is never a
    test row; a class whose share rounds to 0 has no test rows.
    """
    digest = F.md5(F.col(id_col).cast("string"))
    bucket = F.substring(digest, 1, SPLIT_DIGITS)
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(label).alias("_class"), bucket.alias("_b"), digest.alias("_d"))
    by_class = Window.partitionBy("_class")
    upto, total = F.sum("_n").over(by_class.orderBy("_b")), F.sum("_n").over(by_class)
    edge = (rows.groupBy("_class", "_b").agg(F.count(F.lit(1)).alias("_n"))
                .select("_class", "_b", "_n", upto.alias("_upto"), F.round(total * TEST_FRACTION).alias("_want"))
                .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
                .select("_class", "_b", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_place")))
    # one edge and one cut per class
    cut = (rows.join(F.broadcast(edge), ["_class", "_b"])
               .withColumn("_k", F.row_number().over(by_class.orderBy("_d")))
               .where(F.col("_k") == F.col("_place")).select("_class", F.col("_d").alias("_cut")))
    return (df.join(F.broadcast(cut), F.col(label) == F.col("_class"), "left")
              .withColumn("is_test", F.coalesce(digest <= F.col("_cut"), F.lit(False)))
              .drop("_class", "_cut"))


def scaling(stats: DataFrame) -> DataFrame:
    """M5: (feature, mean, std) over the training rows, from the one-pass statistics."""
    train = stats.where(~F.col("is_test"))
    n = F.col("n")
    sums = train.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in stats.columns if c.startswith(("sum_", "squares_"))])
    numeric = [(c, F.col(f"sum_{c}") / n, F.col(f"squares_{c}") / n) for c in NUMERIC_FEATURES]
    flags = [(c, F.col(f"sum_{c}") / n, F.col(f"sum_{c}") / n) for c in BOOLEAN_FEATURES]  # 1 * 1 = 1
    deviation = lambda mean, square: F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    four = F.array(*[F.struct(F.lit(c).alias("feature"), mean.alias("mean"), deviation(mean, square).alias("std"))
                     for c, mean, square in numeric + flags])
    plain = sums.where("n > 0").select(F.explode(four).alias("f")).select("f.*")
    share = F.col("n_train") / F.col("total")
    kept = dictionary(stats).where(~F.col("first")).join(sums.select(F.col("n").alias("total")).where("total > 0"))
    return plain.unionByName(kept.select(
        F.concat("column", F.lit("_"), "value").alias("feature"), share.alias("mean"), deviation(share, share).alias("std")))


def scaling_frame(df: DataFrame) -> DataFrame:
    """M5 as a frame: (feature, mean, std) over the training rows."""
    return scaling(materialised(statistics(with_split(materialised(training_set(df))))))


def class_weights(df: DataFrame) -> DataFrame:
    """M6: balanced weights w_c = n / (2 n_c) over the training rows."""
    train = with_split(materialised(training_set(df).select("customerID", "churn"))).where(~F.col("is_test"))
    g = train.groupBy("churn").agg(F.count(F.lit(1)).alias("n_class"))
    total = F.sum("n_class").over(_tiny())
    return g.select("churn", "n_class", (total / (2 * F.col("n_class"))).alias("weight"))


def _tiny():
    return Window.partitionBy()   # over <= 2 class rows


def _prepare(weights: dict[int, float]) -> SQLTransformer:
    """M2 and M6 as one statement: numbers as double, Unknown fill, flags, the constant and the row's weight."""
    flags = ", ".join(f"CASE WHEN {c} = 'Yes' THEN 1.0D ELSE 0.0D END AS _{c}" for c in BOOLEAN_FEATURES)
    numbers = ", ".join(f"CAST({c} AS DOUBLE) AS _{c}" for c in NUMERIC_FEATURES)
    names = ", ".join(f"coalesce({c}, 'Unknown') AS _{c}" for c in CATEGORICAL_FEATURES)
    return SQLTransformer(statement=(
        f"SELECT *, {numbers}, {flags}, {names}, 1.0D AS _constant, CASE WHEN churn = 1 THEN CAST({weights[1]!r} AS DOUBLE) "
        f"ELSE CAST({weights[0]!r} AS DOUBLE) END AS weight FROM __THIS__"))


def preprocessing(cats: dict[str, list[str]], weights: dict[int, float], n_train: int) -> list:
    """M2-M6 as pipeline stages, up to the vector ``features`` with the constant last.

    Values not seen in training get no one-hot column, as the dropped first one."""
    stages: list = [_prepare(weights)]
    vectors = [f"_{c}" for c in NUMERIC_FEATURES + BOOLEAN_FEATURES]
    for c in CATEGORICAL_FEATURES:
        if len(cats[c]) < 2:
            continue
        # the dropped value goes last, and what is unknown after it
        stages += [StringIndexerModel.from_labels(cats[c][1:] + cats[c][:1], inputCol=f"_{c}", outputCol=f"_{c}_rank", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"_{c}_rank", outputCol=f"_{c}_all", dropLast=False),
                   VectorSlicer(inputCol=f"_{c}_all", outputCol=f"_{c}_hot", indices=list(range(len(cats[c]) - 1)))]
        vectors.append(f"_{c}_hot")
    width = len(feature_names(cats))
    # the scaler divides by the sample deviation; the factor makes that the population's
    factor = (n_train / (n_train - 1)) ** 0.5 if n_train > 1 else 1.0
    return stages + [
        VectorAssembler(inputCols=vectors, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="_scaled", outputCol="_z", scalingVec=Vectors.dense([factor] * width)),
        VectorAssembler(inputCols=["_z", "_constant"], outputCol="features")]


def gradient(rows: DataFrame, coefficients: list[float]) -> np.ndarray:
    """M7: the gradient of 1/2 |w|^2 + sum of weight * logistic loss at ``coefficients``, in one pass.

    ``rows`` has features, churn and weight (above 0 in some row)."""
    dot = F.aggregate(F.zip_with(vector_to_array("features"), F.lit([float(x) for x in coefficients]), lambda x, w: x * w),
                      F.lit(0.0), lambda acc, x: acc + x)
    residual = F.col("weight") * (1 / (1 + F.exp(-dot)) - F.col("churn"))
    # a summarizer takes weights of at least 0, and a residual is at least minus its row's weight
    part = lambda w: Summarizer.metrics("sum").summary(F.col("features"), w).getField("sum")
    found = rows.select("features", "weight", residual.alias("r"), F.lit(True).alias("all")).groupBy("all").agg(
        part(F.col("weight") + F.col("r")).alias("both"), part(F.col("weight")).alias("weights")).first()
    penalty = np.array([float(x) for x in coefficients])
    return penalty if found is None else penalty + found.both.toArray() - found.weights.toArray()


def _sign() -> Column:
    """1 or -1 by the customer's id."""
    return F.when(F.xxhash64("customerID").bitwiseAND(1) == 0, 1.0).otherwise(-1.0)


def turned(rows: DataFrame) -> DataFrame:
    """The rows of sign -1 as their mirror images: features negated and the class swapped, which has the same loss.

    The regression gives features that never vary no coefficient; mirrored
    rows make the constant vary, and leave the objective as it is."""
    features = F.transform(vector_to_array("features"), lambda x: x * F.col("sign"))
    return rows.select(array_to_vector(features).alias("features"), "weight",
                       F.when(F.col("sign") > 0, F.col("churn")).otherwise(1 - F.col("churn")).alias("churn"))


def train(df: DataFrame) -> tuple[PipelineModel, dict]:
    """M7: fit the pipeline on the training rows; return it and its metrics."""
    model, metrics, _ = train_with_scores(df)
    return model, metrics


def fitted_inputs(df: DataFrame) -> tuple[DataFrame, dict, dict[str, list[str]], dict[int, float]]:
    """M1-M6 for a fit: the split model rows, their counts, categories and class weights."""
    rows = materialised(with_split(materialised(training_set(df))))
    stats = materialised(statistics(rows))
    side = {(r.is_test, r.churn): r.n for r in stats.groupBy("is_test", "churn").agg(F.sum("n").alias("n")).collect()}
    n = sum(side.values())
    if not n:
        raise ValueError("the model has no rows to learn from")
    n_train, n_pos = sum(v for (test, _), v in side.items() if not test), side.get((False, 1), 0)
    n_neg = n_train - n_pos
    weights = {1: n_train / (2.0 * n_pos) if n_pos else 0.0, 0: n_train / (2.0 * n_neg) if n_neg else 0.0}
    counts = {"n": n, "n_train": n_train, "positive": sum(v for (_, y), v in side.items() if y == 1),
              "weight": weights[1] * n_pos + weights[0] * n_neg}
    return rows, counts, _names(dictionary(stats)), weights


def train_with_scores(df: DataFrame) -> tuple[PipelineModel, dict, DataFrame]:
    """M7 + M8: fit, evaluate, and also return the scored held-out rows
    (read from the same materialised model rows, not re-derived)."""
    return fit_inputs(*fitted_inputs(df))


def fit_inputs(rows: DataFrame, counts: dict, cats: dict[str, list[str]], weights: dict[int, float]) -> tuple[PipelineModel, dict, DataFrame]:
    """``train_with_scores`` from what ``fitted_inputs`` gives, for callers that read the split rows again."""
    n, n_train = counts["n"], counts["n_train"]
    names = feature_names(cats)
    train_rows = rows.where(~F.col("is_test"))
    prepare = Pipeline(stages=preprocessing(cats, weights, n_train)).fit(train_rows)
    ready = materialised(prepare.transform(train_rows).select("features", "churn", "weight", _sign().alias("sign")))
    reg = 1.0 / max(counts["weight"], 1.0)
    fit = LogisticRegression(featuresCol="features", labelCol="churn", weightCol="weight", regParam=reg, elasticNetParam=0.0,
                             standardization=False, fitIntercept=False, maxIter=MAX_ITER, tol=1e-12).fit(turned(ready))
    model = PipelineModel(stages=[*prepare.stages, fit])
    weight = [float(x) for x in fit.coefficients]
    steep = float(np.abs(gradient(ready, weight)).max()) / max(n_train, 1)
    scored = materialised(score(model, rows.where(F.col("is_test"))))
    auc_row = rank_auc(scored, "churn", "score").first()
    metrics = {
        "model_type": "logistic_regression",
        "feature_names": names,
        "coefficients": weight[:-1],
        "intercept": weight[-1],
        "gradient": steep,
        "converged": steep <= GRADIENT_TOLERANCE,
        "auc": auc_row.auc,
        "auc_positive": int(auc_row.n_pos),
        "auc_negative": int(auc_row.n_neg),
        "total_samples": int(n),
        "total_features": len(names),
        "train_samples": int(n_train),
        "test_samples": int(n - n_train),
        "positive_rate": round(counts["positive"] / n, 4),
        "trained_at": datetime.now(timezone.utc).isoformat(),
        "params": {"reg_param": reg, "max_iter": MAX_ITER, "penalised_intercept": True,
                   "class_weight": "balanced", "test_fraction": TEST_FRACTION},
        "preprocessing": {"categories": cats},
    }
    return model, metrics, scored


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """M8: P(churn) for each row."""
    return (model.transform(rows)
                 .select("customerID", "churn",
                         vector_to_array("probability").getItem(1).alias("score")))


def rank_auc(scored: DataFrame, label: str = "churn", score_col: str = "score") -> DataFrame:
    """M9: exact ROC AUC = P(score_pos > score_neg) + 0.5 P(tie), 4 dp.

    Scores are grouped (ties collapse), then each positive count is paired
    with the negatives strictly below it via a distributed prefix sum."""
    g = scored.groupBy(score_col).agg(
        F.sum(label).cast("long").alias("_pos"),
        (F.count(F.lit(1)) - F.sum(label)).cast("long").alias("_neg"))
    g = prefix_sum(g, [score_col], "_neg", "_neg_below")
    a = g.agg(F.sum(F.col("_pos").cast("double") * (F.col("_neg_below") + 0.5 * F.col("_neg"))).alias("_u"),
              F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return a.select(round_fp(safe_div("_u", F.col("n_pos").cast("double") * F.col("n_neg").cast("double"), None), 4).alias("auc"),
                    F.coalesce("n_pos", F.lit(0)).cast("long").alias("n_pos"),
                    F.coalesce("n_neg", F.lit(0)).cast("long").alias("n_neg"))


def coefficients_frame(spark: SparkSession, metrics: dict) -> DataFrame:
    """M7/M10 input: (feature, weight, position) — one row per model feature."""
    rows = [(n, float(w), i) for i, (n, w) in
            enumerate(zip(metrics["feature_names"], metrics["coefficients"]))]
    return literal_frame(spark, rows, [("feature", "string"), ("weight", "double"),
                                       ("position", "int")])


def top_features(coefs: DataFrame, k: int = TOP_K) -> DataFrame:
    """Weights at 4 dp, largest |weight| first (ties keep the feature
    order, as a stable sort does), top ``k`` (a top-k report)."""
    w = coefs.select("feature", F.round("weight", 4).alias("weight"), "position")
    return w.orderBy(F.abs("weight").desc(), "position").limit(k).drop("position")


def directions(coefs: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` features with the direction of their effect."""
    t = top_features(coefs, k)
    return t.withColumn("direction", F.when(F.col("weight") > 0, "increases").otherwise("decreases"))


def training_info(df: DataFrame) -> DataFrame:
    """Totals, feature count, train/test sizes, positive rate (4 dp)."""
    stats = materialised(statistics(with_split(materialised(training_set(df)))))
    n_feat = len(NUMERIC_FEATURES) + len(BOOLEAN_FEATURES)
    when = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    kept = dictionary(stats).agg(F.count_if(~F.col("first")).alias("kept"))  # one row
    totals = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"), when(~F.col("is_test")).alias("train_samples"),
                       when(F.col("is_test")).alias("test_samples"),
                       (F.sum(F.when(F.col("churn") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("_pr"))
    return totals.join(kept).select(
        "total_samples", (F.lit(n_feat) + F.col("kept")).cast("long").alias("total_features"),
        F.coalesce("train_samples", F.lit(0)).alias("train_samples"), F.coalesce("test_samples", F.lit(0)).alias("test_samples"),
        round_fp("_pr", 4).alias("positive_rate"))


# --- M12 / M13: persistence -----------------------------------------------------
def save(model: PipelineModel, metrics: dict, path: str) -> None:
    """Write the pipeline and a one-row metrics table beside it (overwrite)."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(os.path.join(path, "pipeline"))
    spark.createDataFrame([(json.dumps(metrics), metrics["trained_at"], metrics["auc"],
                            metrics["total_features"])],
                          "metrics string, trained_at string, auc double, total_features int") \
         .write.mode("overwrite").parquet(os.path.join(path, "metrics"))


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    model = PipelineModel.load(os.path.join(path, "pipeline"))
    row = spark.read.parquet(os.path.join(path, "metrics")).first()
    return model, json.loads(row.metrics)


def load_or_train(df: DataFrame, path: str, retrain: bool = False) -> tuple[PipelineModel, dict]:
    """Load the saved model if both parts exist, else (or if ``retrain``) train and save."""
    spark = df.sparkSession
    if not retrain:
        if exists(spark, os.path.join(path, "metrics")):  # other errors of storage are not hidden
            return load(spark, path)
    model, metrics = train(df)
    save(model, metrics, path)
    return model, metrics


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """Whether a model is saved, when it was trained, its AUC and size."""
    if not exists(spark, os.path.join(path, "metrics")):
        return spark.createDataFrame([(False, None, None, None)],
                                     "model_exists boolean, trained_at string, auc double, "
                                     "total_features int")
    m = spark.read.parquet(os.path.join(path, "metrics"))
    return m.select(F.lit(True).alias("model_exists"), "trained_at", "auc", "total_features")


def model_config() -> dict:
    """Feature groups and training parameters."""
    return {"numeric_features": NUMERIC_FEATURES, "categorical_features": CATEGORICAL_FEATURES,
            "boolean_features": BOOLEAN_FEATURES, "test_fraction": TEST_FRACTION,
            "max_iter": MAX_ITER, "class_weight": "balanced", "penalty": "l2", "C": 1.0,
            "penalised_intercept": True}
