"""Churn features, stratified split, two models, and scored customers."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import exact
from ..functions.order_stats import attach, bucket_levels, order_statistics, quantile_edges
from ..functions.shared import latest_row
from ..plans.session import shared_folder

# Windows, feature names, model settings and risk bands.
CHURN_WINDOW_DAYS = 120
NUMERIC = ["frequency", "monetary", "avg_order_value", "return_frequency", "customer_tenure_days", "age"]
CATEGORICAL = "region"
TARGET = "churned"
SEED = 42
MAX_ITERATIONS = 1000
TREES = 200
TREE_DEPTH = 8
LOW_RISK_BELOW = 0.33
MEDIUM_RISK_BELOW = 0.66
LOGISTIC = "logistic_regression"
FOREST = "random_forest"


# --- features ----------------------------------------------------------------

def churn_features(sales: DataFrame, customers: DataFrame, window: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """One row per known customer who ordered; churned when the last order is more than `window` days old."""
    # Filtered first, as the join below would filter it: one plan, one shuffle for rows and latest date.
    behaviour = sales.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("*").alias("frequency"), F.sum("revenue").alias("monetary"),
        F.max("order_date").alias("last_order"), F.min("order_date").alias("first_order"),
        exact.count_if(F.col("return_status") == "Returned").alias("returned"))
    orders = F.col("frequency").cast("double")
    recency = F.datediff(F.col("top.latest"), F.col("last_order"))
    joined = customers.select("customer_id", "region", "age").join(behaviour, "customer_id")
    return attach(joined, "top", latest_row(behaviour, "last_order")).select(
        "customer_id", "region", "age", "frequency", "monetary",
        (F.col("monetary").cast("double") / orders).alias("avg_order_value"),
        (F.col("returned").cast("double") / orders).alias("return_frequency"),
        recency.alias("recency_days"),
        F.datediff("last_order", "first_order").alias("customer_tenure_days"),
        F.when(recency > window, 1).otherwise(0).alias(TARGET),
    )


def churn_balance(features: DataFrame) -> DataFrame:
    counts = features.agg(F.sum(TARGET).alias("churned"), F.count("*").alias("customers"))
    return counts.select(
        "customers", "churned", (F.col("customers") - F.col("churned")).alias("active"),
        exact.count_percent(F.col("churned"), F.col("customers")).alias("churned_pct"),
        exact.count_percent(F.col("customers") - F.col("churned"), F.col("customers")).alias("active_pct"))


# Features of the summary, and the unit their quantiles are taken in: whole
# days and orders, cents, and millionths for the two quotients.
_SUMMARY = {"frequency": 1, "monetary": 100, "avg_order_value": 1_000_000, "return_frequency": 1_000_000,
            "recency_days": 1, "customer_tenure_days": 1}


def feature_summary(features: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of six features, with two decimals."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.lit(scale).cast("bigint").alias("scale"),
                 F.col(name).cast("double").alias("value"),
                 F.round(F.col(name).cast("decimal(24,8)") * scale).cast("bigint").alias("units"))
        for name, scale in _SUMMARY.items()])
    long = features.select(F.explode(entries).alias("e")).select("e.*")
    basics = long.groupBy("feature", "scale").agg(
        F.count("*").alias("count"), F.sum("units").alias("sum"), F.round(F.stddev_samp("value"), 2).alias("std"),
        F.min("units").alias("low"), F.max("units").alias("high"))
    edges = quantile_edges(long, "units", 4, "feature").select("feature", "edges")

    def decimals(units: Column, parts: Column | int = 1) -> Column:
        size = F.col("scale").cast(exact.WHOLE) * parts
        return exact.half_up(units.cast(exact.WHOLE), size, 100).cast("double") / 100

    return basics.join(edges, "feature").select(
        "feature", "count", decimals(F.col("sum"), exact.whole(F.col("count"))).alias("mean"), "std",
        decimals(F.col("low")).alias("min"),
        *[decimals(F.element_at("edges", i), 4).alias(name) for i, name in ((1, "p25"), (2, "p50"), (3, "p75"))],
        decimals(F.col("high")).alias("max"))


def churn_split(features: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds `is_test`: in each label a fixed quarter (rounded up) of the customers.

    Customers are ordered by a key mixed from id and seed.  Only the customer
    at the cut is searched for, so no task has to sort a whole label.
    """
    keyed = features.withColumn("mix", F.col("customer_id") * (7919 + seed) % 10007)
    places = keyed.select(TARGET, "mix", "customer_id")
    extent = places.agg(F.struct(
        F.min("customer_id").alias("lo"), F.max("customer_id").alias("hi"), F.count("*").alias("all"),
        F.sum(TARGET).alias("churned"), F.max("mix").alias("mix")))
    coarse, fine = bucket_levels(F.col("customer_id"), F.col("extent.lo"), F.col("extent.hi"))
    size = F.when(F.col(TARGET) == 1, F.col("extent.churned")).otherwise(F.col("extent.all") - F.col("extent.churned"))
    cells = attach(places, "extent", extent).select(
        TARGET, "mix", coarse.alias("coarse"), fine.alias("fine"), "customer_id", F.lit(1).alias("n"), size.alias("total"))
    cut = order_statistics(cells, ["mix", "coarse", "fine", "customer_id"],
                           lambda total: F.array(exact.int_div(total + 3, F.lit(4)) - 1), group=(TARGET,))
    cuts = cut.agg(F.map_from_entries(F.collect_list(F.struct(TARGET, F.struct("mix", "customer_id").alias("last")))))
    own = F.try_element_at(F.col("cuts"), F.col(TARGET))
    return attach(keyed, "cuts", cuts).withColumn("is_test", F.struct("mix", "customer_id") <= own).drop("mix", "cuts")


# --- models ------------------------------------------------------------------

def preprocessing() -> list:
    """Standardised numbers and one column per region; an unknown region is all zeros."""
    return [
        VectorAssembler(inputCols=NUMERIC, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        StringIndexer(inputCol=CATEGORICAL, outputCol="region_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="region_index", outputCol="region_flags", dropLast=True),
        VectorAssembler(inputCols=["scaled", "region_flags"], outputCol="features"),
    ]


def model_input(features: DataFrame) -> DataFrame:
    return features.withColumns({c: F.col(c).cast("double") for c in NUMERIC})


def churn_preprocess(features: DataFrame) -> DataFrame:
    """The model matrix: one array of numbers per customer, six features and then the regions."""
    rows = model_input(features)
    matrix = Pipeline(stages=preprocessing()).fit(rows).transform(rows)
    return matrix.select("customer_id", vector_to_array("features").alias("features"))


def churn_logistic(train: DataFrame) -> PipelineModel:
    """L2 logistic regression; a penalty of 1 on the summed loss is 1/n on the mean loss."""
    model = LogisticRegression(featuresCol="features", labelCol=TARGET, maxIter=MAX_ITERATIONS,
                               regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0, standardization=False)
    return _without_summary(train.sparkSession, Pipeline(stages=[*preprocessing(), model]).fit(train))


def churn_forest(train: DataFrame) -> PipelineModel:
    """Random forest with both labels given equal total weight.

    The node every customer has reached in every tree is kept from level to level, instead
    of being walked to again from the root; the trees are the same.
    """
    sizes = train.groupBy(TARGET).agg(F.count("*").alias("n"))
    weights = sizes.agg(F.struct(F.sum("n").alias("all"), F.count("*").alias("labels"),
                                 F.map_from_entries(F.collect_list(F.struct(TARGET, "n"))).alias("by")))
    own = F.element_at(F.col("weights.by"), F.col(TARGET))
    balanced = attach(train, "weights", weights).withColumn(
        "weight", F.col("weights.all").cast("double") / (F.col("weights.labels") * own)).drop("weights")
    model = RandomForestClassifier(featuresCol="features", labelCol=TARGET, weightCol="weight", numTrees=TREES,
                                   maxDepth=TREE_DEPTH, featureSubsetStrategy="sqrt", cacheNodeIds=True, seed=SEED)
    return _without_summary(train.sparkSession, Pipeline(stages=[*preprocessing(), model]).fit(balanced))


def _without_summary(spark: SparkSession, fitted: PipelineModel) -> PipelineModel:
    """The model as it is stored and read again.

    A freshly fitted classifier keeps its training summary, and with that the session,
    which goes to every task that scores with it.  A session in which an `Observation`
    was taken cannot be sent ("Task not serializable"); a stored model has no summary.
    """
    path = f"{shared_folder(spark)}/fitted-{uuid.uuid4().hex}"
    save_model(fitted, path)
    return load_model(path)


def churn_evaluate(model: PipelineModel, name: str, test: DataFrame) -> DataFrame:
    """Scores of a fitted model on held-out customers; the confusion matrix is [[TN, FP], [FN, TP]]."""
    judged = model.transform(test).select(F.col(TARGET).cast("double").alias(TARGET), "prediction", "rawPrediction")
    area = BinaryClassificationEvaluator(labelCol=TARGET, metricName="areaUnderROC", numBins=0).evaluate(judged)

    def cell(label: int, predicted: int) -> Column:
        return F.count_if((F.col(TARGET) == label) & (F.col("prediction") == predicted))

    counts = judged.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def share(num: Column, den: Column) -> Column:
        return F.round(exact.fraction(num, den), 4)

    return counts.select(
        F.lit(name).alias("model"), share(tp + tn, tn + fp + fn + tp).alias("accuracy"), share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        F.lit(round(area, 4)).alias("roc_auc"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"))


@dataclass(frozen=True)
class ChurnModels:
    models: dict[str, PipelineModel]
    metrics: DataFrame
    selected: str

    @property
    def model(self) -> PipelineModel:
        return self.models[self.selected]


def churn_select(scores: dict[str, float]) -> str:
    """Name of the model with the largest area under the curve; the first one if equal."""
    return max(scores, key=lambda name: scores[name])


METRICS = ("model string, accuracy double, precision double, recall double, f1_score double, roc_auc double, "
           "confusion_matrix array<array<bigint>>")


def train(features: DataFrame, split_path: str | None = None) -> ChurnModels:
    """Fits and compares both models.

    Fitting reads its input many times, so `features` should be a stored table
    (see `writers.publish`) and not a plan over the fact.  With `split_path` the split
    is written there once and every pass of the fits reads that.
    """
    split = churn_split(model_input(features))
    if split_path:
        split.write.mode("overwrite").parquet(split_path)
        split = features.sparkSession.read.parquet(split_path)
    fit, test = split.where(~F.col("is_test")), split.where("is_test")
    models = {LOGISTIC: churn_logistic(fit), FOREST: churn_forest(fit)}
    rows = [churn_evaluate(model, name, test).collect()[0] for name, model in models.items()]  # one row each
    metrics = features.sparkSession.createDataFrame(rows, METRICS)
    return ChurnModels(models, metrics, churn_select({r["model"]: r["roc_auc"] for r in rows}))


def churn_feature_impact(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Importance per feature: of the forest, or the size of the logistic coefficients."""
    fitted = model.stages[-1]
    regions = next(s for s in model.stages if hasattr(s, "labels")).labels
    sizes = fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients
    names = [*NUMERIC, *[f"{CATEGORICAL}_{r}" for r in regions]]
    rows = [(name, abs(float(value))) for name, value in zip(names, sizes.toArray())]
    return features.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def risk_category(probability: Column) -> Column:
    return (F.when(probability < LOW_RISK_BELOW, "Low Risk").when(probability < MEDIUM_RISK_BELOW, "Medium Risk")
            .otherwise("High Risk"))


def churn_score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Churn probability and risk of every customer, training customers included."""
    scored = model.transform(model_input(features)).select(
        "customer_id", "region", F.round(vector_to_array("probability")[1], 4).alias("churn_probability"))
    return scored.withColumn("risk_category", risk_category(F.col("churn_probability")))


def risk_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("risk_category").agg(F.count("*").alias("customers")).orderBy(
        F.desc("customers"), "risk_category")


def risk_filter(predictions: DataFrame, categories: list[str]) -> DataFrame:
    return predictions.where(F.col("risk_category").isin(*categories)).orderBy(F.desc("churn_probability"), "customer_id")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
