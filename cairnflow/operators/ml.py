"""Training sets, splits, a random forest, scores and decisions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.columns import decision
from cairnflow.sources.folders import shared_folder, written

INPUTS = [
    "transaction_count_24h", "transaction_count_7d", "transaction_count_30d", "total_amount_24h", "avg_amount_7d", "max_amount_30d",
    "unique_merchants_7d", "unique_categories_30d", "transactions_last_hour", "amount_zscore", "amount",
]

KNOWN_BEFORE = [c for c in INPUTS if c not in ("amount", "amount_zscore")]
"""Inputs that don't contain the transaction's own amount, for labels that depend on it."""

STRETCHES = 1024


def training_set(labels: DataFrame, transactions: DataFrame, features: DataFrame) -> DataFrame:
    """Labels and transactions by transaction_id, and the feature rows of the same entity and instant."""
    return labels.join(transactions, "transaction_id").join(features, ["entity_id", "us"])


def _cut(rows: DataFrame, column: str, n: int) -> tuple[int, int]:
    """The value of a whole-number column at place n (from 1) of its order, and how many rows have a smaller one.

    Found by counts of rows in a thousand stretches of values, then in a thousand stretches of that stretch, and so on."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    size, before = 1, 0
    while size < high - low + 1:
        size *= STRETCHES
    while size > 1:
        inside, size = F.col(column).between(low, low + size - 1), size // STRETCHES
        counts = rows.where(inside).groupBy(F.floor((F.col(column) - low) / size).cast("long").alias("k")).count().orderBy("k").collect()
        for k, count in counts:  # STRETCHES at most
            if before + count >= n:
                low += k * size
                break
            before += count
    return low, before


def temporal_split(rows: DataFrame, share: float = 0.8, time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """Adds `train`: the first int(share * n) rows by time and then tie (whole numbers both, ties without repeats).

    Rows are never sorted in one task (see _cut); the two columns are written once, as several passes read them."""
    keys = written(rows.select(time, tie), shared_folder(rows.sparkSession, "split"))
    n = int(keys.count() * share)
    if n == 0:
        return rows.withColumn("train", F.lit(False))
    at, before = _cut(keys, time, n)
    last, _ = _cut(keys.where(F.col(time) == at), tie, n - before)
    return rows.withColumn("train", (F.col(time) < at) | ((F.col(time) == at) & (F.col(tie) <= last)))


def fit_forest(train: DataFrame, inputs: list[str], label: str = "label", trees: int = 100, depth: int = 10, leaf: int = 10, seed: int = 42) -> PipelineModel:
    """leaf: rows of a leaf, so that a node of fewer than twice as many isn't split. The node that a row has come to in each tree
    is kept, so that a level takes no walk from the root."""
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, cacheNodeIds=True)
    return Pipeline(stages=[assembler, forest]).fit(train.withColumn(label, F.col(label).cast("double")))


def importances(model: PipelineModel, inputs: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(inputs, map(float, model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: -x[1])


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds `probability` of class 1."""
    out = model.transform(rows.drop("label") if "label" in rows.columns else rows)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("p", "probability")


def roc_auc(scored: DataFrame, label: str = "label") -> float:
    """NaN if there is one class only."""
    if scored.select(label).distinct().count() < 2:
        return float("nan")
    rows = scored.select(F.col(label).cast("double").alias("label"), F.col("probability").alias("rawPrediction"))
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(rows)


def write_scores(scored: DataFrame, path: str, key: str = "transaction_id") -> DataFrame:
    """The scores and decisions as a table of their own, replaced as a whole; gives what is stored."""
    rows = scored.select(key, "probability", decision(F.col("probability")).alias("decision"))
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def report(scored: DataFrame, model: PipelineModel, inputs: list[str], label: str = "label") -> DataFrame:
    """A row for each figure: area under the curve, then the inputs by importance."""
    figures = [("roc_auc", 0, roc_auc(scored, label)), *((name, k + 1, v) for k, (name, v) in enumerate(importances(model, inputs)))]
    return scored.sparkSession.createDataFrame(figures, "figure string, place int, value double")


def metrics(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion counts, precision, recall and accuracy in one row."""
    y, p = F.col(label).cast("boolean"), F.col(prediction).cast("boolean")
    count = lambda a, b: F.count(F.when((y == a) & (p == b), 1))
    c = predicted.agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def decision_report(scored: DataFrame, labels: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Decisions against labels (a missing label counts as false): numbers, and how many were right."""
    rows = scored.join(labels.select(key, "label"), key, "left").withColumn("label", F.coalesce("label", F.lit(False)))
    rows = rows.withColumn("decision", decision(F.col("probability")))
    right = (F.col("decision") == "DECLINE") == F.col("label")
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.count(F.when(right, 1)).alias("correct"), F.count(F.when(F.col("label"), 1)).alias("positives"))
