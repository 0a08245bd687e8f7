"""Base learners, predictions, importances and tree rules."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.durable import durable
from quadrat.operators.evaluation import class_scores, overall_scores
from quadrat.operators.sampling import hashed_rank


class _Columns(
    HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol
):
    pass


class LinearDiscriminantModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Scores every class by a linear function of the features."""

    fitted = Param(Params._dummy(), "fitted", "JSON: weights, offsets", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        plan = json.loads(self.getOrDefault(self.fitted))
        x = vector_to_array(self.getFeaturesCol())

        def score(weights: list[float], offset: float):
            products = F.zip_with(x, F.lit(weights), lambda a, b: a * b)
            return F.aggregate(products, F.lit(float(offset)), lambda acc, v: acc + v)

        raw = F.array(*[score(w, b) for w, b in zip(plan["weights"], plan["offsets"], strict=True)])
        out = dataset.withColumn("__raw", raw).withColumn("__top", F.array_max("__raw"))
        odds = F.transform("__raw", lambda v: F.exp(v - F.col("__top")))
        out = out.withColumn("__odds", odds)
        whole = F.aggregate("__odds", F.lit(0.0), lambda acc, v: acc + v)
        return out.select(
            *dataset.columns,
            array_to_vector("__raw").alias(self.getRawPredictionCol()),
            array_to_vector(F.transform("__odds", lambda v: v / whole)).alias(
                self.getProbabilityCol()
            ),
            (F.array_position("__raw", F.col("__top")).cast("double") - 1.0).alias(
                self.getPredictionCol()
            ),
        )


class LinearDiscriminant(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Linear discriminant analysis from class means and the pooled covariance.

    One aggregate per class gives counts, means and co-moments; only class-sized
    and feature-sized numbers reach the driver.
    """

    def __init__(self, labelCol: str = "label", featuresCol: str = "features"):
        super().__init__()
        self._set(labelCol=labelCol, featuresCol=featuresCol)

    def _fit(self, dataset: DataFrame) -> LinearDiscriminantModel:
        p = len(dataset.select(self.getFeaturesCol()).first()[0])
        x = vector_to_array(self.getFeaturesCol())
        upper = [(i, j) for i in range(p) for j in range(i, p)]
        rows = dataset.select(F.col(self.getLabelCol()).cast("int").alias("label"), x.alias("x"))
        wide = rows.select("label", *[F.col("x")[i].alias(f"x{i}") for i in range(p)])
        table = wide.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(f"x{i}") for i in range(p)]).alias("m"),
            F.array(*[F.covar_pop(f"x{i}", f"x{j}") for i, j in upper]).alias("c"),
        ).collect()
        total = sum(r["n"] for r in table)
        pooled = np.zeros((p, p))
        for r in table:
            for (i, j), v in zip(upper, r["c"], strict=True):
                pooled[i, j] += r["n"] * v
        pooled = np.triu(pooled) + np.triu(pooled, 1).T
        inverse = np.linalg.pinv(pooled / (total - len(table)))
        classes = max(r["label"] for r in table) + 1
        weights, offsets = np.zeros((classes, p)), np.full(classes, -1e300)
        for r in table:
            mean = np.array(r["m"])
            weights[r["label"]] = inverse @ mean
            offsets[r["label"]] = -0.5 * mean @ inverse @ mean + np.log(r["n"] / total)
        model = LinearDiscriminantModel()
        model._set(
            fitted=json.dumps({"weights": weights.tolist(), "offsets": offsets.tolist()}),
            featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
            predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(),
            rawPredictionCol=self.getRawPredictionCol(),
        )
        return model


LEARNERS = (
    "random_forest", "gradient_boosting", "naive_bayes", "linear_discriminant",
    "decision_tree", "linear_svm", "logistic_regression",
)


#: Classes that one-against-rest learners fit at a time; the models do not depend on it.
CLASSES_AT_ONCE = 2


def base_learners(label: str = "label", seed: int = 42) -> dict[str, Estimator]:
    """The learners by name, with their usual settings."""
    return {
        "random_forest": RandomForestClassifier(
            labelCol=label, numTrees=100, maxDepth=4, seed=seed
        ),
        "gradient_boosting": OneVsRest(
            classifier=GBTClassifier(maxDepth=4, stepSize=0.05, maxIter=100, seed=seed),
            labelCol=label, parallelism=CLASSES_AT_ONCE,
        ),
        "naive_bayes": NaiveBayes(labelCol=label, modelType="gaussian"),
        "linear_discriminant": LinearDiscriminant(labelCol=label),
        "decision_tree": DecisionTreeClassifier(
            labelCol=label, maxDepth=3, minInstancesPerNode=20, impurity="gini", seed=seed
        ),
        "linear_svm": OneVsRest(
            classifier=LinearSVC(maxIter=100), labelCol=label, parallelism=CLASSES_AT_ONCE
        ),
        "logistic_regression": LogisticRegression(labelCol=label, maxIter=100),
    }


def predict(model: Model, df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``prediction`` and, given the sorted labels, ``predicted_label``."""
    out = model.transform(df)
    if labels is None:
        return out
    name = F.element_at(F.lit(list(labels)), F.col("prediction").cast("int") + 1)
    return out.withColumn("predicted_label", name)


def accuracy_of(model: Model, df: DataFrame, label: str, name: str) -> DataFrame:
    """``(set, n, accuracy)`` of a model on one data set."""
    scores = overall_scores(model.transform(df), label, "prediction")
    return scores.select(F.lit(name).alias("set"), "n", "accuracy")


def tree_importances(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """``(feature, importance)`` of a fitted tree model, largest first."""
    weights = model.featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights, strict=True)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def tree_rules(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """``(tree, node, feature, threshold, left, right, impurity, prediction, leaf)``.

    One row per node of a fitted decision tree or of all trees of a forest.
    """
    trees = list(getattr(model, "trees", None) or [model])
    rows = []
    for t, tree in enumerate(trees):
        pending, count = [(0, tree._call_java("rootNode"))], 1
        while pending:
            number, node = pending.pop(0)
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                at = split.threshold() if hasattr(split, "threshold") else None
                rows.append((t, number, names[split.featureIndex()], at, count, count + 1,
                             node.impurity(), node.prediction(), False))
                pending += [(count, node.leftChild()), (count + 1, node.rightChild())]
                count += 2
            else:
                rows.append((t, number, None, None, None, None, node.impurity(),
                             node.prediction(), True))
    return df.sparkSession.createDataFrame(
        rows,
        "tree int, node int, feature string, threshold double, left int, right int, "
        "impurity double, prediction double, leaf boolean",
    )


def importance_by_permutation(
    model: Model,
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    key: str,
    seed: int = 42,
) -> DataFrame:
    """``(feature, drop)``: loss of accuracy when one column is shuffled.

    Two hash orders pair every row with another one; the pairing is an equi-join
    on the position, so any size can be shuffled. Rows and pairs are written
    once for all columns.
    """
    df = durable(df)
    base = overall_scores(model.transform(df), label, "prediction").select(
        F.lit(None).cast("string").alias("feature"), "accuracy"
    )
    here = hashed_rank(df, [key], seed, name="__at")
    there = hashed_rank(df, [key], seed + 1, name="__at").select(
        "__at", *[F.col(c).alias(f"__{c}") for c in columns]
    )
    paired = durable(here.join(there, "__at"))
    table = base
    for c in columns:
        mixed = paired.withColumn(c, F.col(f"__{c}")).select(*df.columns)
        scored = overall_scores(model.transform(mixed), label, "prediction")
        table = table.unionAll(scored.select(F.lit(c).alias("feature"), "accuracy"))
    table = durable(table)  # a row per column, read twice
    plain = table.agg(F.max(F.when(F.col("feature").isNull(), F.col("accuracy")))).scalar()
    return table.filter(F.col("feature").isNotNull()).select(
        "feature", (plain - F.col("accuracy")).alias("drop")
    )


def per_class(df: DataFrame, label: str) -> DataFrame:
    """Per-class precision, recall and f1 of a prediction table."""
    return class_scores(df, label, "prediction").select(
        "label", "precision", "recall", "f1", "support"
    )
