"""Confusion matrices, classification reports and ROC curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import number
from quadrat.operators.quantiles import running_totals


def predictions_vs_truth(pred: DataFrame, truth: str, prediction: str, keys: Sequence[str]) -> DataFrame:
    """``(keys…, truth, prediction)``: both already stand on the same row."""
    return pred.select(*keys, F.col(truth).alias("truth"), F.col(prediction).alias("prediction"))


def _counts(df: DataFrame, truth: str, pred: str, by: Sequence[str]) -> DataFrame:
    return (
        df.select(*by, F.col(truth).alias("truth"), F.col(pred).alias("prediction"))
        .dropna(subset=["truth", "prediction"])
        .groupBy(*by, "truth", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``(truth, prediction, n)`` for every pair of labels that occur, zeros included."""
    counts = _counts(df, truth, pred, [])
    labels = counts.select(F.explode(F.array("truth", "prediction")).alias("truth")).distinct()
    # every label names all labels: the output is labels x labels by definition
    all_labels = labels.agg(F.array_sort(F.collect_set("truth"))).scalar()
    cells = labels.select("truth", F.explode(all_labels).alias("prediction"))
    return cells.join(counts, ["truth", "prediction"], "left").select(
        "truth", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def class_scores(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, label, tp, predicted, support, precision, recall, f1)`` per class.

    One pass over the rows; undefined ratios are zero.
    """
    counts = _counts(df, truth, pred, by)
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("s"), none.alias("q"),
                 hit.cast("bigint").alias("t")),
        F.struct(F.col("prediction").alias("label"), none.alias("s"), F.col("n").alias("q"),
                 none.alias("t")),
    )
    per_class = counts.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("t").alias("tp"), F.sum("q").alias("predicted"), F.sum("s").alias("support")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), zero)
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("tp"), (F.col("predicted") + F.col("support")).cast("double")), zero
    )
    return per_class.select(
        "*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )


def overall_scores(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, n, accuracy, balanced_accuracy, macro_…, weighted_…)``."""
    classes = class_scores(df, truth, pred, by)
    support = F.col("support")
    averages = [
        expression
        for c in ("precision", "recall", "f1")
        for expression in (
            F.avg(c).alias(f"macro_{c}"),
            (F.sum(F.col(c) * support) / F.sum("support")).alias(f"weighted_{c}"),
        )
    ]
    return classes.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp").cast("double") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"),
        *averages,
    )


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``(label, precision, recall, f1, support)``: classes, then the averages."""
    classes = class_scores(df, truth, pred).select(
        F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support"
    )
    accuracy, balanced = F.col("accuracy"), F.col("balanced_accuracy")
    lines = F.array(
        F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"),
                 accuracy.alias("recall"), accuracy.alias("f1"), F.col("n").alias("support")),
        *[
            F.struct(F.lit(f"{kind} avg").alias("label"), F.col(f"{kind}_precision").alias("precision"),
                     F.col(f"{kind}_recall").alias("recall"), F.col(f"{kind}_f1").alias("f1"),
                     F.col("n").alias("support"))
            for kind in ("macro", "weighted")
        ],
        F.struct(F.lit("balanced accuracy").alias("label"), balanced.alias("precision"),
                 balanced.alias("recall"), balanced.alias("f1"), F.col("n").alias("support")),
    )
    averages = overall_scores(df, truth, pred).select(F.inline(lines))
    return classes.unionByName(averages)


def score_spread(classes: DataFrame) -> DataFrame:
    """``(metric, mean, std)`` over the classes, population deviation."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
            for c in ("precision", "recall", "f1")
        ]
    )
    return classes.agg(cells.alias("__c")).select(F.inline("__c"))


def _score_steps(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Running positives and negatives from the largest score down, per distinct score."""
    positive = F.sum(F.col(truth).cast("int")).cast("bigint")
    steps = (
        df.select(F.col(truth), (-number(score)).alias("down"))
        .dropna()
        .groupBy("down")
        .agg(positive.alias("pos"), (F.count(F.lit(1)) - positive).alias("neg"))
    )
    return running_totals(steps, "down", ["pos", "neg"])


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """``(threshold, fpr, tpr)`` of a 0/1 truth at every distinct score, with the origin."""
    steps = _score_steps(df, truth, score)
    totals = steps.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    points = steps.select(
        (-F.col("down")).alias("threshold"),
        F.try_divide(F.col("upto_neg").cast("double"), totals["n"]).alias("fpr"),
        F.try_divide(F.col("upto_pos").cast("double"), totals["p"]).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame(
        [(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return origin.unionAll(points)


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row ``(positives, negatives, auc)`` by the trapezoid rule."""
    steps = _score_steps(df, truth, score)
    area = F.sum(F.col("neg") * (F.col("upto_pos") - F.col("pos") / 2.0))
    return steps.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), area.alias("area")
    ).select(
        "positives",
        "negatives",
        F.try_divide(
            F.col("area"), F.col("positives").cast("double") * F.col("negatives")
        ).alias("auc"),
    )
