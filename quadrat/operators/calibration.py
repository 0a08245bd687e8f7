"""Class probabilities from margins: isotonic and logistic calibration on out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.durable import durable
from quadrat.operators.persist import Nested
from quadrat.operators.tuning import with_folds

#: Neighbouring slots merged at a time.
MERGED = 16
#: Folds fitted at a time.
PARALLEL = 4
#: Inverse link of boosted trees on log loss: their margin is half the log odds.
BOOSTED_LINK = (2.0, 0.0)


def pooled(low: Iterable, high: Iterable, weight: Iterable, total: Iterable) -> list[tuple]:
    """Adjacent violators pooled: blocks ``(low, high, weight, total)`` with rising means, from ordered ones."""
    stack: list[tuple] = []
    for block in zip(low, high, weight, total):
        while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
            a = stack.pop()
            block = (a[0], block[1], a[2] + block[2], a[3] + block[3])
        stack.append(block)
    return stack


def isotonic_blocks(df: DataFrame, score: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, low, high, weight, value)``: the rising step function of ``score`` nearest to ``target`` in squares.

    Equal scores are added up first, so a frequent score is one row. The scores
    are range-sorted, violators are pooled inside each slot, and slots are
    merged with their neighbours in rounds. Pooling in any order gives the same
    blocks, and later rounds see only blocks: n rows of a 0/1 target leave at
    most about n^(2/3) of them. Rows without score or target are left out.
    """
    keys = list(keys)
    x, y = F.col(score).cast("double"), F.col(target).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & y.isNotNull() & ~F.isnan(y))
    sums = rows.groupBy(*keys, (x + F.lit(0.0)).alias("low")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum(y).alias("total"))
    sums = sums.withColumn("high", F.col("low"))
    slots = sums.repartitionByRange(*keys, "low").sortWithinPartitions(*keys, "low").withColumn("slot", F.spark_partition_id())
    names = [*keys, "slot", "low", "high", "weight", "total"]
    fields = {f.name: f.dataType.simpleString() for f in slots.schema}
    schema = ", ".join(f"`{n}` {fields[n]}" for n in names)

    def in_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        out = pd.DataFrame(pooled(pdf["low"], pdf["high"], pdf["weight"], pdf["total"]), columns=names[-4:])
        for n in names[:-4]:
            out[n] = pdf[n].iloc[0]
        return out[names]

    blocks, step = slots.select(*names), 1
    while True:
        blocks = durable(blocks.groupBy(*keys, "slot").applyInPandas(in_group, schema))
        if (blocks.agg(F.max("slot")).first()[0] or 0) == 0:
            break
        blocks, step = blocks.withColumn("slot", F.floor(F.col("slot") / MERGED).cast("int")), step + 1
    return blocks.select(*keys, "low", "high", "weight", (F.col("total") / F.col("weight")).alias("value"))


def isotonic_curve(blocks: Sequence) -> tuple[list[float], list[float]]:
    """Corner points of the step function, joined by straight lines in between."""
    xs, ys = [], []
    for low, high, value in sorted(blocks):
        xs += [low] if low == high else [low, high]
        ys += [value] if low == high else [value, value]
    return xs, ys


def logistic_fit(rows: DataFrame) -> tuple[float, float]:
    """Slope and offset of the log odds of ``hit`` by ``margin``, with the classes' shares drawn in a little.

    The targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2) instead of 1 and 0, so
    that separable margins keep a finite slope.
    """
    n1, n0 = rows.agg(F.count_if("hit"), F.count_if(~F.col("hit"))).first()
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return 0.0, float(np.log(share / (1 - share)))
    aim = F.when(F.col("hit"), (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), aim.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - aim).alias("weight"))
    )
    ready = rows.select(array_to_vector(F.array("margin")).alias("features"), F.inline(sides))
    model = LogisticRegression(maxIter=50, weightCol="weight", tol=1e-9).fit(ready)
    return float(model.coefficients[0]), float(model.intercept)


class CalibratedModel(Model, Nested):
    """A fitted classifier with ``probability`` and ``prediction`` from its calibrated margins."""

    CHILDREN, PLAIN = ("model",), ("curves", "probability", "prediction")

    def __init__(self, model: Model, curves: list[dict], probability: str = "probability", prediction: str = "prediction"):
        super().__init__()
        self.model, self.curves, self.probability, self.prediction = model, curves, probability, prediction

    def _share(self, raw: Column, place: int, curve: dict) -> Column:
        margin = F.get(raw, F.lit(place))
        if curve["kind"] == "logistic":
            return F.coalesce(1.0 / (1.0 + F.exp(-(margin * curve["slope"] + curve["offset"]))), F.lit(0.0))
        xs, ys = curve["x"], curve["y"]

        @F.pandas_udf("double")
        def stepped(m: pd.Series) -> pd.Series:
            return pd.Series(np.interp(m.fillna(-np.inf), xs, ys)) if xs else pd.Series(np.zeros(len(m)))

        return stepped(margin)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw = vector_to_array(self.model.getOrDefault("rawPredictionCol"))
        out = self.model.transform(dataset).drop(self.prediction, self.probability)
        out = out.withColumn("__p", F.array(*[self._share(raw, i, c) for i, c in enumerate(self.curves)]))
        whole = F.aggregate("__p", F.lit(0.0), lambda a, v: a + v)
        even = F.lit(1.0 / len(self.curves))
        out = out.withColumn("__p", F.transform("__p", lambda v: F.when(whole > 0, v / whole).otherwise(even)))
        place = F.array_position("__p", F.array_max("__p")).cast("double") - 1.0
        return out.withColumns({self.probability: array_to_vector("__p"), self.prediction: place}).drop("__p")


class CalibratedClassifier(Estimator, Nested):
    """Gives a classifier with margins, such as one-against-rest ones, class probabilities.

    ``method`` is logistic or isotonic, fitted per class on the margins of ``k``
    stratified folds that the fit left out, then normalised to sum to one; or
    ``link``, the inverse link of boosted trees, which needs no fold.
    """

    CHILDREN, PLAIN = ("classifier",), ("key", "method", "k", "seed", "probability")

    def __init__(
        self, classifier: Estimator, key: str, method: str = "logistic", k: int = 5, seed: int = 42, probability: str = "probability"
    ):
        super().__init__()
        if method not in ("logistic", "isotonic", "link"):
            raise ValueError(f"unknown method {method!r}")
        self.classifier, self.key, self.method, self.k, self.seed = classifier, key, method, k, seed
        self.probability = probability

    def getLabelCol(self) -> str:
        """Label column of the classifier."""
        return self.classifier.getLabelCol()

    def margins(self, dataset: DataFrame) -> DataFrame:
        """``(label, class, margin, hit)``: out-of-fold margins of every row and class."""
        label, raw = self.getLabelCol(), self.classifier.getOrDefault("rawPredictionCol")
        folds = with_folds(dataset.select(self.key, label, "features"), label, self.key, self.k, self.seed)

        def one(i: int) -> DataFrame:
            model = self.classifier.fit(folds.where(F.col("fold") != i).drop("fold"))
            scored = model.transform(folds.where(F.col("fold") == i).drop("fold"))
            return scored.select(F.col(label).cast("double").alias("label"), F.posexplode(vector_to_array(raw)).alias("class", "margin"))

        with ThreadPool(min(self.k, PARALLEL)) as pool:
            parts = pool.map(one, range(self.k))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return durable(out.withColumn("hit", F.col("label") == F.col("class")))

    def curves(self, dataset: DataFrame) -> list[dict]:
        """One curve per class."""
        classes = int(dataset.agg(F.max(F.col(self.getLabelCol()).cast("double"))).first()[0]) + 1
        if self.method == "link":
            return [{"kind": "logistic", "slope": BOOSTED_LINK[0], "offset": BOOSTED_LINK[1]}] * classes
        margins = self.margins(dataset)
        if self.method == "logistic":
            fits = [logistic_fit(margins.where(F.col("class") == c)) for c in range(classes)]
            return [{"kind": "logistic", "slope": a, "offset": b} for a, b in fits]
        blocks = isotonic_blocks(margins.withColumn("hit", F.col("hit").cast("double")), "margin", "hit", ["class"])
        got: list[list] = [[] for _ in range(classes)]
        for r in blocks.collect():  # the model itself: its steps
            got[r["class"]].append((r["low"], r["high"], r["value"]))
        return [dict(zip(("kind", "x", "y"), ("isotonic", *isotonic_curve(b)))) for b in got]

    def _fit(self, dataset: DataFrame) -> CalibratedModel:
        curves = self.curves(dataset)
        prediction = self.classifier.getOrDefault("predictionCol")
        return CalibratedModel(self.classifier.fit(dataset), curves, self.probability, prediction)
