"""Cross-validation and parameter search over fold columns."""

from __future__ import annotations

import json
import random
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quadrat.operators.durable import durable
from quadrat.operators.evaluation import overall_scores
from quadrat.operators.sampling import stratified_folds


def with_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Rows with a stratified fold, written once so that every fit sees the same."""
    return durable(stratified_folds(df, label, k, [key], seed))


def cross_val_predictions(
    estimator: Estimator,
    df: DataFrame,
    label: str,
    key: str,
    k: int = 5,
    seed: int = 42,
    parallelism: int = 2,
    folded: bool = False,
) -> DataFrame:
    """``(key, fold, label, prediction)``: every row predicted by the fit that left it out."""
    folds = df if folded else with_folds(df, label, key, k, seed)

    def one(i: int) -> DataFrame:
        train = folds.filter(F.col("fold") != i).drop("fold")
        model = estimator.fit(train)
        test = model.transform(folds.filter(F.col("fold") == i).drop("fold"))
        return test.select(key, F.lit(i).alias("fold"), label, "prediction")

    with ThreadPool(min(parallelism, k)) as pool:
        parts = pool.map(one, range(k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


METRICS = (
    "accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "weighted_recall",
    "weighted_f1",
)


def fold_scores(predictions: DataFrame, label: str) -> DataFrame:
    """``(fold, metrics…)`` from one pass over the out-of-fold predictions."""
    scores = overall_scores(predictions, label, "prediction", ["fold"])
    return scores.select("fold", *METRICS)


def cross_validate(
    estimator: Estimator,
    df: DataFrame,
    label: str,
    key: str,
    k: int = 5,
    metrics: Sequence[str] = METRICS,
    sample_std: bool = True,
    seed: int = 42,
    parallelism: int = 2,
    folded: bool = False,
) -> DataFrame:
    """``(metric, mean, std)`` over the folds; ``std`` divides by n-1 or by n."""
    predictions = cross_val_predictions(estimator, df, label, key, k, seed, parallelism, folded)
    scores = fold_scores(predictions, label)
    spread = F.stddev_samp if sample_std else F.stddev_pop
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), spread(m).alias("std"))
            for m in metrics
        ]
    )
    return scores.agg(cells.alias("__c")).select(F.inline("__c"))


def parameter_grid(space: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed values."""
    return [dict(zip(space, values, strict=True)) for values in product(*space.values())]


def search(
    build: Callable[..., Estimator],
    options: Sequence[Mapping],
    df: DataFrame,
    label: str,
    key: str,
    k: int = 5,
    metric: str = "accuracy",
    seed: int = 42,
    parallelism: int = 2,
) -> DataFrame:
    """``(rank, parameters, mean, std)`` of each option, best first.

    The folds are drawn and written once and shared by all fits.
    """
    folds = with_folds(df, label, key, k, seed)

    def one(option: Mapping):
        row = cross_validate(
            build(**option), folds, label, key, k, [metric], seed=seed, parallelism=1, folded=True
        ).first()
        return json.dumps(dict(option), sort_keys=True), float(row["mean"]), float(row["std"] or 0)

    with ThreadPool(parallelism) as pool:
        rows = pool.map(one, options)
    return ranked(df, rows)


def grid_search(build, space: Mapping[str, Sequence], *args, **options) -> DataFrame:
    """Search over every combination."""
    return search(build, parameter_grid(space), *args, **options)


def random_search(
    build, space: Mapping[str, Sequence], *args, n_iter: int = 10, seed: int = 42, **options
) -> DataFrame:
    """Search over ``n_iter`` distinct combinations drawn with a seed."""
    return search(build, drawn_options(space, n_iter, seed), *args, seed=seed, **options)


def drawn_options(space: Mapping[str, Sequence], n_iter: int, seed: int) -> list[dict]:
    """``n_iter`` distinct combinations of the listed values, drawn with a seed."""
    size = 1
    for values in space.values():
        size *= len(values)

    def combination(index: int) -> dict:
        out = {}
        for name, values in space.items():
            index, at = divmod(index, len(values))
            out[name] = values[at]
        return out

    return [combination(i) for i in random.Random(seed).sample(range(size), min(n_iter, size))]


@dataclass(frozen=True)
class Step:
    """One part of a searched pipeline.

    ``build`` takes the parameters named in ``uses``. By ``kind`` it gives an
    estimator that prepares all rows (``prepare``), a function over the training
    rows alone (``train``), or a classifier with output columns of its own (``member``).
    """

    name: str
    kind: str
    uses: tuple[str, ...]
    build: Callable


class PartSearch:
    """Search over the parts of a pipeline in which options share what they have in common.

    The options form a tree: those with the same parameters in the first steps
    share their fits and the rows these write, once per fold. Members are
    fitted once per fold, rows and parameters of their own. ``fits`` counts the
    builds by step.
    """

    def __init__(self, steps: Sequence[Step], combine: Callable[..., Transformer], parallelism: int = 2):
        self.steps, self.combine, self.parallelism = list(steps), combine, parallelism
        self.fits: Counter = Counter()

    def _fold(self, train: DataFrame, test: DataFrame, options: Sequence[Mapping]) -> list[DataFrame]:
        rows: dict[tuple, tuple] = {(): (train, test)}
        models: dict[tuple, Transformer] = {}
        out = []
        for option in options:
            path, members = (), []
            for step in self.steps:
                used = {name: option[name] for name in step.uses}
                node = (*path, (step.name, *used.values()))
                here, there = rows[path]
                if step.kind == "member":
                    if node not in models:
                        models[node] = step.build(**used).fit(here)
                        self.fits[step.name] += 1
                    members.append(models[node])
                    continue
                if node not in rows:
                    self.fits[step.name] += 1
                    made = step.build(**used)
                    if step.kind == "train":
                        rows[node] = durable(made(here)), there
                    else:
                        model = made.fit(here)
                        rows[node] = durable(model.transform(here)), durable(model.transform(there))
                path = node
            scored = rows[path][1]
            for model in [*members, self.combine(**option)]:
                scored = model.transform(scored)
            out.append(scored)
        return out

    def run(
        self, options: Sequence[Mapping], df: DataFrame, label: str, key: str, k: int = 5, metric: str = "accuracy", seed: int = 42
    ) -> DataFrame:
        """``(rank, parameters, mean, std)`` of each option, best first."""
        folds = with_folds(df, label, key, k, seed)

        def one(i: int) -> list[DataFrame]:
            split = [folds.filter(side).drop("fold") for side in (F.col("fold") != i, F.col("fold") == i)]
            return [p.select(F.lit(i).alias("fold"), label, "prediction") for p in self._fold(*split, options)]

        with ThreadPool(min(self.parallelism, k)) as pool:
            parts = pool.map(one, range(k))

        def score(n: int) -> tuple:
            predictions = parts[0][n]
            for part in parts[1:]:
                predictions = predictions.unionAll(part[n])
            scores = overall_scores(predictions, label, "prediction", ["fold"])
            row = scores.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")).first()
            return json.dumps(dict(options[n]), sort_keys=True), float(row["mean"]), float(row["std"] or 0)

        with ThreadPool(self.parallelism) as pool:
            return ranked(df, pool.map(score, range(len(options))))


def ranked(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """``(rank, parameters, mean, std)``, best first."""
    table = df.sparkSession.createDataFrame(rows, "parameters string, mean double, std double")
    order = W.orderBy(F.col("mean").desc(), "parameters")  # one row per option
    return table.select(F.row_number().over(order).alias("rank"), "parameters", "mean", "std")


def best_models(results: DataFrame, n: int = 5) -> DataFrame:
    """The top ``n`` rows of a search."""
    return results.filter(F.col("rank") <= n)
