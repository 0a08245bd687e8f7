"""Pipeline stages: fitted selectors, column preparation, resampling and voting."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import categorical_names, is_missing, number, numeric_names
from quadrat.operators import balancing, features
from quadrat.operators.calibration import PARALLEL, CalibratedClassifier
from quadrat.operators.durable import durable
from quadrat.operators.learners import base_learners
from quadrat.operators.multivariate import Components, pca_fit, pca_scores
from quadrat.operators.persist import Nested, import_path, imported
from quadrat.operators.quantiles import quantile_table
from quadrat.operators.tuning import Step


#: Marks rows with too many gaps: every later stage leaves them out of its fit and keeps them in its result.
GAP_ROW = "_gap_row"


def training_rows(dataset: DataFrame) -> DataFrame:
    """The rows that a stage may learn from."""
    if GAP_ROW not in dataset.columns:
        return dataset
    return dataset.filter(~F.col(GAP_ROW)).drop(GAP_ROW)


def _text(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toString)


class DroppedColumns(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the columns a selector chose; ``report`` says why."""

    step = _text("step", "name of the selection rule")
    report = _text("report", "JSON list of (feature, partner, value)")

    def dropped(self) -> list[tuple]:
        """``(feature, partner, value)`` of every dropped column."""
        return [tuple(row) for row in json.loads(self.getOrDefault(self.report))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*[name for name, _, _ in self.dropped()])


class Selector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Base of the column selectors; ``protected`` columns are never dropped."""

    step = _text("step", "name of the selection rule")
    protected = Param(
        Params._dummy(), "protected", "columns to leave alone", TypeConverters.toListString
    )
    threshold = Param(
        Params._dummy(), "threshold", "limit of the rule", TypeConverters.toFloat
    )
    keep = Param(Params._dummy(), "keep", "columns to keep", TypeConverters.toListString)

    # fixed values: default limits of the rules
    RULES = {
        "sparse": 0.7, "keep": 0.0, "constant": 0.95, "duplicate": 0.0, "correlated": 0.8,
        "low_variance": 0.0,
    }

    @keyword_only
    def __init__(self, *, step="sparse", protected=(), threshold=None, keep=()):
        super().__init__()
        self._set(
            step=step, protected=list(protected), keep=list(keep),
            threshold=self.RULES[step] if threshold is None else threshold,
        )

    def _fit(self, dataset: DataFrame) -> DroppedColumns:
        dataset = training_rows(dataset)
        step, limit = self.getOrDefault(self.step), self.getOrDefault(self.threshold)
        protected = set(self.getOrDefault(self.protected))
        columns = [c for c in dataset.columns if c not in protected]
        numeric = [c for c in numeric_names(dataset) if c not in protected]
        if step == "sparse":
            dropped = features.sparse_features(dataset, columns, limit)
        elif step == "keep":
            kept = set(self.getOrDefault(self.keep))
            dropped = [(c, None, None) for c in columns if c not in kept]
        elif step == "constant":
            dropped = features.constant_features(dataset, columns, limit)
        elif step == "duplicate":
            dropped = features.duplicate_features(dataset, columns)
        elif step == "correlated":
            dropped = features.correlated_features(dataset, numeric, limit)
        else:
            dropped = features.low_variance_features(dataset, numeric, limit)
        return DroppedColumns()._set(step=step, report=json.dumps(dropped))


class SparseRows(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Marks rows with too few of the listed columns filled, for the fits of later stages; drops none."""

    columns = Param(Params._dummy(), "columns", "columns counted", TypeConverters.toListString)
    minimum = Param(Params._dummy(), "minimum", "filled columns needed", TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = [c for c in self.getOrDefault(self.columns) if c in dataset.columns]
        if not columns:
            return dataset
        filled = [F.when(is_missing(dataset, c), 0).otherwise(1) for c in columns]
        return dataset.withColumn(GAP_ROW, sum(filled, F.lit(0)) < self.getOrDefault(self.minimum))


class SparseRowFilter(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns later stages only from rows with at least ``share`` of their gap-prone columns filled."""

    share = Param(Params._dummy(), "share", "share of columns", TypeConverters.toFloat)
    protected = Param(
        Params._dummy(), "protected", "columns not counted", TypeConverters.toListString
    )

    @keyword_only
    def __init__(self, *, share=0.03, protected=()):
        super().__init__()
        self._set(share=share, protected=list(protected))

    def _fit(self, dataset: DataFrame) -> SparseRows:
        protected = set(self.getOrDefault(self.protected))
        columns = [c for c in dataset.columns if c not in protected]
        gappy = features.columns_missing_any(dataset, columns)
        need = -int(-self.getOrDefault(self.share) * len(gappy) // 1)
        return SparseRows()._set(columns=gappy, minimum=need)


def feature_cleaning(
    keep: Sequence[str],
    protected: Sequence[str] = (),
    nan_threshold: float = 0.7,
    correlation_threshold: float = 0.8,
    variance_threshold: float | None = None,
) -> list:
    """Cleaning stages in order: sparse columns, sparse rows, kept columns, constant,
    duplicate and correlated ones, and optionally low variance."""
    stages = [
        Selector(step="sparse", protected=protected, threshold=nan_threshold),
        SparseRowFilter(protected=protected),
        Selector(step="keep", protected=protected, keep=keep),
        Selector(step="constant", protected=protected),
        Selector(step="duplicate", protected=protected),
        Selector(step="correlated", protected=protected, threshold=correlation_threshold),
    ]
    if variance_threshold is not None:
        stages.append(
            Selector(step="low_variance", protected=protected, threshold=variance_threshold)
        )
    return stages


def dropped_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``(step, feature, partner, value)`` of everything a fitted pipeline dropped."""
    rows = [
        (stage.getOrDefault(stage.step), *row)
        for stage in model.stages
        if isinstance(stage, DroppedColumns)
        for row in stage.dropped()
    ]
    return df.sparkSession.createDataFrame(
        rows, "step string, feature string, partner string, value double"
    )


class PreparedColumns(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Applies fitted imputing, scaling and encoding; writes ``features``."""

    fitted = _text("fitted", "JSON: numeric and category parameters")
    keep = Param(Params._dummy(), "keep", "other columns kept", TypeConverters.toListString)

    def _plan(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))

    @property
    def names(self) -> list[str]:
        """Names of the vector's elements."""
        plan = self._plan()
        names = list(plan["numeric"])
        for c, fit in plan["category"].items():
            names += [c] if fit["ordinal"] else [f"{c}_{v}" for v in fit["values"]]
        return names

    def table(self, dataset: DataFrame) -> DataFrame:
        """The prepared columns by name, next to the kept ones."""
        plan = self._plan()
        out: list[Column] = []
        for c, fit in plan["numeric"].items():
            x = F.coalesce(number(c), F.lit(fit["fill"]))
            if fit["power"] is not None:
                x = features.yeo_johnson(x, fit["power"])
            out.append(((x - F.lit(fit["centre"])) / F.lit(fit["scale"])).alias(c))
        for c, fit in plan["category"].items():
            text = F.coalesce(F.col(c).cast("string"), F.lit(fit["fill"]))
            if fit["ordinal"]:
                code = F.array_position(F.lit(fit["values"]), text).cast("double") - 1.0
                out.append(code.alias(c))
            else:
                out += [
                    F.when(text == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}")
                    for v in fit["values"]
                ]
        return dataset.select(*self._kept(dataset), *out)

    def _kept(self, dataset: DataFrame) -> list[str]:
        return [c for c in [*self.getOrDefault(self.keep), GAP_ROW] if c in dataset.columns]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = self._kept(dataset)
        renamed = [f"__x{i}" for i in range(len(self.names))]
        table = self.table(dataset).toDF(*kept, *renamed)
        vectors = VectorAssembler(inputCols=renamed, outputCol="features").transform(table)
        return vectors.select(*kept, "features")


class ColumnPreparer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric branch (median, scaler) and category branch (mode, encoder) in one.

    Numeric columns may also get a Yeo-Johnson power. Columns that are neither,
    and are not in ``keep``, are dropped.
    """

    scaler = _text("scaler", "standard, minmax, robust or power")
    encoder = _text("encoder", "onehot or ordinal")
    keep = Param(Params._dummy(), "keep", "other columns kept", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, scaler="standard", encoder="onehot", keep=()):
        super().__init__()
        self._set(scaler=scaler, encoder=encoder, keep=list(keep))

    def _fit(self, dataset: DataFrame) -> PreparedColumns:
        dataset = training_rows(dataset)
        kept = set(self.getOrDefault(self.keep))
        numeric = [c for c in numeric_names(dataset) if c not in kept]
        category = [c for c in categorical_names(dataset) if c not in kept]
        plan: dict[str, dict] = {"numeric": {}, "category": {}}
        if numeric:
            medians = {
                r["feature"]: r["q0"] for r in quantile_table(dataset, numeric, [0.5]).collect()
            }
            filled = dataset.select(
                *[F.coalesce(number(c), F.lit(medians.get(c, 0.0))).alias(c) for c in numeric]
            )
            kind, powers = self.getOrDefault(self.scaler), {}
            if kind == "power":
                powers = features.fit_powers(filled, numeric)
                filled = filled.select(
                    *[features.yeo_johnson(F.col(c), powers[c]).alias(c) for c in numeric]
                )
                kind = "standard"
            fit = filled.agg(
                F.first(features.centre_and_scale(filled, numeric, kind))
            ).first()[0]
            for c in numeric:
                plan["numeric"][c] = {
                    "fill": medians.get(c, 0.0), "power": powers.get(c),
                    "centre": fit[c]["centre"], "scale": fit[c]["scale"],
                }
        if category:
            counts = features.feature_value_counts(dataset, category)
            top = {r["feature"]: r["top"] for r in features.most_frequent(counts).collect()}
            for c in category:
                plan["category"][c] = {
                    "fill": top.get(c, ""), "values": features.categories_of(dataset, c),
                    "ordinal": self.getOrDefault(self.encoder) == "ordinal",
                }
        return PreparedColumns()._set(fitted=json.dumps(plan), keep=sorted(kept))


def transformed_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The table the classifier sees, by column name; nothing is refitted."""
    for stage in model.stages:
        if isinstance(stage, PreparedColumns):
            return stage.table(df).drop(GAP_ROW)
        df = stage.transform(df)
    raise ValueError("the pipeline has no column preparation")


def resampled(rows: DataFrame, label: str, key: str, method: str | None, seed: int = 42) -> DataFrame:
    """``key, label, features`` balanced by ``method``: under, over, one of the SMOTE kinds, or none."""
    rows = rows.select(key, label, "features")
    if not method:
        return rows
    if method in ("over", "under"):
        return getattr(balancing, f"resample_{method}")(rows, label, [key], seed)
    size = len(rows.first()["features"])
    names = [f"__s{i}" for i in range(size)]
    elements = vector_to_array("features")
    wide = rows.select(key, label, *[elements[i].alias(n) for i, n in enumerate(names)])
    both = balancing.smote(wide, label, key, names, seed=seed, kind=method)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(both)
    # boosted and forest learners scan the rows many times: write them once
    return durable(ready.select(key, label, "features"))


class ResampledClassifier(Estimator, Nested):
    """Fits a classifier on resampled rows; prediction never resamples.

    ``method`` is under, over or one of the SMOTE kinds.
    """

    CHILDREN, PLAIN = ("classifier",), ("method", "key", "seed")

    def __init__(self, classifier: Estimator, method: str | None, key: str, seed: int = 42):
        super().__init__()
        self.classifier, self.method, self.key, self.seed = classifier, method, key, seed

    def getLabelCol(self) -> str:
        """Label column of the classifier."""
        return self.classifier.getLabelCol()

    def _fit(self, dataset: DataFrame) -> Model:
        rows = training_rows(dataset)
        if self.method:
            rows = resampled(rows, self.getLabelCol(), self.key, self.method, self.seed)
        return self.classifier.fit(rows)


class TrainingOnly(Estimator, Nested):
    """Fits a stage without the rows marked for their gaps."""

    CHILDREN = ("stage",)

    def __init__(self, stage: Estimator):
        super().__init__()
        self.stage = stage

    def _fit(self, dataset: DataFrame) -> Model:
        return self.stage.fit(training_rows(dataset))


class WrittenOnce(Pipeline):
    """A pipeline whose fits go over a copy of the rows that is written once, however the rows are made."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return super()._fit(durable(dataset))


class VoteCombiner(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Combines ``prediction_i`` (hard) or class probabilities (soft) of several models."""

    members = Param(Params._dummy(), "members", "number of models", TypeConverters.toInt)
    voting = _text("voting", "hard or soft")

    @keyword_only
    def __init__(self, *, members=1, voting="hard"):
        super().__init__()
        self._set(members=members, voting=voting)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        count = self.getOrDefault(self.members)
        used = [
            c for i in range(count)
            for c in (f"prediction_{i}", f"rawPrediction_{i}", f"probability_{i}")
            if c in dataset.columns
        ]
        if self.getOrDefault(self.voting) == "hard":
            votes = F.array_sort(F.array(*[F.col(f"prediction_{i}") for i in range(count)]))
            tally = F.transform(
                F.array_distinct(votes),
                lambda v: F.struct(
                    (-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("v")
                ),
            )
            winner = F.array_min(tally)["v"]  # most votes, then the smallest label
            return dataset.withColumn("prediction", winner).drop(*used)
        bare = [i for i in range(count) if f"probability_{i}" not in dataset.columns]
        if bare:
            raise ValueError(f"members {bare} give no probabilities; calibrate them")
        shares = [vector_to_array(f"probability_{i}") for i in range(count)]
        total = shares[0]
        for other in shares[1:]:
            total = F.zip_with(total, other, lambda a, b: a + b)
        mean = F.transform(total, lambda x: x / float(count))
        out = dataset.withColumn("__mean", mean)
        place = F.array_position("__mean", F.array_max("__mean")).cast("double") - 1.0
        return (
            out.withColumn("prediction", place)
            .withColumn("probability", array_to_vector("__mean"))
            .drop("__mean", *used)
        )


def numbered(member: Estimator, i: int) -> Estimator:
    """A copy of a classifier whose output columns end in ``_i``."""
    if isinstance(member, CalibratedClassifier):
        inner = numbered(member.classifier, i)
        return CalibratedClassifier(inner, member.key, member.method, member.k, member.seed, f"probability_{i}")
    named = member.copy()
    for kind in ("prediction", "rawPrediction", "probability"):
        column = {f"{kind}Col": f"{kind}_{i}"}
        if named.hasParam(f"{kind}Col"):
            named._set(**column)
            if kind == "rawPrediction" and isinstance(named, OneVsRest):
                # the one-against-rest model reads its members' raw column
                named.setClassifier(named.getClassifier().copy()._set(**column))
    return named


def with_probabilities(member: Estimator, key: str | None, method: str = "logistic") -> Estimator:
    """The classifier itself if it gives probabilities, else its calibrated form.

    Boosted trees get theirs from the link of their loss, other margins by ``method``.
    """
    if isinstance(member, CalibratedClassifier) or member.hasParam("probabilityCol"):
        return member
    if isinstance(member, OneVsRest) and isinstance(member.getClassifier(), GBTClassifier):
        return CalibratedClassifier(member, key or "", "link")
    if key is None:
        raise ValueError("the folds of a calibration need a key column")
    return CalibratedClassifier(member, key, method)


class VotingClassifier(Estimator, Nested):
    """Fits several classifiers on the same rows and lets them vote.

    The fitted model is a ``PipelineModel``: the members, then the combiner. A
    soft vote averages class probabilities; members that only give margins are
    calibrated by ``method`` on folds over ``key``.
    """

    CHILDREN, PLAIN = ("members",), ("voting", "key", "method")

    def __init__(self, members: Sequence[Estimator], voting: str = "hard", key: str | None = None, method: str = "logistic"):
        super().__init__()
        self.members, self.voting, self.key, self.method = list(members), voting, key, method

    def getLabelCol(self) -> str:
        """Label column of the members."""
        return self.members[0].getLabelCol()

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        members = self.members
        if self.voting == "soft":
            members = [with_probabilities(m, self.key, self.method) for m in members]
        dataset = durable(dataset)  # each member goes over the rows many times
        with ThreadPool(min(len(members), PARALLEL)) as pool:
            fitted = pool.map(lambda at: numbered(at[1], at[0]).fit(dataset), list(enumerate(members)))
        return PipelineModel([*fitted, VoteCombiner(members=len(fitted), voting=self.voting)])


#: Members of the usual vote.
VOTERS = ("random_forest", "gradient_boosting", "naive_bayes", "linear_discriminant", "decision_tree", "linear_svm")


def voting_ensemble(label: str, key: str, voting: str = "hard", names: Sequence[str] = VOTERS, seed: int = 42) -> VotingClassifier:
    """The six usual classifiers in one vote."""
    every = base_learners(label, seed)
    return VotingClassifier([every[n] for n in names], voting, key)


class TableFunction(Transformer, Nested):
    """Wraps any ``DataFrame -> DataFrame`` function as a pipeline stage.

    ``settings`` are passed by name. Saved are the function's import path and
    the settings (JSON values), so only functions of a module can be saved.
    """

    PLAIN = ("path", "settings")

    def __init__(self, function: Callable[..., DataFrame] | None = None, settings: dict | None = None, path: str | None = None):
        super().__init__()
        self.function, self.settings = function or imported(path), settings or {}

    @property
    def path(self) -> str:
        """``module:name`` of the function."""
        return import_path(self.function)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset, **self.settings)


def renamed_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """The table with column ``old`` in the place of ``new``."""
    return df.drop(new).withColumnRenamed(old, new)


class ComponentScores(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``pc1 …`` of fitted principal components."""

    fitted = _text("fitted", "JSON: columns, centre, scale, vectors, eigenvalues")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        plan = json.loads(self.getOrDefault(self.fitted))
        model = Components(
            tuple(plan["columns"]), np.array(plan["centre"]), np.array(plan["scale"]),
            np.array(plan["eigenvalues"]), np.array(plan["vectors"]), plan["total"],
        )
        return pca_scores(dataset, model)


class PrincipalComponents(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Principal components as a pipeline stage."""

    columns = Param(Params._dummy(), "columns", "input columns", TypeConverters.toListString)
    components = Param(
        Params._dummy(), "components", "count, or share of variance", TypeConverters.toFloat
    )

    @keyword_only
    def __init__(self, *, columns=(), components=0.95):
        super().__init__()
        self._set(columns=list(columns), components=components)

    def _fit(self, dataset: DataFrame) -> ComponentScores:
        wanted = self.getOrDefault(self.components)
        fit = pca_fit(
            dataset, self.getOrDefault(self.columns), wanted if wanted < 1 else int(wanted)
        )
        plan = {
            "columns": list(fit.columns), "centre": fit.centre.tolist(),
            "scale": fit.scale.tolist(), "eigenvalues": fit.eigenvalues.tolist(),
            "vectors": fit.vectors.tolist(), "total": fit.total,
        }
        return ComponentScores()._set(fitted=json.dumps(plan))


def build_pipeline(
    classifier: Estimator,
    label: str,
    key: str,
    features_to_keep: Sequence[str],
    resample: str | None = None,
    scaler: str = "standard",
    encoder: str = "onehot",
    nan_threshold: float = 0.7,
    correlation_threshold: float = 0.8,
    variance_threshold: float | None = None,
    components: int | None = None,
) -> Pipeline:
    """Cleaning, column preparation, principal components if wanted, and a (resampled) classifier in one pipeline."""
    protected = [label, key]
    limits = nan_threshold, correlation_threshold, variance_threshold
    reduced = []
    if components:
        reduced = [
            TrainingOnly(PCA(k=components, inputCol="features", outputCol="components")),
            TableFunction(renamed_column, {"old": "components", "new": "features"}),
        ]
    return WrittenOnce(
        stages=[
            *feature_cleaning(features_to_keep, protected, *limits),
            ColumnPreparer(scaler=scaler, encoder=encoder, keep=protected),
            *reduced,
            ResampledClassifier(classifier, resample, key),
        ]
    )


def vote_steps(label: str, key: str, names: Sequence[str] = VOTERS, seed: int = 42) -> tuple[list[Step], Callable[..., Transformer]]:
    """Steps and combiner of a search over ``scaler, resampler, voting`` and forest and boosting settings.

    Forest settings are ``trees, depth, leaf``, boosting ones ``rate,
    boosted_depth``; those of members that are not in ``names`` are not used.
    """

    def member(i: int, name: str) -> Step:
        uses = {"random_forest": ("trees", "depth", "leaf"), "gradient_boosting": ("rate", "boosted_depth")}.get(name, ())

        def build(voting: str, **used) -> Estimator:
            one = base_learners(label, seed)[name]
            if name == "random_forest":
                one = one.copy({one.numTrees: used["trees"], one.maxDepth: used["depth"], one.minInstancesPerNode: used["leaf"]})
            elif name == "gradient_boosting":
                inner = one.getClassifier()
                one = one.setClassifier(inner.copy({inner.stepSize: used["rate"], inner.maxDepth: used["boosted_depth"]}))
            return numbered(with_probabilities(one, key) if voting == "soft" else one, i)

        # members with probabilities of their own serve both kinds of vote
        margins = not base_learners(label, seed)[name].hasParam("probabilityCol")
        if margins:
            return Step(name, "member", (*uses, "voting"), build)
        return Step(name, "member", uses, lambda **used: build("hard", **used))

    steps = [
        Step("prepare", "prepare", ("scaler",), lambda scaler: ColumnPreparer(scaler=scaler, keep=[label, key])),
        Step("resample", "train", ("resampler",), lambda resampler: lambda rows: resampled(rows, label, key, resampler, seed)),
        *[member(i, name) for i, name in enumerate(names)],
    ]
    return steps, lambda voting, **_: VoteCombiner(members=len(names), voting=voting)
