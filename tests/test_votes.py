"""Calibration, six-member votes, saved pipelines and the search over pipeline parts."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quadrat.operators import calibration, evaluation, learners, stages, tuning


@pytest.fixture(scope="module")
def three(spark):
    """Three overlapping groups of 60, 40 and 30 rows."""
    rng = np.random.default_rng(5)
    sizes, centres = (60, 40, 30), ((0, 0), (2.5, 0), (0, 2.5))
    x = np.vstack([rng.normal(c, 0.9, (n, 2)) for n, c in zip(sizes, centres)])
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["key"], pdf["label"] = range(len(x)), np.repeat([0.0, 1.0, 2.0], sizes)
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def ready(three):
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(three)


def min_max(points):
    """Isotonic values by the min-max formula."""
    xs = sorted({x for x, _ in points})
    w = [sum(1 for x, _ in points if x == v) for v in xs]
    s = [sum(y for x, y in points if x == v) for v in xs]
    mean = lambda a, b: sum(s[a : b + 1]) / sum(w[a : b + 1])
    n = range(len(xs))
    return {xs[i]: max(min(mean(a, b) for b in n if b >= i) for a in n if a <= i) for i in n}


@pytest.mark.parametrize("slots", [1, 18])
def test_isotonic_equals_brute_force(spark, slots):
    rng = np.random.default_rng(slots)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slots)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = []
        for group, share in (("up", 1.0), ("down", -1.0), ("flat", 0.0)):
            x = np.round(rng.normal(size=90), 1)
            rows += [(group, float(v), float(rng.random() < 1 / (1 + math.exp(-3 * share * v)))) for v in x]
        rows += [("up", None, 1.0), ("up", float("nan"), 1.0), ("up", 1.0, None), ("one", 3.0, 1.0)]
        df = spark.createDataFrame(rows, "g string, x double, y double")
        got = calibration.isotonic_blocks(df, "x", "y", ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for group in ("up", "down", "flat", "one"):
        points = [(x, y) for g, x, y in rows if g == group and x is not None and x == x and y is not None]
        blocks = [r for r in got if r["g"] == group]
        assert sum(r["weight"] for r in blocks) == len(points)
        for x, value in min_max(points).items():
            assert [r["value"] for r in blocks if r["low"] <= x <= r["high"]] == pytest.approx([value])


def test_isotonic_of_nothing(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert calibration.isotonic_blocks(empty, "x", "y").count() == 0


def test_logistic_fit(spark):
    """Against a dense Newton fit on the same drawn-in targets."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=200)
    hit = rng.random(200) < 1 / (1 + np.exp(-(2 * m - 0.5)))
    slope, offset = calibration.logistic_fit(spark.createDataFrame(pd.DataFrame({"margin": m, "hit": hit})))
    t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
    x, b = np.stack([m, np.ones(200)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (t - p))
    assert (slope, offset) == pytest.approx(tuple(b), abs=1e-4)


def quick_svm():
    svm = learners.base_learners()["linear_svm"]
    return svm.copy().setClassifier(svm.getClassifier().copy().setMaxIter(8))


@pytest.mark.parametrize("method", ["logistic", "isotonic"])
def test_calibrated_margins(ready, method):
    model = calibration.CalibratedClassifier(quick_svm(), "key", method, k=2).fit(ready)
    out = model.transform(ready).withColumn("p", vector_to_array("probability"))
    assert out.where(F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).count() == 0
    assert evaluation.overall_scores(out, "label", "prediction").first()["accuracy"] > 0.8
    # a calibrated share is near the share of hits
    sure = out.where(F.array_max("p") > 0.8)
    assert sure.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.8


def quick_vote(voting):
    vote = stages.voting_ensemble("label", "key", voting)
    for i, one in enumerate(vote.members):  # fewer rounds: the test is about the vote
        if stages.VOTERS[i] == "random_forest":
            vote.members[i] = one.copy({one.numTrees: 10})
        elif stages.VOTERS[i] == "gradient_boosting":
            inner = one.getClassifier()
            vote.members[i] = one.copy().setClassifier(inner.copy({inner.maxIter: 3}))
        elif stages.VOTERS[i] == "linear_svm":
            vote.members[i] = calibration.CalibratedClassifier(quick_svm(), "key", k=2) if voting == "soft" else quick_svm()
    return vote


@pytest.mark.parametrize("voting", ["hard", "soft"])
def test_six_members_and_three_classes(ready, voting, tmp_path):
    vote = quick_vote(voting)
    assert len(vote.members) == 6
    vote.write().save(str(tmp_path / "vote"))
    again = stages.VotingClassifier.load(str(tmp_path / "vote"))
    assert (again.voting, again.key, len(again.members)) == (voting, "key", 6)
    model = again.fit(ready)
    out = model.transform(ready)
    assert len(model.stages) == 7 and out.count() == ready.count()
    assert evaluation.overall_scores(out, "label", "prediction").first()["accuracy"] > 0.8
    assert not [c for c in out.columns if c.endswith(("_0", "_5"))]
    if voting == "soft":
        p = np.stack([r[0].toArray() for r in out.select("probability").collect()])
        assert p.shape == (130, 3) and p.sum(1) == pytest.approx(1) and (p >= 0).all()


def test_soft_vote_needs_probabilities(ready):
    svm = learners.base_learners()["linear_svm"]
    with pytest.raises(ValueError):
        stages.VotingClassifier([svm], "soft").fit(ready)


def lowered(df, column):
    return df.withColumn(column, F.lower(column))


def test_unfitted_pipelines_are_saved_and_tuned(three, tmp_path):
    rows = three.withColumn("colour", F.when(F.col("a") > 1, "Red").otherwise("Blue"))
    tree = learners.base_learners()["decision_tree"]
    pipeline = Pipeline(stages=[
        stages.TableFunction(lowered, {"column": "colour"}),
        *stages.build_pipeline(tree, "label", "key", ["a", "b", "colour"], resample="over", components=2).getStages(),
    ])
    pipeline.write().save(str(tmp_path / "pipeline"))
    again = Pipeline.load(str(tmp_path / "pipeline"))
    assert again.getStages()[0].function is lowered and again.getStages()[-1].method == "over"
    first, second = (p.fit(rows).transform(rows).select("key", "prediction") for p in (pipeline, again))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))

    def with_depth(depth):
        last = again.getStages()[-1]
        deeper = tree.copy({tree.maxDepth: depth})
        return Pipeline(stages=[*again.getStages()[:-1], stages.ResampledClassifier(deeper, last.method, last.key)])

    found = tuning.grid_search(with_depth, {"depth": [0, 3]}, rows, "label", "key", k=2).orderBy("rank").first()
    assert json.loads(found["parameters"]) == {"depth": 3}


def test_fitted_pipelines_are_saved(ready, tmp_path):
    fitted = Pipeline(stages=[calibration.CalibratedClassifier(quick_svm(), "key", "isotonic", k=2)]).fit(ready)
    fitted.write().save(str(tmp_path / "model"))
    again = type(fitted).load(str(tmp_path / "model"))
    assert again.transform(ready).select("probability").collect() == fitted.transform(ready).select("probability").collect()


def test_functions_without_a_module_are_not_saved(tmp_path):
    with pytest.raises(ValueError):
        stages.TableFunction(lambda df: df).write().save(str(tmp_path / "f"))


def test_rows_with_gaps_are_kept_and_not_learned_from(spark):
    rows = [(i, float(i % 2), float(i % 2) + 0.01 * i, None if i % 5 else 1.0) for i in range(40)] + [(99, 1.0, None, None)]
    df = spark.createDataFrame(rows, "key long, label double, a double, b double")
    build = stages.build_pipeline(learners.base_learners()["naive_bayes"], "label", "key", ["a"], nan_threshold=0.99)
    model = build.fit(df)
    out = model.transform(df)
    assert out.count() == 41
    plan = next(s for s in model.stages if isinstance(s, stages.PreparedColumns))._plan()
    known = [r[2] for r in rows if r[2] is not None]
    assert plan["numeric"]["a"]["centre"] == pytest.approx(float(np.mean(known)))


def test_search_over_parts_equals_single_fits(three):
    """Same ranks as fitting every option alone, with shared parts fitted once per fold."""
    names = ("random_forest", "naive_bayes")
    steps, combine = stages.vote_steps("label", "key", names)
    space = {"scaler": ["standard", "minmax"], "resampler": [None, "over"], "voting": ["hard", "soft"], "trees": [3], "depth": [1, 3], "leaf": [2]}
    options = tuning.drawn_options(space, 4, 7)
    search = tuning.PartSearch(steps, combine)
    got = [(r["rank"], r["parameters"], r["mean"]) for r in search.run(options, three, "label", "key", k=2).orderBy("rank").collect()]

    def alone(scaler, resampler, voting, trees, depth, leaf):
        every = learners.base_learners()
        forest = every["random_forest"]
        every["random_forest"] = forest.copy({forest.numTrees: trees, forest.maxDepth: depth, forest.minInstancesPerNode: leaf})
        vote = stages.VotingClassifier([every[n] for n in names], voting, "key")
        return Pipeline(stages=[
            stages.ColumnPreparer(scaler=scaler, keep=["label", "key"]), stages.ResampledClassifier(vote, resampler, "key"),
        ])

    single = tuning.search(alone, options, three, "label", "key", k=2).orderBy("rank").collect()
    assert [(p, m) for _, p, m in got] == [(r["parameters"], pytest.approx(r["mean"])) for r in single]
    distinct = lambda *names: len({tuple(o[n] for n in names) for o in options})
    assert search.fits == {
        "prepare": 2 * distinct("scaler"), "resample": 2 * distinct("scaler", "resampler"),
        "random_forest": 2 * distinct("scaler", "resampler", "trees", "depth", "leaf"),
        "naive_bayes": 2 * distinct("scaler", "resampler"),
    }


def test_members_fit_on_rows_read_once(three):
    from tests.test_models import counted_reads

    rows, total = counted_reads(three, "a")
    count = three.count()
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    every = learners.base_learners()
    stages.VotingClassifier([every[n] for n in ("naive_bayes", "linear_discriminant", "decision_tree")], "soft", "key").fit(ready)
    assert total.value == count
