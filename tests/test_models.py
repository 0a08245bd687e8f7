"""Evaluation, balancing, learners, pipelines and search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quadrat.operators import balancing, evaluation, learners, neighbours, stages, tuning
from quadrat.sources import files

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def blobs(spark):
    """Two well separated groups, 60 and 20 rows."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 0.6, (60, 2)), rng.normal(4, 0.6, (20, 2))])
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["key"] = range(80)
    pdf["label"] = [0.0] * 60 + [1.0] * 20
    pdf["colour"] = np.where(np.arange(80) % 3 == 0, "red", "blue")
    pdf.loc[3, "a"] = np.nan
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def ready(blobs):
    rows = blobs.filter("key <> 3")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def test_report_hand_worked(spark):
    rows = [("x", "x")] * 3 + [("x", "y")] + [("y", "y")] * 2 + [("z", "x")]
    df = spark.createDataFrame(rows, "t string, p string")
    scores = {r["label"]: r for r in evaluation.classification_report(df, "t", "p").collect()}
    assert scores["x"]["precision"] == pytest.approx(0.75)
    assert scores["z"]["precision"] == 0.0 and scores["z"]["support"] == 1
    assert scores["accuracy"]["f1"] == pytest.approx(5 / 7)
    assert scores["balanced accuracy"]["recall"] == pytest.approx((0.75 + 1 + 0) / 3)
    matrix = evaluation.confusion_matrix(df, "t", "p").toPandas()
    assert len(matrix) == 9 and matrix["n"].sum() == 7


def test_auc_by_brute_force(spark):
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 120)
    score = np.round(truth * 0.5 + rng.normal(size=120), 1)
    df = spark.createDataFrame(pd.DataFrame({"t": truth, "s": score}))
    pos, neg = score[truth == 1], score[truth == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    auc = wins / (len(pos) * len(neg))
    assert evaluation.roc_auc(df, "t", "s").first()["auc"] == pytest.approx(auc)
    curve = evaluation.roc_curve(df, "t", "s").toPandas().sort_values(["fpr", "tpr"])
    assert np.trapezoid(curve["tpr"], curve["fpr"]) == pytest.approx(auc)


def test_random_balancing(blobs):
    over = balancing.resample_over(blobs, "label", ["key"]).groupBy("label").count().collect()
    assert {r["count"] for r in over} == {60}
    under = balancing.resample_under(blobs, "label", ["key"])
    assert {r["count"] for r in under.groupBy("label").count().collect()} == {20}
    assert under.select("key").distinct().count() == 40


@pytest.mark.parametrize("kind", ["regular", "borderline", "kmeans", "svm"])
def test_synthetic_rows_lie_between_class_rows(blobs, kind):
    out = balancing.smote(blobs.dropna(), "label", "key", FEATURES, k=3, kind=kind, clusters=2).toPandas()
    assert set(out.groupby("label").size()) == {60} or out.groupby("label").size()[1.0] == 59
    own = out[(out.label == 1) & ~out.synthetic][FEATURES].to_numpy()
    made = out[out.synthetic]
    assert set(made.label) == {1.0} and len(made) == 39
    for p in made[FEATURES].to_numpy():
        best = np.inf
        for i in range(len(own)):
            for j in range(len(own)):
                if i != j:
                    step = own[j] - own[i]
                    t = np.clip((p - own[i]) @ step / (step @ step), 0, 1)
                    best = min(best, np.abs(own[i] + t * step - p).max())
        assert best < 1e-9


def test_edited_neighbours_remove_a_stray(spark, blobs):
    stray = spark.createDataFrame([(4.0, 4.0, 999, 0.0)], "a double, b double, key bigint, label double")
    rows = blobs.dropna().select(*FEATURES, "key", "label").unionByName(stray)
    kept = {r["key"] for r in balancing.edited_neighbours(rows, "label", "key", FEATURES).collect()}
    assert 999 not in kept and 0 in kept


@pytest.mark.parametrize("limits", [(1000, 4096), (7, 5)])
def test_neighbours_are_exact(blobs, monkeypatch, limits):
    """One cell, and many cells of which crowded ones are sliced."""
    monkeypatch.setattr(neighbours, "PER_PIVOT", limits[0])
    monkeypatch.setattr(neighbours, "SLICE", limits[1])
    points = neighbours.as_points(blobs.dropna(), "key", FEATURES, "label")
    local = points.toPandas()
    x = np.stack(local["vector"])
    exact = {r["id"]: [n["id"] for n in r["found"]] for r in neighbours.nearest(points, points, 4).collect()}
    for i, key in enumerate(local["id"]):
        gap = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        gap[i] = np.inf
        order = sorted(range(len(x)), key=lambda j: (gap[j], local["id"][j]))[:4]
        assert exact[key] == [local["id"][j] for j in order]
    assert len(exact) == len(local)


def test_neighbours_of_nothing(blobs):
    points = neighbours.as_points(blobs.dropna(), "key", FEATURES, "label").limit(3)
    assert all(r["found"] == [] for r in neighbours.nearest(points, points.limit(0), 4).collect())
    assert all(len(r["found"]) == 2 for r in neighbours.nearest(points, points, 4).collect())


@pytest.mark.parametrize("name", ["naive_bayes", "linear_discriminant", "decision_tree", "logistic_regression"])
def test_learners_separate_the_blobs(ready, name):
    model = learners.base_learners()[name].fit(ready)
    assert learners.accuracy_of(model, ready, "label", "train").first()["accuracy"] > 0.97


def test_discriminant_matches_the_closed_form(ready):
    model = learners.LinearDiscriminant().fit(ready)
    out = model.transform(ready).toPandas()
    x, y = np.stack([v.toArray() for v in out["features"]]), out["label"].to_numpy()
    means = [x[y == c].mean(axis=0) for c in (0, 1)]
    pooled = sum((np.cov(x[y == c].T) * ((y == c).sum() - 1)) for c in (0, 1)) / (len(x) - 2)
    inv = np.linalg.inv(pooled)
    raw = np.stack([x @ inv @ m - m @ inv @ m / 2 + np.log((y == c).mean())
                    for c, m in enumerate(means)], axis=1)
    assert out["prediction"].to_numpy() == pytest.approx(raw.argmax(axis=1))
    odds = np.exp(raw - raw.max(axis=1, keepdims=True))
    got = np.stack([v.toArray() for v in out["probability"]])
    assert got == pytest.approx(odds / odds.sum(axis=1, keepdims=True), abs=1e-9)


@pytest.mark.parametrize("voting", ["hard", "soft"])
def test_votes(ready, voting):
    every = learners.base_learners()
    members = [every["naive_bayes"], every["linear_discriminant"], every["linear_svm"]]
    model = stages.VotingClassifier(members, voting, "key").fit(ready)
    out = model.transform(ready)
    assert evaluation.overall_scores(out, "label", "prediction").first()["accuracy"] > 0.97
    assert not [c for c in out.columns if c.startswith("prediction_")]


def test_hard_vote_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0)], "prediction_0 double, prediction_1 double")
    out = stages.VoteCombiner(members=2).transform(df).collect()
    assert [r["prediction"] for r in out] == [1.0, 1.0]


@pytest.fixture(scope="module")
def run(blobs):
    rows = blobs.withColumn("a_again", F.col("a")).withColumn("fixed", F.lit(3.0)).withColumn(
        "empty", F.when(F.col("key") == 1, 1.0))
    build = stages.build_pipeline(
        learners.base_learners()["naive_bayes"], "label", "key",
        ["a", "b", "colour", "a_again", "fixed"], resample="over",
    )
    return rows, build.fit(rows)


def test_whole_run(spark, run, tmp_path):
    rows, model = run
    out = model.transform(rows)
    assert out.count() == 80  # resampling happens in the fit only
    assert evaluation.overall_scores(out, "label", "prediction").first()["accuracy"] > 0.97
    dropped = {(r["step"], r["feature"]) for r in stages.dropped_features(model, rows).collect()}
    assert ("sparse", "empty") in dropped and ("constant", "fixed") in dropped
    assert ("duplicate", "a_again") in dropped
    table = stages.transformed_features(model, rows)
    assert ("correlated", "b") in dropped
    assert set(table.columns) == {"key", "label", "a", "colour_blue", "colour_red"}
    files.save_model(model, str(tmp_path / "model"))
    again = files.load_model(str(tmp_path / "model")).transform(rows)
    assert again.select("prediction").collect() == out.select("prediction").collect()
    assert files.describe_params(model, spark).count() > 10


def test_cross_validation(ready):
    estimator = learners.base_learners()["naive_bayes"]
    out = tuning.cross_val_predictions(estimator, ready, "label", "key", 4)
    assert out.count() == 79 and out.select("key").distinct().count() == 79
    scores = tuning.cross_validate(estimator, ready, "label", "key", 4).collect()
    assert {r["metric"] for r in scores} == set(tuning.METRICS)
    assert all(r["mean"] > 0.95 for r in scores)


def test_search_ranks_the_options(ready):
    def build(depth):
        base = learners.base_learners()["decision_tree"]
        return base.copy({base.maxDepth: depth, base.minInstancesPerNode: 1})

    out = tuning.grid_search(build, {"depth": [0, 2]}, ready, "label", "key", k=3).orderBy("rank").collect()
    assert [r["rank"] for r in out] == [1, 2] and out[0]["mean"] > out[1]["mean"]
    drawn = tuning.random_search(build, {"depth": [0, 1, 2]}, ready, "label", "key", k=3, n_iter=2)
    assert drawn.count() == 2


def test_tree_tables(spark, ready):
    model = learners.base_learners()["decision_tree"].fit(ready)
    rules = learners.tree_rules(model, FEATURES, ready).toPandas()
    assert rules["leaf"].sum() == (len(rules) + 1) / 2
    weights = learners.tree_importances(model, FEATURES, ready).toPandas()
    assert weights["importance"].sum() == pytest.approx(1.0)


def test_permutation(blobs):
    rows = blobs.dropna().select("key", "label", *FEATURES, F.lit(1.0).alias("idle"))
    prepare = stages.ColumnPreparer(keep=["key", "label"]).fit(rows)
    tree = learners.base_learners()["decision_tree"].fit(prepare.transform(rows))
    model = PipelineModel([prepare, tree])
    got = {r["feature"]: r["drop"] for r in learners.importance_by_permutation(
        model, rows, [*FEATURES, "idle"], "label", "key").collect()}
    assert got["idle"] == 0.0 and max(got["a"], got["b"]) > 0.2


def test_stages_wrap_functions(blobs):
    stage = stages.TableFunction(lambda df: df.filter("key < 10"))
    assert PipelineModel([stage]).transform(blobs).count() == 10
    scores = stages.PrincipalComponents(columns=FEATURES, components=1.0).fit(blobs.dropna())
    assert "pc1" in scores.transform(blobs).columns


@pytest.mark.parametrize("scaler", ["minmax", "robust", "power"])
def test_preparer_fills_and_scales(blobs, scaler):
    rows = blobs.select("key", "a", "colour")
    model = stages.ColumnPreparer(scaler=scaler, encoder="ordinal", keep=["key"]).fit(rows)
    table = model.table(rows).toPandas()
    assert table["a"].notna().all() and set(table["colour"]) == {0.0, 1.0}
    unseen = model.table(rows.withColumn("colour", F.lit("green"))).toPandas()
    assert set(unseen["colour"]) == {-1.0}


def counted_reads(df, column):
    """The table with a column that adds up the rows evaluated."""
    total = df.sparkSession.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        total.add(1)
        return v

    return df.withColumn(column, seen.asNondeterministic()(column)), total


@pytest.mark.parametrize("kind", ["kmeans", "enn"])
def test_synthetic_rows_read_their_input_once(blobs, kind):
    rows, total = counted_reads(blobs.dropna(), FEATURES[0])
    count = blobs.dropna().count()
    balancing.smote(rows, "label", "key", FEATURES, k=3, kind=kind, clusters=2).collect()
    assert total.value == count


def counted_scans(df):
    """The same rows, and the number of rows read whatever is made of them."""
    total = df.sparkSession.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            total.add(batch.num_rows)
            yield batch

    return df.mapInArrow(through, df.schema), total


def test_a_run_reads_its_input_once(blobs):
    plain = blobs.dropna()
    rows, total = counted_scans(plain)
    marked = F.col("colour").alias("colour", metadata={"role": "category"})
    rows = rows.select("key", "label", *FEATURES, marked, F.col("key").cast("string").alias("name"))
    tree = learners.base_learners()["decision_tree"]
    model = stages.build_pipeline(tree, "label", "key", [*FEATURES, "colour", "name"], resample="over").fit(rows)
    assert total.value == plain.count()
    prepared = next(s for s in model.stages if isinstance(s, stages.PreparedColumns))
    assert prepared.names == ["a", "colour_blue", "colour_red"]


def test_permutation_reads_its_input_once(blobs):
    plain = blobs.dropna().select("key", "label", *FEATURES)
    prepare = stages.ColumnPreparer(keep=["key", "label"]).fit(plain)
    tree = learners.base_learners()["decision_tree"].fit(prepare.transform(plain))
    rows, total = counted_scans(plain)
    found = learners.importance_by_permutation(PipelineModel([prepare, tree]), rows, FEATURES, "label", "key")
    assert len(found.collect()) == 2
    assert total.value == plain.count()


def test_cells_grow_in_number_not_in_size(spark, monkeypatch):
    """Points on a line: as many cells as the points need, beyond the 256 of before."""
    monkeypatch.setattr(neighbours, "PER_PIVOT", 4)
    cells = []
    whole = neighbours._in_cells

    def in_cells(points, asked, k):
        cells.append(points.select("cell").distinct().count())
        return whole(points, asked, k)

    monkeypatch.setattr(neighbours, "_in_cells", in_cells)
    line = spark.range(1600).selectExpr("CAST(id AS string) AS id", "array(CAST(id AS double), 0D) AS vector", "'a' AS label")
    found = {int(r["id"]): {int(n["id"]) for n in r["found"]} for r in neighbours.nearest(line, line, 2).collect()}
    assert all(found[i] == {i - 1, i + 1} for i in range(1, 1599))
    assert cells[0] == 400
