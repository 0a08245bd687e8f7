"""Registered queries: reports, balancing, learners, evaluation and search."""

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalogue.profiles import LINE, corr_sql
from catalogue.registry import query
from catalogue.samples import md5_of
from quadrat.operators import balancing, calibration, charts, evaluation, learners, stages, tuning
from quadrat.operators.durable import checkpoint_folder, durable
from quadrat.plans import reports

JUDGED = "(SELECT doc_id, quality AS truth, toxic AS prediction FROM labels)"
LEVELS = "(SELECT unnest([0, 1]) AS label)"
REPORT = f"""
c AS (SELECT label, count(*) FILTER (truth = label AND prediction = label) AS tp, count(*) FILTER (prediction = label) AS q,
  count(*) FILTER (truth = label) AS s FROM {JUDGED}, {LEVELS} GROUP BY label),
r AS (SELECT label, coalesce(tp / nullif(q, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r,
  coalesce(2 * tp / nullif(q + s, 0), 0) AS f, s, tp, q FROM c),
a AS (SELECT sum(tp) / sum(s) AS acc, avg(r) AS bal, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(p * s) / sum(s) AS wp,
  sum(r * s) / sum(s) AS wr, sum(f * s) / sum(s) AS wf, CAST(sum(s) AS BIGINT) AS n, stddev_pop(p) AS sp, stddev_pop(r) AS sr,
  stddev_pop(f) AS sf FROM r)"""


@query(f"""
SELECT a.label AS truth, b.label AS prediction, count(doc_id) AS n FROM {LEVELS} a CROSS JOIN {LEVELS} b
LEFT JOIN {JUDGED} ON truth = a.label AND prediction = b.label GROUP BY 1, 2""")
def confusion_matrix(t):
    return evaluation.confusion_matrix(t("labels"), "quality", "toxic")


@query(f"""
WITH {REPORT}
SELECT CAST(label AS VARCHAR) AS label, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(f, 6) + 0.0 AS f1, s AS support FROM r
UNION ALL SELECT 'accuracy', round(acc, 6) + 0.0, round(acc, 6) + 0.0, round(acc, 6) + 0.0, n FROM a
UNION ALL SELECT 'macro avg', round(mp, 6) + 0.0, round(mr, 6) + 0.0, round(mf, 6) + 0.0, n FROM a
UNION ALL SELECT 'weighted avg', round(wp, 6) + 0.0, round(wr, 6) + 0.0, round(wf, 6) + 0.0, n FROM a
UNION ALL SELECT 'balanced accuracy', round(bal, 6) + 0.0, round(bal, 6) + 0.0, round(bal, 6) + 0.0, n FROM a""")
def classification_report(t):
    return evaluation.classification_report(t("labels"), "quality", "toxic")


@query(f"""
WITH {REPORT}
SELECT 'precision' AS metric, round(mp, 6) + 0.0 AS mean, round(sp, 6) + 0.0 AS std FROM a
UNION ALL SELECT 'recall', round(mr, 6) + 0.0, round(sr, 6) + 0.0 FROM a
UNION ALL SELECT 'f1', round(mf, 6) + 0.0, round(sf, 6) + 0.0 FROM a""")
def score_spread(t):
    return evaluation.score_spread(evaluation.class_scores(t("labels"), "quality", "toxic"))


@query("SELECT doc_id, quality AS truth, toxic AS prediction FROM labels")
def predictions_vs_truth(t):
    return evaluation.predictions_vs_truth(t("labels"), "quality", "toxic", ["doc_id"])


SCORED = "(SELECT quality, n_chars FROM labels JOIN documents USING (doc_id))"
STEPS = f"""
s AS (SELECT CAST(n_chars AS DOUBLE) AS t, sum(quality) AS p, count(*) - sum(quality) AS n FROM {SCORED} GROUP BY 1),
u AS (SELECT *, sum(p) OVER w AS up, sum(n) OVER w AS un, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM s WINDOW w AS (ORDER BY t DESC))"""


@query(f"""
WITH {STEPS}
SELECT t AS threshold, round(un / tn, 6) + 0.0 AS fpr, round(up / tp, 6) + 0.0 AS tpr FROM u
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_curve(t):
    return evaluation.roc_curve(t("labels").join(t("documents"), "doc_id"), "quality", "n_chars")


@query(f"""
WITH {STEPS}
SELECT CAST(max(tp) AS BIGINT) AS positives, CAST(max(tn) AS BIGINT) AS negatives,
  round(sum(n * (up - p / 2.0)) / (max(tp) * max(tn)), 6) + 0.0 AS auc FROM u""")
def roc_auc(t):
    return evaluation.roc_auc(t("labels").join(t("documents"), "doc_id"), "quality", "n_chars")


@query(f"""
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {md5_of('event_id')}) AS i FROM events),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM events GROUP BY event_type))
SELECT event_id, event_type FROM r, m WHERE i <= m""")
def resample_under(t):
    return balancing.resample_under(t("events").select("event_id", "event_type"), "event_type", ["event_id"])


@query(f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {md5_of('doc_id')}) AS i,
  count(*) OVER (PARTITION BY quality) AS n FROM labels),
m AS (SELECT max(n) AS m FROM r)
SELECT doc_id, quality FROM (SELECT doc_id, quality, unnest(range(0, m // n + CASE WHEN i <= m % n THEN 1 ELSE 0 END)) FROM r, m)""")
def resample_over(t):
    return balancing.resample_over(t("labels").select("doc_id", "quality"), "quality", ["doc_id"])


MEASURES = ["n_chars", "words", "lines", "letters"]


def measured(t):
    """Labelled documents with a few measures of their text."""
    text = t("documents").select(
        "doc_id", "n_chars", "lang",
        F.size(F.split("text", " ")).cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
        (F.length(F.regexp_replace("text", "[^\\p{L}]", "")) / F.length("text")).alias("letters"),
    )
    return t("labels").join(text, "doc_id").withColumn("label", F.col("quality").cast("double"))


def vectors(t):
    """The measured documents with a ``features`` vector."""
    return VectorAssembler(inputCols=MEASURES, outputCol="features").transform(measured(t))


def register(name: str, run, sql=None, digits=6) -> None:
    """Register a callable under a given name."""
    run.__name__ = name
    query(sql, digits)(run)


for kind in ("regular", "borderline", "kmeans", "svm", "enn"):
    def synthetic(t, kind=kind):
        return balancing.smote(measured(t), "quality", "doc_id", MEASURES, kind=kind)

    register(f"smote_{kind}", synthetic)


@query("""
WITH r AS (SELECT quality, count(*) AS n, sum(n_chars) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT quality, (SELECT max(n) FROM r) AS rows, n AS originals, CAST(chars AS DOUBLE) AS original_chars FROM r""", digits=3)
def smote_class_sizes(t):
    """Classes are level afterwards, and every row is still there."""
    rows = balancing.smote(measured(t), "quality", "doc_id", MEASURES)
    original = ~F.col("synthetic").cast("boolean")
    return rows.groupBy("quality").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(original).alias("originals"),
        F.sum(F.when(original, F.col("n_chars"))).cast("double").alias("original_chars"),
    )


MEASURED = """
d AS (SELECT l.doc_id, CAST(quality AS DOUBLE) AS label, CAST(n_chars AS DOUBLE) AS n_chars,
  CAST(len(string_split(text, ' ')) AS DOUBLE) AS words, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS lines,
  length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) AS letters FROM labels l JOIN documents USING (doc_id))"""


def bayes_sql(train: str) -> str:
    """Gaussian naive Bayes: one row per document with the predicted label."""
    spread = f"greatest({', '.join(f'(SELECT var_pop({c}) FROM d WHERE {train})' for c in MEASURES)}) * 1e-9"
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + e AS v_{c}" for c in MEASURES)
    score = " ".join(f"- (d.{c} - m_{c}) ^ 2 / (2 * v_{c}) - 0.5 * ln(v_{c})" for c in MEASURES)
    return f"""
{MEASURED}, e AS (SELECT {spread} AS e),
k AS (SELECT label AS c, count(*) AS n, {stats} FROM d, e WHERE {train} GROUP BY label, e),
b AS (SELECT doc_id, d.label, arg_max(c, ln(n) {score}) AS prediction FROM d, k GROUP BY 1, 2)"""


BAYES = f"""
WITH {bayes_sql("true")}
SELECT doc_id, label, prediction, CASE WHEN prediction = 1 THEN 'high' ELSE 'low' END AS predicted_label FROM b"""

for learner in learners.LEARNERS:
    def fitted(t, learner=learner):
        rows = vectors(t)
        model = learners.base_learners()[learner].fit(rows)
        return learners.predict(model, rows, ["low", "high"]).select(
            "doc_id", "label", "prediction", "predicted_label"
        )

    register(f"learner_{learner}", fitted, BAYES if learner == "naive_bayes" else None)


for voting in ("hard", "soft"):
    def voted(t, voting=voting):
        rows = vectors(t)
        model = stages.voting_ensemble("label", "doc_id", voting).fit(rows)
        return model.transform(rows).select("doc_id", "label", "prediction")

    register(f"vote_{voting}", voted)


@query()
def vote_multiclass(t):
    """Ten classes of vectors, by the members that fit all classes at once."""
    parts = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(16)]
    rows = t("embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *parts)
    ready = VectorAssembler(inputCols=[f"e{i}" for i in range(16)], outputCol="features").transform(rows)
    names = ("random_forest", "naive_bayes", "linear_discriminant", "decision_tree")
    model = stages.voting_ensemble("label", "vec_id", "soft", names).fit(ready)
    return model.transform(ready).select("vec_id", "label", "prediction")


@query()
def calibrated_margins(t):
    rows = vectors(t)
    svm = learners.base_learners()["linear_svm"].getClassifier()  # two classes need no one-against-rest
    model = calibration.CalibratedClassifier(svm, "doc_id", "isotonic").fit(rows)
    share = vector_to_array("probability")[1].alias("share")
    return model.transform(rows).select("doc_id", "label", "prediction", share)


RISING = """
SELECT 'l_quantity' AS measure, l_quantity AS x, l_returnflag = 'R' AS hit FROM lineitem
UNION ALL SELECT 'l_discount', l_discount, l_shipdate >= TIMESTAMP '1995-06-17' FROM lineitem"""


@query(f"""
WITH p AS (SELECT measure, x, count(*)::DOUBLE AS w, count(*) FILTER (hit)::DOUBLE AS s FROM ({RISING}) GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM p WINDOW o AS (PARTITION BY measure ORDER BY x)),
m AS (SELECT i.measure, i.x, i.w, a.x AS a, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) AS low
  FROM c i JOIN c a ON i.measure = a.measure AND a.x <= i.x JOIN c b ON i.measure = b.measure AND b.x >= i.x GROUP BY ALL),
v AS (SELECT measure, x, w, max(low) AS value FROM m GROUP BY ALL)
SELECT measure, min(x) AS low, max(x) AS high, sum(w) AS weight, round(value, 6) + 0.0 AS value FROM v GROUP BY measure, v.value""")
def isotonic_steps(t):
    late = F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp")
    measures = (("l_quantity", F.col("l_returnflag") == "R"), ("l_discount", late))
    sides = [F.struct(F.lit(c).alias("measure"), F.col(c).alias("x"), hit.cast("double").alias("hit")) for c, hit in measures]
    rows = t("lineitem").select(F.inline(F.array(*sides)))
    return calibration.isotonic_blocks(rows, "x", "hit", ["measure"])


@query(BAYES)
def saved_pipeline(t):
    """A pipeline saved before its fit, with a function and nested stages, then loaded and fitted."""
    rows = vectors(t)
    vote = stages.VotingClassifier([learners.base_learners()["naive_bayes"]], "soft", "doc_id")
    pipeline = Pipeline(stages=[
        stages.TableFunction(stages.renamed_column, {"old": "features", "new": "measures"}),
        stages.TableFunction(stages.renamed_column, {"old": "measures", "new": "features"}),
        stages.ResampledClassifier(vote, None, "doc_id"),
    ])
    path = f"{checkpoint_folder(rows.sparkSession)}/pipeline-{uuid.uuid4().hex}"
    pipeline.write().save(path)
    model = Pipeline.load(path).fit(rows)
    return learners.predict(model, rows, ["low", "high"]).select("doc_id", "label", "prediction", "predicted_label")


def tree(t):
    """A decision tree on the measured documents."""
    return learners.base_learners()["decision_tree"].fit(vectors(t))


@query()
def tree_importances(t):
    return learners.tree_importances(tree(t), MEASURES, t("labels"))


@query()
def tree_rules(t):
    return learners.tree_rules(tree(t), MEASURES, t("labels"))


@query()
def importance_by_permutation(t):
    rows = durable(measured(t).select("doc_id", "label", *MEASURES))  # both fits and the scores go over them
    prepared = stages.ColumnPreparer(keep=["doc_id", "label"]).fit(rows)
    bayes = learners.base_learners()["naive_bayes"].fit(prepared.transform(rows))
    model = stages.PipelineModel([prepared, bayes])
    return learners.importance_by_permutation(model, rows, MEASURES, "label", "doc_id")


@query(f"""
WITH {bayes_sql("doc_id % 2 = 0")}
SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS "set", count(*) AS n,
  round(count(*) FILTER (label = prediction) / count(*), 6) + 0.0 AS accuracy FROM b GROUP BY 1""")
def accuracy_train_test(t):
    rows = vectors(t)
    model = learners.base_learners()["naive_bayes"].fit(rows.filter("doc_id % 2 = 0"))
    train = learners.accuracy_of(model, rows.filter("doc_id % 2 = 0"), "label", "train")
    return train.unionAll(learners.accuracy_of(model, rows.filter("doc_id % 2 = 1"), "label", "test"))


def whole_run(t, resample=None, scaler="standard"):
    """Cleaning, preparation and a classifier fitted on the measured documents."""
    rows = measured(t).select("doc_id", "label", "lang", *MEASURES, F.lit(1.0).alias("always"))
    build = stages.build_pipeline(
        learners.base_learners()["decision_tree"], "label", "doc_id", ["lang", "always", *MEASURES],
        resample=resample, scaler=scaler,
    )
    return rows, build.fit(rows)


@query()
def classification_run(t):
    rows, model = whole_run(t, resample="over")
    return model.transform(rows).select("doc_id", "label", "prediction")


@query()
def dropped_features(t):
    rows, model = whole_run(t)
    return stages.dropped_features(model, rows)


@query()
def transformed_features(t):
    rows, model = whole_run(t, scaler="minmax")
    return stages.transformed_features(model, rows)


#: Naive Bayes fitted without each fold in turn: ``b`` has the label predicted for every document of that fold.
LEFT_OUT = f"""
WITH {MEASURED},
r AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {md5_of("doc_id")}) - 1) % 5 AS INTEGER) AS fold FROM d),
o AS (SELECT unnest(range(5))::INTEGER AS out),
e AS (SELECT out, greatest({", ".join(f"var_pop({c})" for c in MEASURES)}) * 1e-9 AS e FROM r, o WHERE fold <> out GROUP BY out),
k AS (SELECT out, label AS c, count(*) AS n, {", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + e AS v_{c}" for c in MEASURES)}
  FROM r JOIN e ON fold <> out GROUP BY out, label, e),
b AS (SELECT doc_id, fold, label, arg_max(c, ln(n) {" ".join(f"- (r.{c} - m_{c}) ^ 2 / (2 * v_{c}) - 0.5 * ln(v_{c})" for c in MEASURES)}) AS prediction
  FROM r JOIN k ON fold = out GROUP BY 1, 2, 3)"""
FOLD_METRICS = {
    "accuracy": "sum(tp) / sum(s)",
    "balanced_accuracy": "avg(coalesce(tp / nullif(s, 0), 0))",
    "macro_precision": "avg(coalesce(tp / nullif(q, 0), 0))",
    "macro_recall": "avg(coalesce(tp / nullif(s, 0), 0))",
    "weighted_recall": "sum(tp) / sum(s)",
    "weighted_f1": "sum(s * coalesce(2 * tp / nullif(q + s, 0), 0)) / sum(s)",
}


@query(f"""
{LEFT_OUT},
c AS (SELECT fold, v, count(*) FILTER (label = v AND prediction = v) AS tp, count(*) FILTER (prediction = v) AS q,
  count(*) FILTER (label = v) AS s FROM b, (SELECT unnest([0.0, 1.0]) AS v) GROUP BY fold, v),
f AS (SELECT fold, {", ".join(f"{sql} AS {name}" for name, sql in FOLD_METRICS.items())} FROM c GROUP BY fold)
""" + " UNION ALL ".join(
    f"SELECT '{name}' AS metric, round(avg({name}), 6) + 0.0 AS mean, round(stddev_samp({name}), 6) + 0.0 AS std FROM f"
    for name in FOLD_METRICS))
def cross_validate(t):
    estimator = learners.base_learners()["naive_bayes"]
    return tuning.cross_validate(estimator, vectors(t), "label", "doc_id", 5)


@query(f"{LEFT_OUT} SELECT doc_id, fold, label, prediction FROM b")
def cross_val_predictions(t):
    estimator = learners.base_learners()["naive_bayes"]
    return tuning.cross_val_predictions(estimator, vectors(t), "label", "doc_id", 5)


def tree_with(depth, leaf):
    """A decision tree with the searched settings."""
    base = learners.base_learners()["decision_tree"]
    return base.copy({base.maxDepth: depth, base.minInstancesPerNode: leaf})


@query()
def random_search(t):
    """Ten drawn options over scaler, resampler, vote and forest, on five folds."""
    rows = measured(t).select("doc_id", "label", *MEASURES)
    steps, combine = stages.vote_steps("label", "doc_id", ("random_forest", "naive_bayes", "linear_discriminant"))
    space = {
        "scaler": ["standard", "minmax", "robust"], "resampler": [None, "over", "under"], "voting": ["soft", "hard"],
        "trees": [10, 20], "depth": [2, 3, 5], "leaf": [2, 5, 10],
    }
    options = tuning.drawn_options(space, 10, 42)
    return tuning.best_models(tuning.PartSearch(steps, combine, 5).run(options, rows, "label", "doc_id", k=5), 5)


@query()
def grid_search(t):
    space = {"depth": [2, 4], "leaf": [5, 20]}
    return tuning.best_models(
        tuning.grid_search(tree_with, space, vectors(t), "label", "doc_id", k=5), 3
    )


@query()
def decision_grid(t):
    rows = measured(t)
    pair = VectorAssembler(inputCols=["n_chars", "letters"], outputCol="features").transform(rows)
    model = learners.base_learners()["decision_tree"].fit(pair)
    return charts.decision_grid(rows, "n_chars", "letters", model)


def report_sql(column: str, kind: str, position: int, numeric: bool) -> str:
    """The report row of one column of events."""
    def number(f):
        return f"round({f}({column}), 4) + 0.0" if numeric else "CAST(NULL AS DOUBLE)"
    top = f"SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, v LIMIT 1"
    return f"""
SELECT '{column}' AS feature, {position} AS "position", '{kind}' AS type, count(*) AS rows, count(*) - count({column}) AS missing,
  count(DISTINCT {column}) AS "distinct", (SELECT n FROM ({top})) AS freq,
  {number("avg")} AS mean, {number("stddev_samp")} AS std, {number("min")} AS min, {number("max")} AS max FROM events"""


@query(" UNION ALL ".join(report_sql(*a) for a in [
    ("event_id", "bigint", 0, True), ("user_id", "bigint", 1, True), ("event_type", "string", 2, False),
    ("value", "double", 3, True)]), digits=4)
def dataset_report(t):
    rows = t("events").select("event_id", "user_id", "event_type", "value")
    return reports.dataset_report(rows).drop("top")


def ratio_sql(category: str, column: str) -> str:
    """Correlation ratio of a number between categories."""
    return f"""
SELECT '{category}' AS x, '{column}' AS y, 'correlation ratio' AS kind,
  round(sqrt(sum(n * (a - g) * (a - g)) / (max(v) * sum(n))), 6) + 0.0 AS value
FROM (SELECT count(*) AS n, avg({column}) AS a FROM lineitem GROUP BY {category}),
  (SELECT avg({column}) AS g, var_pop({column}) AS v FROM lineitem)"""


def theil_sql(x: str, y: str) -> str:
    """Uncertainty coefficient of x given y."""
    def entropy(by):
        return f"(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY {by}))"
    return f"""
SELECT '{x}' AS x, '{y}' AS y, 'uncertainty' AS kind,
  round(({entropy(x)} - ({entropy(x + ', ' + y)} - {entropy(y)})) / {entropy(x)}, 6) + 0.0 AS value"""


FLAGS = ["l_returnflag", "l_linestatus"]


@query(" UNION ALL ".join([
    f"SELECT x, y, 'correlation' AS kind, r AS value FROM ({corr_sql(LINE, 'lineitem')})",
    *[ratio_sql(c, n) for c in FLAGS for n in LINE],
    theil_sql(*FLAGS), theil_sql(*FLAGS[::-1])]))
def dataset_associations(t):
    return reports.dataset_associations(t("lineitem"), LINE, ["l_returnflag", "l_linestatus"])


@query(" UNION ALL ".join(f"""
SELECT '{c}' AS feature, count({c}) FILTER (a) AS count_a, count({c}) FILTER (NOT a) AS count_b,
  CAST(0 AS BIGINT) AS missing_a, CAST(0 AS BIGINT) AS missing_b,
  round(avg({c}) FILTER (a), 4) + 0.0 AS mean_a, round(avg({c}) FILTER (NOT a), 4) + 0.0 AS mean_b,
  round(stddev_samp({c}) FILTER (a), 4) + 0.0 AS std_a, round(stddev_samp({c}) FILTER (NOT a), 4) + 0.0 AS std_b,
  round(avg({c}) FILTER (NOT a) - avg({c}) FILTER (a), 4) + 0.0 AS mean_delta
FROM (SELECT *, l_returnflag = 'A' AS a FROM lineitem)""" for c in LINE), digits=4)
def compare_datasets(t):
    rows = t("lineitem")
    return reports.compare_datasets(
        rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag <> 'A'"), LINE
    )


@query()
def anova_verdict(t):
    return reports.assumptions_verdict(reports.anova_report(t("events"), "value", "event_type"))


@query()
def outlier_chart(t):
    return reports.outlier_chart(t("events").withColumn("props_chars", F.length("props")),
                                 ["value", "props_chars"], "event_type", ["event_id"])
