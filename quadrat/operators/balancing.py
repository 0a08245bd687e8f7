"""Class balancing: random over- and under-sampling and the SMOTE family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.durable import durable, small_side
from quadrat.operators.neighbours import as_points, nearest
from quadrat.operators.sampling import hashed_rank


def _class_sizes(df: DataFrame, target: str) -> DataFrame:
    sizes = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("__class"))
    return sizes.agg(F.count(F.lit(1)).alias("__size"))


def resample_under(df: DataFrame, target: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Cut every class to the size of the smallest, by row hash."""
    smallest = _class_sizes(df, target).agg(F.min("__size")).scalar()
    ranked = hashed_rank(df.filter(F.col(target).isNotNull()), keys, seed, [target], "__rank")
    return ranked.filter(F.col("__rank") <= smallest).select(*df.columns)


def resample_over(df: DataFrame, target: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Repeat rows until every class has the size of the largest.

    Each row is kept and repeated evenly; the remainder goes to the rows first
    in hash order.
    """
    sizes = _class_sizes(df, target)
    largest = sizes.agg(F.max("__size")).scalar()
    ranked = hashed_rank(df.filter(F.col(target).isNotNull()), keys, seed, [target], "__rank")
    extra = (F.col("__rank") <= largest % F.col("__size")).cast("bigint")
    copies = F.floor(largest / F.col("__size")) + extra
    return (
        ranked.join(small_side(sizes), F.col(target) == F.col("__class"))
        .select(*df.columns, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("__copy"))
        .drop("__copy")
    )


def _uniform(*parts: Column, seed: int) -> Column:
    """Reproducible number in [0, 1) from a hash."""
    span = 1 << 40
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(span)) / float(span)


def _synthesise(
    seeds: DataFrame, df: DataFrame, target: str, key: str, columns: Sequence[str], seed: int
) -> DataFrame:
    """Synthetic rows ``(key, target, columns…)`` that fill each class up to the largest.

    ``seeds`` holds ``(id, vector, label, found)`` of the rows that may be
    extended. Each seed makes its even share; the remainder goes to the rows
    first in hash order.
    """
    seeds = durable(seeds.filter(F.size("found") > 0))  # counted and ranked: searched once
    sizes = _class_sizes(df, target).select(F.col("__class").cast("string").alias("label"), "__size")
    largest = sizes.agg(F.max("__size")).scalar()
    counts = seeds.groupBy("label").agg(F.count(F.lit(1)).alias("__seeds")).join(sizes, "label")
    counts = counts.select("label", "__seeds", (largest - F.col("__size")).alias("__need"))
    ranked = hashed_rank(seeds, ["id"], seed, ["label"], "__rank").join(small_side(counts), "label")
    share = F.floor(F.col("__need") / F.col("__seeds")) + (
        F.col("__rank") <= F.col("__need") % F.col("__seeds")
    ).cast("bigint")
    made = ranked.withColumn("__n", share.cast("int")).filter("__n > 0").withColumn(
        "__i", F.explode(F.sequence(F.lit(1), F.col("__n")))
    )
    pick = F.floor(_uniform("id", "__i", F.lit("pick"), seed=seed) * F.size("found")).cast("int")
    made = made.withColumn("__other", F.element_at("found", pick + 1)["vector"]).withColumn(
        "__u", _uniform("id", "__i", F.lit("step"), seed=seed)
    )
    new = [
        (F.col("vector")[i] + F.col("__u") * (F.col("__other")[i] - F.col("vector")[i])).alias(c)
        for i, c in enumerate(columns)
    ]
    return made.select(
        F.concat_ws("~", "id", F.col("__i").cast("string")).alias(key),
        F.col("label").cast(df.schema[target].dataType).alias(target),
        *new,
    )


def _with_synthetic(df, made, target, key, columns) -> DataFrame:
    original = df.select(
        F.col(key).cast("string").alias(key),
        target,
        *[F.col(c).cast("double").alias(c) for c in columns],
        F.lit(False).alias("synthetic"),
    )
    return original.unionByName(made.withColumn("synthetic", F.lit(True)))


def _own_class(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nearest neighbours within the row's own class, one search per class."""
    labels = [r[0] for r in points.select("label").distinct().collect()]  # the classes
    found = None
    for label in labels:
        same = F.col("label") == label
        part = nearest(queries.filter(same), points.filter(same), k)
        found = part if found is None else found.unionAll(part)
    return found


def _minority(points: DataFrame) -> DataFrame:
    """Points of the classes smaller than the largest."""
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    small = sizes.filter(F.col("__n") < sizes.agg(F.max("__n")).scalar()).select("label")
    return points.join(small_side(small), "label", "left_semi").select("id", "vector", "label")


def smote(
    df: DataFrame,
    target: str,
    key: str,
    columns: Sequence[str],
    k: int = 5,
    seed: int = 42,
    kind: str = "regular",
    clusters: int = 8,
    m: int = 10,
) -> DataFrame:
    """Original rows plus synthetic ones, ``(key, target, columns…, synthetic)``.

    A synthetic row lies between a row and one of its k nearest neighbours of the
    same class. Kinds: ``regular``; ``borderline`` extends only rows of which at
    least half, but not all, of the ``m`` nearest rows belong to other classes;
    ``kmeans`` searches inside k-means clusters in which the class is not the
    rarer side; ``svm`` extends only rows inside the margin of a linear SVM;
    ``enn`` cleans the regular result with :func:`edited_neighbours`.
    Where a kind selects no row of a class, all rows of the class are extended.
    """
    # Only these columns are used, many times over: what they are made from is read once.
    df = durable(df.select(*dict.fromkeys([key, target, *columns])))
    points = as_points(df, key, columns, target)
    queries = _minority(points)
    if kind in ("regular", "enn"):
        seeds = _own_class(queries, queries, k)
    elif kind == "borderline":
        around = nearest(queries, points, m)
        others = F.size(F.filter("found", lambda n: n["label"] != F.col("label")))
        danger = around.filter((others * 2 >= F.size("found")) & (others < F.size("found")))
        seeds = _own_class(queries, _or_all(danger, queries), k)
    elif kind == "svm":
        seeds = _own_class(queries, _or_all(_inside_margin(points, queries), queries), k)
    elif kind == "kmeans":
        seeds = _inside_clusters(points, queries, k, clusters, seed)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    made = _synthesise(seeds, df, target, key, columns, seed)
    both = _with_synthetic(df, made, target, key, columns)
    return edited_neighbours(durable(both), target, key, columns) if kind == "enn" else both


def _or_all(chosen: DataFrame, queries: DataFrame) -> DataFrame:
    """Chosen rows; all rows of a class that has none."""
    chosen = chosen.select("id", "vector", "label")
    rest = queries.join(chosen.select("label").distinct(), "label", "left_anti")
    return chosen.unionByName(rest.select("id", "vector", "label"))


def _vectors(points: DataFrame) -> DataFrame:
    size = len(points.first()["vector"])
    wide = points.select("*", *[F.col("vector")[i].alias(f"__f{i}") for i in range(size)])
    return VectorAssembler(
        inputCols=[f"__f{i}" for i in range(size)], outputCol="features"
    ).transform(wide)


def _inside_margin(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Query rows whose own-class margin is below one (the support vectors)."""
    ready = _vectors(points)
    indexed = StringIndexer(inputCol="label", outputCol="code", stringOrderType="alphabetAsc")
    codes = indexed.fit(ready)
    svm = OneVsRest(
        classifier=LinearSVC(standardization=True, maxIter=100), labelCol="code",
        featuresCol="features", predictionCol="p",
    ).fit(codes.transform(ready))
    scored = svm.transform(codes.transform(_vectors(queries)))
    own = F.element_at(vector_to_array(svm.getRawPredictionCol()), F.col("code").cast("int") + 1)
    return scored.filter(own < 1.0)


def _inside_clusters(
    points: DataFrame, queries: DataFrame, k: int, clusters: int, seed: int
) -> DataFrame:
    """Neighbours within clusters where the class reaches its share of the rows."""
    model = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster")
    fitted = model.fit(_vectors(points))
    placed = fitted.transform(_vectors(points)).select("id", "vector", "label", "cluster")
    sizes = placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("total"))
    good = sizes.join(totals, "cluster").filter(
        (F.col("n") * 2 >= F.col("total")) & (F.col("n") > k)
    )
    chosen = placed.join(good.select("cluster", "label"), ["cluster", "label"], "left_semi")
    chosen = chosen.join(queries.select("id"), "id", "left_semi")
    # cluster and class together name the group that is searched
    mark = F.concat_ws("~", F.col("cluster").cast("string"), "label")
    marked = chosen.select("id", "vector", mark.alias("label"))
    rest = queries.join(chosen.select("label").distinct(), "label", "left_anti")
    plain = rest.select("id", "vector", F.concat_ws("~", F.lit("-"), "label").alias("label"))
    both = marked.unionByName(plain)
    found = _own_class(both, both, k)
    return found.withColumn("label", F.regexp_replace("label", "^[^~]*~", ""))


def edited_neighbours(
    df: DataFrame, target: str, key: str, columns: Sequence[str], k: int = 3
) -> DataFrame:
    """Remove rows that not all of their k nearest rows agree with in class."""
    points = as_points(df, key, columns, target)
    found = nearest(points, points, k)
    agree = F.size(F.filter("found", lambda n: n["label"] == F.col("label")))
    wrong = found.filter(agree < F.size("found")).select(F.col("id").alias("__id"))
    return df.join(wrong, F.col(key).cast("string") == F.col("__id"), "left_anti")
