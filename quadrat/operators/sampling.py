"""Reproducible samples, splits, folds and ranks by row hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quadrat.functions.columns import order_hash, require_columns
from quadrat.operators.durable import small_side

PREFIX_DIGITS = 4  # 65,536 hash buckets per group


def preview(df: DataFrame, keys: Sequence[str], n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` random rows, the same on every run (a bounded top-n per task)."""
    return (
        df.withColumn("__h", order_hash(keys, seed))
        .orderBy("__h", *keys)
        .limit(n)
        .drop("__h")
    )


def hashed_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """Add the 1-based position in md5 order, per ``by`` group if given.

    Each group is cut into hash buckets. Counts per bucket give the offsets,
    and rows are numbered inside ``(group, bucket)`` only, so no task sees a
    whole group however large it is. ``keys`` must identify a row.
    """
    require_columns(df, [*keys, *by])
    hashed = df.withColumn("__h", order_hash(keys, seed)).withColumn(
        "__b", F.substring("__h", 1, PREFIX_DIGITS)
    )
    # a struct is never NULL and equal to itself, so NULL groups need no special
    # join, and join and window share one partitioning
    group = ["__g"] if by else []
    if by:
        hashed = hashed.withColumn("__g", F.struct(*by))
    bucket = [*group, "__b"]
    counts = hashed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = W.partitionBy(*bucket).orderBy("__h", *keys)
    return (
        hashed.join(offsets, bucket)
        .withColumn(name, F.col("__before") + F.row_number().over(inside))
        .select(*df.columns, name)
    )


def split_train_valid_test(
    df: DataFrame,
    keys: Sequence[str],
    sizes: Sequence[float] = (0.6, 0.2, 0.2),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: exact sizes, random, stable under repartitioning.

    The sizes are ``round(share * n)`` for train and validation, the rest is
    test. Two cut hashes decide, so the rows themselves are never shuffled.
    """
    if abs(sum(sizes) - 1.0) > 1e-9 or len(sizes) != 3:
        raise ValueError("sizes must be three shares that add up to 1")
    hashed = df.withColumn("__h", order_hash(keys, seed)).withColumn(
        "__b", F.substring("__h", 1, PREFIX_DIGITS)
    )
    n = df.agg(F.count(F.lit(1))).scalar()
    train = F.round(n * sizes[0]).cast("long")
    valid = F.round(n * (sizes[0] + sizes[1])).cast("long")
    slim = hashed.select("__h", "__b")
    counts = slim.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # at most 16**PREFIX_DIGITS rows, whatever the table size
    running = W.orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("__upto", F.sum("__n").over(running)).withColumn(
        "__from", F.col("__upto") - F.col("__n")
    )

    def cut_hash(position):
        hit = counts.filter(
            (F.col("__from") < position) & (position <= F.col("__upto"))
        ).select("__b", (position - F.col("__from")).alias("__nth"))
        order = W.partitionBy("__b").orderBy("__h")
        return (
            slim.join(F.broadcast(hit), "__b")  # one bucket
            .withColumn("__i", F.row_number().over(order))
            .filter(F.col("__i") == F.col("__nth"))
            .agg(F.max("__h"))
            .scalar()
        )

    name = (
        F.when(F.col("__h") <= F.coalesce(cut_hash(train), F.lit("")), "train")
        .when(F.col("__h") <= F.coalesce(cut_hash(valid), F.lit("")), "valid")
        .otherwise("test")
    )
    return hashed.withColumn("split", name).drop("__h", "__b")


def split_stratified(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    train: float = 0.6,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` train/test with ``round(train * n_class)`` train rows per class."""
    sizes = df.groupBy(F.col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__size"))
    sizes = small_side(sizes)
    ranked = hashed_rank(df, keys, seed, by=[target], name="__rank")
    label = F.when(F.col("__rank") <= F.round(F.col("__size") * train), "train")
    return (
        ranked.join(sizes, F.col(target).eqNullSafe(F.col("__class")))
        .withColumn("split", label.otherwise("test"))
        .select(*df.columns, "split")
    )


def stratified_folds(
    df: DataFrame,
    target: str,
    k: int,
    keys: Sequence[str],
    seed: int = 42,
    name: str = "fold",
) -> DataFrame:
    """Add a fold number 0…k-1, balanced within every class."""
    ranked = hashed_rank(df, keys, seed, by=[target], name="__rank")
    return ranked.withColumn(name, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def sample_per_value(
    df: DataFrame,
    parameters: Sequence[str],
    keys: Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """One random row for each value of each parameter; repeats are kept.

    The smallest hash per value is a map-side combined number; the few rows that
    carry it are then picked by a join to that small table.
    """
    place = F.conv(F.substring(order_hash(keys, seed), 1, 15), 16, 10).cast("bigint")
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value"))
            for p in parameters
        ]
    )
    long = df.select("*", place.alias("__at"), F.inline(cells)).filter("value is not null")
    first = long.groupBy("parameter", "value").agg(F.min("__at").alias("__at"))
    picked = long.join(small_side(first), ["parameter", "value", "__at"])
    return picked.dropDuplicates(["parameter", "value"]).select("parameter", "value", *df.columns)


def cumulative_share(
    table: DataFrame, order: str, percent: str, name: str = "cumulated"
) -> DataFrame:
    """Running sum of ``percent`` along ``order`` of a small (per-axis) table."""
    running = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return table.withColumn(name, F.sum(percent).over(running))


def cut_at(table: DataFrame, order: str, cumulated: str, threshold: float) -> DataFrame:
    """Rows up to and including the first whose cumulated share reaches ``threshold``."""
    reached = table.filter(F.col(cumulated) >= threshold).agg(F.min(order)).scalar()
    return table.filter(F.col(order) <= F.coalesce(reached, F.col(order)))


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``by`` (a bounded top-n per task)."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(k)
