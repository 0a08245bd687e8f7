"""Exact quantiles, ranks and median deviations without a whole-group buffer.

``percentile`` keeps every distinct value of a group in one task. Here a
bounded sketch brackets each wanted order statistic first, and brackets that may
still hold many rows are sketched again inside until they hold few. Then a
single aggregate counts rows, keeping individual values only inside the
brackets. So the candidates ordered per group stay bounded at any size. The
counts prove the result: a bracket that missed its position raises.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quadrat.functions.columns import melt, number
from quadrat.operators.durable import durable, small_side

MAD_SCALE = 0.6744897501960817  # fixed value: the 0.75 quantile of the normal
SKETCH_K = 32_768  # at most about a megabyte per group and a rank error of 1.4e-4
MARGIN = 5e-4  # bracket half-width in rank, more than three times that error
ORDERED = 10_000  # rows of a bracket whose values are ordered in one place
GRID = 500  # quantiles of a bracket's inside to narrow it by
WIDE_TABLE = 48  # more columns than this share one scan in long form


def sketched_edges(x: Column, probs: Sequence[float]) -> Column:
    """Aggregate: ``[lo0, hi0, lo1, hi1, …]`` around each quantile; NULL without rows."""
    ranks = [
        edge for p in probs for edge in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))
    ]
    sketch = F.kll_sketch_agg_double(x, F.lit(SKETCH_K))
    edges = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(r) for r in ranks]))
    whole = F.array(*[F.lit(e) for _ in probs for e in (-math.inf, math.inf)])
    return F.when(F.count(x) > ORDERED, edges).when(F.count(x) > 0, whole)


def narrowed(x: Column, n: Column, edges: Sequence[Column], probs: Sequence[float]) -> Column:
    """Aggregate ``struct<edges, held>``: crowded brackets cut down by a sketch of their inside.

    ``held`` is about the most rows that a bracket which became smaller still
    holds; one that cannot shrink has only few distinct values left.
    """
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    found, held = [], []
    for i, p in enumerate(probs):
        lo, hi = edges[2 * i], edges[2 * i + 1]
        inside = (x >= lo) & (x <= hi)
        count = F.count_if(inside)
        sketch = F.kll_sketch_agg_double(F.when(inside, x), F.lit(SKETCH_K))
        points = F.kll_sketch_get_quantile_double(sketch, ranks)
        place = F.floor(F.lit(float(p)) * (n - 1)) - F.count_if(x < lo)
        step = F.lit(float(GRID)) / F.greatest(count - 1, F.lit(1))
        start = F.least(F.greatest(F.floor(place * step) - 1, F.lit(0)), F.lit(GRID))
        stop = F.least(F.greatest(F.ceil((place + 1) * step) + 1, F.lit(0)), F.lit(GRID))
        low = F.greatest(lo, F.element_at(points, (start + 1).cast("int")))
        high = F.least(hi, F.element_at(points, (stop + 1).cast("int")))
        crowded = count > ORDERED
        shrunk = crowded & ((low > lo) | (high < hi)) & (low < high)
        found += [F.when(crowded, low).otherwise(lo), F.when(crowded, high).otherwise(hi)]
        held.append(F.when(shrunk, count * (stop - start) / F.lit(float(GRID))).otherwise(F.lit(0.0)))
    return F.struct(F.array(*found).alias("edges"), F.array_max(F.array(*held)).alias("held"))


def column_brackets(
    df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float]
) -> list[Row]:
    """``(feature, n, edges)`` of whole columns: one scan, and one more per thousandfold of 10 million rows."""
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            F.count(x).alias("n"),
            sketched_edges(x, probs).alias("edges"),
        )
        for name, x in columns.items()
    ]
    first = df.agg(F.array(*cells).alias("cells")).first()["cells"]
    found = {r["feature"]: (r["n"], r["edges"], 2 * MARGIN * r["n"]) for r in first}
    while crowded := [f for f, (_, _, held) in found.items() if held > ORDERED]:
        cells = []
        for f in crowded:
            n, edges, _ = found[f]
            step = narrowed(columns[f], F.lit(n), [F.lit(e) for e in edges], probs)
            cells.append(F.struct(F.lit(f).alias("feature"), step.alias("step")))
        for r in df.agg(F.array(*cells).alias("cells")).first()["cells"]:
            found[r["feature"]] = (found[r["feature"]][0], r["step"]["edges"], r["step"]["held"])
    return [Row(feature=f, n=n, edges=edges) for f, (n, edges, _) in found.items()]


def _folded(value: Column, edges: Sequence[Column]) -> list[Column]:
    """``anchor`` and ``outside``: the value itself inside a bracket, else the bracket below."""
    pairs = [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2)]
    inside = reduce(lambda a, b: a | b, [(value >= lo) & (value <= hi) for lo, hi in pairs])
    passed = [F.when(value > hi, hi) for _, hi in pairs]
    below = F.greatest(*passed) if len(passed) > 1 else passed[0]
    return [
        F.when(inside, value).otherwise(below).alias("__anchor"),
        (~inside).alias("__outside"),
    ]


def _interpolate(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from ``(keys…, n, __anchor, __outside, __rows)``."""
    order = W.partitionBy(*keys).orderBy(F.col("__anchor").asc_nulls_first(), "__outside")
    upto = F.sum("__rows").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.withColumn("__upto", upto).withColumn(
        "__from", F.col("__upto") - F.col("__rows")
    )

    def order_statistic(rank: Column) -> Column:
        hit = (F.col("__from") <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(hit & ~F.col("__outside"), F.col("__anchor")))

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("n") - 1)

    picks = []
    for i, p in enumerate(probs):
        low = F.floor(position(p))
        high = F.least(low + 1, F.col("n") - 1)
        picks += [order_statistic(low).alias(f"__x{i}"), order_statistic(high).alias(f"__y{i}")]
    found = placed.groupBy(*keys, "n").agg(*picks)
    quantiles = []
    for i, p in enumerate(probs):
        x, y = F.col(f"__x{i}"), F.col(f"__y{i}")
        share = position(p) - F.floor(position(p))
        missed = F.when(x.isNull() | y.isNull(), F.raise_error(F.lit("quantile bracket missed")))
        quantiles.append(missed.otherwise(x + share * (y - x)).cast("double").alias(f"q{i}"))
    return found.select(*keys, "n", *quantiles)


def column_quantiles(
    df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], brackets: list[Row]
) -> DataFrame:
    """``(feature, n, q0, …)`` of whole columns whose brackets are known.

    Each column is counted by its own one-column scan with the bracket as
    literals, so nothing is exploded; very wide tables go through long form.
    """
    known = {row["feature"]: row for row in brackets if row["n"]}
    if not known:
        return df.sparkSession.createDataFrame(
            [], ", ".join(["feature string", "n bigint", *[f"q{i} double" for i in range(len(probs))]])
        )
    if len(known) > WIDE_TABLE:
        table = df.sparkSession.createDataFrame(
            [(f, row["n"], row["edges"]) for f, row in known.items()],
            "feature string, n bigint, __edges array<double>",
        )
        wide = df.select(*[columns[f].alias(f) for f in known])
        return _counted(melt(wide, list(known)), F.broadcast(table), ["feature"], probs)
    branches = []
    for feature, row in known.items():
        value = F.col("value")
        rows = df.select(columns[feature].alias("value")).filter("value is not null")
        counts = (
            rows.select(*_folded(value, [F.lit(e) for e in row["edges"]]))
            .groupBy("__anchor", "__outside")
            .agg(F.count(F.lit(1)).alias("__rows"))
        )
        branches.append(
            counts.select(F.lit(feature).alias("feature"), F.lit(row["n"]).alias("n"), "*")
        )
    return _interpolate(reduce(DataFrame.unionAll, branches), ["feature"], probs)


def _counted(long: DataFrame, brackets: DataFrame, keys, probs) -> DataFrame:
    rows = long.filter("value is not null").join(brackets, list(keys))
    edges = [F.col("__edges")[i] for i in range(2 * len(probs))]
    counts = (
        rows.select(*keys, "n", *_folded(F.col("value"), edges))
        .groupBy(*keys, "n", "__anchor", "__outside")
        .agg(F.count(F.lit(1)).alias("__rows"))
    )
    return _interpolate(counts, keys, probs)


def select_quantiles(
    long: DataFrame, keys: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """Exact linear-interpolated quantiles ``q0, q1, …`` per key of ``(keys…, value)``.

    Keys must not be NULL; NULL values are skipped. The brackets are written
    once, and broadcast only if they turn out to be few.
    """
    long = long.filter("value is not null")
    brackets = long.groupBy(*keys).agg(
        F.count("value").alias("n"), sketched_edges(F.col("value"), probs).alias("__edges")
    )
    brackets = small_side(brackets)
    held = 2 * MARGIN * (brackets.agg(F.max("n")).first()[0] or 0)
    edges = [F.col("__edges")[i] for i in range(2 * len(probs))]
    while held > ORDERED:
        step = narrowed(F.col("value"), F.col("n"), edges, probs).alias("__step")
        rows = long.join(brackets, list(keys)).groupBy(*keys, "n", "__edges").agg(step)
        table = small_side(rows.select(*keys, "n", F.col("__step.edges").alias("__edges"), F.col("__step.held").alias("__held")))
        held, brackets = table.agg(F.max("__held")).first()[0], table.drop("__held")
    return _counted(long, brackets, keys, probs)


def quantile_table(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """``(by…, feature, n, q0, q1, …)``: quantiles of every column, per group.

    ``exact=False`` returns actual elements from a bounded sketch instead.
    Rows with a NULL group key are left out.
    """
    keys = [*by, "feature"]
    df = df.dropna(subset=list(by)) if by else df
    if exact and not by:
        values = {c: number(c) for c in columns}
        return column_quantiles(df, values, probs, column_brackets(df, values, probs))
    long = melt(df, columns, by).filter("value is not null")
    if exact:
        return select_quantiles(long, keys, probs)
    sketch = long.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", [float(p) for p in probs], 10_000).alias("__q"),
    )
    return sketch.select(
        *keys, "n", *[F.col("__q")[i].alias(f"q{i}") for i in range(len(probs))]
    )


def column_deviations(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """``(feature, deviation)``: median distance from the known medians."""
    values = {c: F.abs(number(c) - F.lit(m)) for c, m in medians.items()}
    brackets = column_brackets(df, values, [0.5]) if values else []
    return column_quantiles(df, values, [0.5], brackets).select(
        "feature", F.col("q0").alias("deviation")
    )


def median_deviation_table(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``(by…, feature, median, deviation)``: unscaled median absolute deviation."""
    df = df.dropna(subset=list(by)) if by else df
    keys = [*by, "feature"]
    centre = quantile_table(df, columns, [0.5], by).select(*keys, F.col("q0").alias("median"))
    if not by:
        medians = {r["feature"]: r["median"] for r in centre.collect()}  # one per column
        found = df.sparkSession.createDataFrame(
            list(medians.items()), "feature string, median double"
        )
        return found.join(column_deviations(df, medians), "feature")
    centre = small_side(centre)
    long = melt(df, columns, by).filter("value is not null").join(centre, keys)
    deviation = select_quantiles(
        long.select(*keys, F.abs(F.col("value") - F.col("median")).alias("value")), keys, [0.5]
    )
    return centre.join(deviation.select(*keys, F.col("q0").alias("deviation")), keys)


def robust_mad(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median absolute deviation scaled to the normal, per column."""
    return median_deviation_table(df, columns, by).select(
        *by, "feature", (F.col("deviation") / F.lit(MAD_SCALE)).alias("mad")
    )


def running_totals(
    table: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``upto_<c>``: running sums along unique ``order`` values, per ``by`` key.

    The table is range-sorted into slots and written once, so that the slots
    stay fixed. Sums run inside each slot and are shifted by the slots before
    it; only one row per slot is ever put in a single ordering.
    """
    slots = durable(
        table.repartitionByRange(*by, order).withColumn("slot", F.spark_partition_id())
    )
    keys = [*by, "slot"]
    per_slot = slots.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    before = W.partitionBy(*by).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slot.select(
        *keys,
        *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in columns],
    )
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = {f"upto_{c}": F.col(f"__b_{c}") + F.sum(c).over(inside) for c in columns}
    return slots.join(offsets, keys).withColumns(totals).select(
        *table.columns, *[f"upto_{c}" for c in columns]
    )


def running_extreme(
    table: DataFrame, order: str, column: str, kind: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``extreme``: running ``max`` from the start, or ``min`` from the end, along unique ``order`` values, per ``by`` key.

    As in :func:`running_totals`, rows are range-sorted into slots, and only one
    row per slot is put in a single ordering; its extreme is carried to the
    slots behind (``max``) or in front (``min``). A ``min`` from the end runs
    along the falling order: Spark goes over a frame that reaches the end of its
    partition again for every row, but only once over one that begins there.
    """
    take, best = {"max": (F.max, F.greatest), "min": (F.min, F.least)}[kind]
    slots = durable(
        table.repartitionByRange(*by, order).withColumn("slot", F.spark_partition_id())
    )
    keys = [*by, "slot"]
    along = F.asc if kind == "max" else F.desc
    carried = take("__own").over(W.partitionBy(*by).orderBy(along("slot")).rowsBetween(W.unboundedPreceding, -1))
    ends = slots.groupBy(*keys).agg(take(column).alias("__own")).select(*keys, carried.alias("__end"))
    inside = take(column).over(W.partitionBy(*keys).orderBy(along(order)).rowsBetween(W.unboundedPreceding, W.currentRow))
    return slots.join(ends, keys).withColumn("extreme", best(inside, "__end")).select(*table.columns, "extreme")


def ranked_values(
    df: DataFrame, column: str, by: Sequence[str] = (), own_type: bool = False
) -> DataFrame:
    """Global ranks of the distinct values: ``(by…, value, n, first, last, rank)``.

    ``first``/``last`` are the 1-based positions of the value's rows in the
    whole ordering (per ``by`` key) and ``rank`` is their mean. Values are
    counted before the range sort, so a hot value is one row. Values are ranked
    as doubles, or with ``own_type`` in the column's type.
    """
    counted = (
        df.select(*by, (F.col(column) if own_type else number(column)).alias("value"))
        .filter("value is not null")
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = F.col("upto_n") - F.col("n") + 1
    return running_totals(counted, "value", ["n"], by).select(
        *by, "value", "n", first.alias("first"), F.col("upto_n").alias("last"),
        ((first + F.col("upto_n")) / 2.0).alias("rank"),
    )


def rank_global(df: DataFrame, column: str, tie_keys: Sequence[str]) -> DataFrame:
    """Add ``rank`` 1…n over the whole table by ``column``, then by ``tie_keys``.

    NULL values get no rank. The rows join back to the ranked distinct values;
    inside a tie the rows are numbered by hash buckets of the tie keys, so a
    value shared by a third of all rows is spread over many tasks.
    """
    from quadrat.operators.sampling import hashed_rank

    whole = isinstance(df.schema[column].dataType, (T.IntegralType, T.DecimalType))
    ranks = ranked_values(df, column, own_type=whole).select(
        F.col("value").alias("__value"), F.col("first").alias("__first")
    )
    inner = df.filter(F.col(column).isNotNull())
    tied = hashed_rank(inner, tie_keys, 0, by=[column], name="__tie")
    value = F.col(column) if whole else F.col(column).cast("double")
    joined = tied.join(ranks, value == F.col("__value"))
    return joined.select(
        *df.columns, (F.col("__first") + F.col("__tie") - 1).alias("rank")
    )
