"""Kendall's tau-b over all rows, without comparing all row pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quadrat.functions.columns import number
from quadrat.operators.quantiles import ranked_values

Y_SLOTS = 1024


def _pairs_of(n):
    return F.sum(n.cast("double") * (n - 1) / 2.0)


def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(x, y, r)`` with tau-b of two columns.

    Two different x positions differ first at one binary digit. Per digit, rows
    that share the higher digits form a block in which the pairs "0 before 1
    with a smaller y" are counted by a running sum along y; each block is cut
    into y slots so that the blocks of the high digits spread over many tasks.
    """
    complete = df.select(number(a).alias("a"), number(b).alias("b")).dropna()
    cells = complete.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    margins = {}
    for side in ("a", "b"):
        ranks = ranked_values(complete, side)
        margins[side] = ranks.agg(_pairs_of(F.col("n"))).scalar()
        place = ranks.select(
            F.col("value").alias(side), (F.col("first") - 1).alias(f"at_{side}")
        )
        cells = cells.join(place, side)
    n = complete.agg(F.count(F.lit(1))).scalar()
    digits = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(n + 1)).cast("int") - 1, F.lit(0)))
    rows = cells.select(
        "w", "at_a", "at_b",
        F.floor(F.col("at_b") * Y_SLOTS / n).alias("slot"),
        F.explode(digits).alias("digit"),
    ).select(
        "w", "at_b", "slot", "digit",
        F.expr("shiftright(at_a, digit + 1)").alias("block"),
        F.expr("shiftright(at_a, digit) & 1").alias("side"),
    )
    keys = ["digit", "block", "slot"]
    # several x of one block may share a y: fold them, so that y is unique per side
    folded = rows.groupBy(*keys, "at_b").agg(
        F.sum(F.when(F.col("side") == 0, F.col("w")).otherwise(0)).alias("zero"),
        F.sum(F.when(F.col("side") == 1, F.col("w")).otherwise(0)).alias("one"),
    )
    sums = folded.groupBy(*keys).agg(F.sum("zero").alias("zeros"))
    earlier = W.partitionBy("digit", "block").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, F.coalesce(F.sum("zeros").over(earlier), F.lit(0)).alias("before")
    )
    inside = W.partitionBy(*keys).orderBy("at_b").rowsBetween(W.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum("zero").over(inside), F.lit(0))
    counted = folded.join(offsets, keys).select((below.cast("double") * F.col("one")).alias("c"))
    same = cells.agg(_pairs_of(F.col("w"))).scalar()
    pairs = n.cast("double") * (n - 1) / 2.0
    untied = pairs - margins["a"] - margins["b"] + same
    scale = F.sqrt((pairs - margins["a"]) * (pairs - margins["b"]))
    return counted.agg(F.sum("c").alias("c")).select(
        F.lit(a).alias("x"),
        F.lit(b).alias("y"),
        F.try_divide(2.0 * F.col("c") - untied, scale).alias("r"),
    )
