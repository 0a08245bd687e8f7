"""Mixing sources to target weights, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.shared import BLANKS, written

BLOCK_TOKENS, MOST_BLOCKS = 1 << 20, 1 << 16
#: Bisection: so many halvings of [0, 1] a pass, and passes.
HALVINGS, PASSES = 6, 5


def count_words(text: str) -> Column:
    """Number of words of a text, the token unit of the mixture; 0 for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, BLANKS, -1))).cast("long")


def hex_number(text: Column, digits: int) -> Column:
    """Number of the first hexadecimal digits of a text."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def exponents_table(sources: DataFrame, total: int, exponents: list[float]) -> list:
    """Entropy and largest number of passes a token of budget asks, for each exponent (a row each).

    With shares p and weights p**a / Z, entropy is ln Z - a * sum(p**a ln p) / Z.
    """
    share = (F.col("tokens") / F.lit(total)).alias("p")
    grid = F.explode(F.array(*map(F.lit, exponents))).alias("a")
    rows = sources.where("tokens > 0").select(share, grid)
    power = F.pow("p", "a")
    sums = rows.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("l"), F.max(power / F.col("p")).alias("m"))
    return sums.select("a", (F.ln("z") - F.col("a") * F.col("l") / F.col("z")).alias("entropy"), (F.col("m") / F.col("z")).alias("passes")).orderBy("a").collect()


def bisect(sources: DataFrame, total: int, holds) -> tuple[float, float]:
    """Bisect [0, 1] for the exponent where ``holds(row)`` turns from true to false; both ends of the last interval.

    A pass over the source table answers six halvings at once.
    """
    low, width = 0.0, 1.0
    for _ in range(PASSES):
        n = 1 << HALVINGS
        rows = exponents_table(sources, total, [low + width * k / n for k in range(1, n)])
        left = sum(1 for r in rows if holds(r))
        low, width = low + width * left / n, width / n
    return low, low + width


def mixing_weights(
    sources: DataFrame, total: int, budget: int, entropy: float | None, repetition: float | None
) -> tuple[float, float, int]:
    """Exponent, sum of powered shares and budget.

    The largest exponent whose weights reach ``entropy`` (share of the even
    mixture's); raised, if need be, to the smallest at which no source is passed
    more than ``repetition`` times. If even the natural shares (exponent 1) are
    passed more often, the budget is cut.
    """
    kinds = sources.where("tokens > 0").count()
    exponent = 1.0
    ends = {r.a: r for r in exponents_table(sources, total, [0.0, 1.0])}
    if entropy is not None:
        least = entropy * math.log(kinds)
        if ends[1.0].entropy < least:
            exponent = bisect(sources, total, lambda r: r.entropy >= least)[0]
    elif repetition is not None:
        exponent = 0.0
    if repetition is not None:
        if budget > repetition * total:
            exponent, budget = 1.0, int(repetition * total)
        else:
            most = repetition * total / budget
            if ends[0.0].passes > most:
                exponent = max(exponent, bisect(sources, total, lambda r: r.passes > most)[1])
    z = sources.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)))).first()[0]
    return exponent, z, budget


def mix(
    df: DataFrame,
    budget_share: float = 1.0,
    entropy: float | None = 0.95,
    repetition: float | None = 4.0,
    seed: int = 1,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    row: str | None = None,
) -> DataFrame:
    """``key, source, n_tokens, epoch, token_start``: the documents of the mixture, a row for each time one is drawn.

    A source's weight is its token share to a power, normalised; the power is
    bisected (see ``mixing_weights``). Each source gets its weight's part of the
    budget (``budget_share`` of all tokens): whole passes (epochs) and a part of
    one more. In each epoch a source's documents are dealt into blocks of about
    a million tokens by hash, blocks are permuted, and documents are permuted
    within their block; the last epoch stops before the budget is passed.
    ``token_start`` is the place in the epoch. Order windows span one block of
    documents, or the blocks (65,536 at most) of one source.

    Tokens are words. Null and empty sources are one source, ''. Texts without
    words are drawn where they stand and cost nothing, but a source without any
    word has no weight and gives no row; nor does a table without any word or
    row. A source whose next document is longer than what its budget has left
    ends there, so a source of one document may give none. Repeated rows (equal keys) stay together in no
    particular order and each is drawn. Other columns are ignored. ``row`` can
    name a column of unique numbers, which then comes out as ``row`` too.
    """
    docs = df.select(
        F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), count_words(text).alias("n_tokens"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
    )
    docs = written(docs)
    sources = written(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    extra = ["row"] if row else []
    if not total:
        none = F.lit(0).cast("long")
        return docs.where("false").select(F.col("key").alias(key), "source", "n_tokens", none.alias("epoch"), none.alias("token_start"), *extra)
    exponent, z, budget = mixing_weights(sources, total, int(budget_share * total), entropy, repetition)
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)) / F.lit(z)
    plan = sources.where("tokens > 0").withColumn("budget", F.floor(weight * F.lit(budget)).cast("long"))
    plan = plan.select(
        "source",
        F.expr("budget div tokens").alias("passes"),
        (F.col("budget") % F.col("tokens")).alias("rest"),
        F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long").alias("blocks"),
    )
    mark = lambda *parts: F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))
    drawn = docs.join(plan, "source")
    drawn = drawn.withColumn("block", hex_number(mark("key"), 8) % F.col("blocks"))
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
    blocks = drawn.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("size"))
    order = W.partitionBy("source", "epoch").orderBy(mark("epoch", "block"), "block").rowsBetween(W.unboundedPreceding, 0)
    starts = blocks.select("source", "epoch", "block", (F.sum("size").over(order) - F.col("size")).alias("before"))
    inside = W.partitionBy("source", "epoch", "block").orderBy(mark("epoch", "key"), "key", "row").rowsBetween(W.unboundedPreceding, 0)
    placed = drawn.withColumn("end", F.sum("n_tokens").over(inside)).join(starts, ["source", "epoch", "block"])
    end = F.col("before") + F.col("end")
    return placed.where((F.col("epoch") < F.col("passes")) | (end <= F.col("rest"))).select(
        F.col("key").alias(key), "source", "n_tokens", "epoch", (end - F.col("n_tokens")).alias("token_start"), *extra
    )
