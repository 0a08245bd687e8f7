"""Importance resampling towards a target distribution: array-scored weights and a distributed quickselect."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import running_start, written

BUCKETS = 10_000
#: Random pivot keys of one round of the selection; a round leaves about a 32nd of the rows.
PIVOTS = 31
CACHED = 400_000
#: Turns A-Z to a-z and every ASCII sign but letters and digits to a blank; bytes of other characters stay.
PLAIN = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case; none for null."""
    return text.encode().translate(PLAIN).split() if text else []


class WordBuckets(dict):
    """Word -> bucket, kept for repeated words."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        got = zlib.crc32(word) % self.buckets
        if len(word) <= 48:
            if len(self) >= CACHED:
                self.clear()
            self[word] = got
        return got

    def of(self, text: str | None, longest: int) -> tuple[np.ndarray, int]:
        """Buckets of all runs of 1 to ``longest`` words, and the number of words."""
        words = plain_words(text)
        parts = [np.array(list(map(self.__getitem__, words)), np.int64)]
        for n in range(2, longest + 1):
            runs = (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
            parts.append(np.fromiter((zlib.crc32(r) % self.buckets for r in runs), np.int64))
        return np.concatenate(parts), len(words)


def bucket_counts(df: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket. Each task adds up an array; one row per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = WordBuckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                total += np.bincount(known.of(one, longest)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = df.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000-fold log ratio of target to raw share of every bucket, both counts one up."""
    s, t = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def scored(df: DataFrame, gains: np.ndarray, key: str, text: str, longest: int) -> DataFrame:
    """``key, n_words, n_features, weight`` of every row: the floored mean of the gains of its features (0 without)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordBuckets(len(gains))
        for batch in batches:
            words, features, weight = [], [], []
            for one in batch.column(1).to_pylist():
                at, n = known.of(one, longest)
                words.append(n)
                features.append(len(at))
                weight.append(int(gains[at].sum()) // len(at) if len(at) else 0)
            columns = [pa.array(c, pa.int64()) for c in (words, features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "n_features", "weight"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(key: str, seed: int) -> Column:
    """Floored 1000-fold Gumbel draw that the seed and the key fix."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


#: Composite key, ascending: higher score, then smaller key (null last), then smaller row. No column holds nulls.
ORDER = ["down", "none", "id", "row"]


def literal(values: dict) -> Column:
    """A composite key as a constant."""
    return F.struct(*[F.lit(values[name]).alias(name) for name in ORDER])


def selected_key(rows: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 1) -> dict | None:
    """The ``k``-th composite key (from 1) in ``ORDER``, found by quickselect over the table; none if there are fewer.

    Each round draws random pivot keys among the rows still in question, counts
    exactly how many rows lie before, at and between them, and goes on with the
    one interval that holds the ``k``-th. Only pivots and counts reach the driver.
    """
    low, high, skipped, round_ = None, None, 0, 0
    here = F.struct(*ORDER)
    while True:
        open_ = rows
        if low:  # plain score limits as well, which the scan can use
            open_ = open_.where((F.col("down") >= low["down"]) & (here > literal(low)))
        if high:
            open_ = open_.where((F.col("down") <= high["down"]) & (here < literal(high)))
        draw = open_.orderBy(F.xxhash64(F.lit(seed), F.lit(round_), "row"), "row").limit(pivots)
        drawn = [r.asDict() for r in draw.select(*ORDER).collect()]  # at most ``pivots`` rows
        if not drawn:
            return None
        drawn.sort(key=lambda r: tuple(r[name] for name in ORDER))
        # Place 2 i: between pivot i - 1 and pivot i; place 2 i + 1: pivot i itself.
        keys = F.array(*map(literal, drawn))
        place = F.size(F.filter(keys, lambda p: p < here)) + F.size(F.filter(keys, lambda p: p <= here))
        counts = dict(open_.groupBy(place.alias("place")).count().collect())  # at most 2 * pivots + 1 rows
        for at in range(2 * len(drawn) + 1):
            n = counts.get(at, 0)
            if skipped + n >= k:
                break
            skipped += n
        else:
            return None
        if at % 2:
            return drawn[at // 2]
        low = drawn[at // 2 - 1] if at else low
        high = drawn[at // 2] if at // 2 < len(drawn) else high
        round_ += 1


def resample(
    df: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row of ``df``; ``rank`` is null for rows that are not drawn.

    Features are all runs of 1 to ``longest`` words, hashed to buckets. A
    bucket's gain is the log ratio of its share in the texts of ``target`` to
    that in ``df``; a row's weight is the mean gain of its features, and its
    score adds a Gumbel draw fixed by seed and key, so the highest scores are a
    weighted draw without replacement. Drawn are ``percent`` hundredths of the
    rows with ``least_words`` words or more.

    The last drawn composite key is found by quickselect over the written
    scores. Only the rows before it are sorted and ranked, in range-sorted slots.

    A null or empty text has no feature and weight 0. Equal scores go by the
    smaller key; a null key comes last, and its noise is that of an empty id.
    Repeated keys are ranked one after the other; each input row gives one row.
    Without target texts gains follow the raw counts alone. An empty table gives
    no row. Other columns are ignored. ``key`` must be an integer.
    """
    gains = bucket_gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    rows = scored(df, gains, key, text, longest)
    rows = rows.withColumns(
        {
            "score": F.col("weight") + noise("key", seed),
            "down": -F.col("weight") - noise("key", seed),
            "none": F.col("key").isNull(),
            "id": F.coalesce(F.col("key").cast("long"), F.lit(0)),
            "entitled": F.col("n_words") >= least_words,
            "row": F.monotonically_increasing_id(),
        }
    )
    rows = written(rows)
    entitled = rows.where("entitled")
    k = percent * entitled.count() // 100
    last = selected_key(entitled, k) if k else None
    won = F.col("entitled") & (F.struct(*ORDER) <= literal(last)) if last else F.lit(False)
    winners = rows.where(won).withColumn("one", F.lit(1).cast("long"))
    ranked = running_start(winners, ORDER, "one", "before").withColumn("rank", F.col("before") + 1)
    others = rows.where(~won).withColumn("rank", F.lit(None).cast("long"))
    names = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(others.select(*names))
