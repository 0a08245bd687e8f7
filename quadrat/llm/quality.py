"""Quality rules: plain counts and a hashed n-gram likelihood ratio, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import BLANKS, written

BUCKETS = 1 << 16
#: Targets (keys of 8 bytes) that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Part of the target model that the trusted counts make; the raw shares make the rest.
TRUST = 0.9
#: Share of the trusted documents, each scored without its own counts, that the threshold keeps at least.
KEEP = 0.99
#: Steps of the threshold to a unit of score.
STEPS = 1000


def with_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, word, n_words`` with the array of words of each text; null counts as empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.select(F.col(key).alias("key"), whole.alias("text"))
    df = df.withColumn("trimmed", F.btrim("text", F.lit(" \t\n\x0b\f\r")))
    none = F.array().cast("array<string>")
    df = df.withColumn("word", F.when(F.col("trimmed") == "", none).otherwise(F.split("trimmed", BLANKS, -1)))
    return df.withColumn("n_words", F.size("word").cast("long")).drop("trimmed")


def with_hashes(df: DataFrame) -> DataFrame:
    """Add ``one`` and ``two``: hashes of the words and of neighbouring word pairs."""
    df = df.withColumn("one", F.transform("word", lambda w: F.xxhash64(w)))
    left = F.slice("one", F.lit(1), F.greatest(F.size("one") - 1, F.lit(0)))
    right = F.slice("one", F.lit(2), F.greatest(F.size("one") - 1, F.lit(0)))
    return df.withColumn("two", F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))


def with_rules(df: DataFrame) -> DataFrame:
    """Add ``word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    ``n_repeat_words`` counts the words covered by 3-word windows that occur at
    least twice in the text. Windows are compared by a 64-bit hash. Only texts
    with an equal pair sort their windows, each with its place.
    """
    n = F.greatest(F.size("one") - 2, F.lit(0))
    three = F.zip_with(F.slice("two", F.lit(1), n), F.slice("one", F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("three", three)
    pairs = F.transform("three", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    df = df.withColumn(
        "ordered",
        F.when(F.size(F.array_distinct("three")) < F.size("three"), F.sort_array(pairs)),
    )

    def repeated(x: Column, k: Column) -> Column:
        near = F.coalesce(F.get("ordered", k - 1)["g"] == x["g"], F.lit(False))
        return near | F.coalesce(F.get("ordered", k + 1)["g"] == x["g"], F.lit(False))

    places = F.sort_array(F.transform(F.filter("ordered", repeated), lambda x: x["i"]))
    df = df.withColumn("places", places)
    gaps = F.zip_with(
        F.slice("places", F.lit(2), F.greatest(F.size("places") - 1, F.lit(0))),
        F.slice("places", F.lit(1), F.greatest(F.size("places") - 1, F.lit(0))),
        lambda b, a: F.least(F.lit(3), b - a),
    )
    covered = F.lit(3) + F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    df = df.withColumn("line", lines)
    df = df.withColumns(
        {
            "word_chars": F.char_length(F.regexp_replace("text", BLANKS, "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("line") - F.size(F.array_distinct("line"))).cast("long"),
            "n_repeat_words": F.when(F.size("places") > 0, covered).otherwise(0).cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("three", "ordered", "places", "line")


def with_trust(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Add ``trusted``: whether the row's key is one of ``target``; null keys never are."""
    keys = target.select(F.col(key).alias("key")).dropna().distinct().withColumn("trusted", F.lit(True))
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    joined = df.join(F.broadcast(keys) if few else keys, "key", "left")
    return joined.withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def bucket_counts(df: DataFrame) -> tuple[list[int], list[int]]:
    """How often the words and pairs of each bucket occur in all rows, and in the trusted ones.

    One pre-aggregated pass; the result has one row per bucket, 65,536 at most.
    """
    hashes = df.select("trusted", F.explode(F.concat("one", "two")).alias("hash"))
    bucket = F.pmod("hash", F.lit(BUCKETS)).cast("int")
    counts = hashes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))
    raw, wanted = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # one row per bucket
        raw[r.bucket], wanted[r.bucket] = r.raw, r.target
    return raw, wanted


def with_score(df: DataFrame, raw: list[int], wanted: list[int]) -> DataFrame:
    """Add ``score``: the mean log ratio of a text's words and pairs under the target and the raw model.

    The text's own counts are taken out of the raw counts and, if it is
    trusted, out of the target's, so that being trusted gives no advantage. Raw
    shares are one up per bucket; the target mixes the trusted shares with them.
    """
    # Constants of 65,536 numbers; the optimiser folds the parsing away.
    others_count = F.split(F.lit(",".join(str(n + 1) for n in raw)), ",").cast("array<double>")
    target_count = F.split(F.lit(",".join(map(str, wanted))), ",").cast("array<double>")
    grams = (F.size("one") + F.size("two")).alias("grams")
    # A bit mask, unlike a remainder, is never null, so the whole numbers are sorted as such.
    df = df.withColumn("bucket", F.sort_array(F.transform(F.concat("one", "two"), lambda h: h.bitwiseAND(BUCKETS - 1).cast("int"))))
    places = F.slice(F.sequence(F.lit(0), F.size("bucket")), F.lit(1), F.size("bucket"))
    df = df.withColumn("first", F.filter(places, lambda i: ~F.get("bucket", i).eqNullSafe(F.get("bucket", i - 1))))
    after = F.concat(F.slice("first", F.lit(2), F.greatest(F.size("first") - 1, F.lit(0))), F.array(F.size("bucket")))
    raw_total = F.lit(sum(raw) + BUCKETS).cast("double") - grams
    target_total = F.greatest(F.lit(sum(wanted)).cast("double") - F.when(F.col("trusted"), grams).otherwise(0), F.lit(1.0))
    mine = F.col("trusted").cast("double")
    df = df.withColumns({"scale": raw_total * F.lit(TRUST) / target_total, "after": after, "mine": mine})

    def term(at: Column, own: Column) -> Column:
        others = F.get(others_count, at) - own
        return own * F.ln(F.col("scale") * (F.get(target_count, at) - own * F.col("mine")) / others + F.lit(1 - TRUST))

    df = df.withColumn("own", F.zip_with("after", "first", lambda b, a: (b - a).cast("double")))
    df = df.withColumn("kind", F.transform("first", lambda i: F.get("bucket", i)))
    total = F.aggregate(F.zip_with("kind", "own", term), F.lit(0.0), lambda s, x: s + x)
    score = F.when(grams > 0, total / grams).otherwise(F.lit(0.0))
    return df.withColumn("score", score).drop("bucket", "first", "after", "scale", "mine", "own", "kind")


def trusted_threshold(scored: DataFrame, keep: float) -> float:
    """The largest multiple of 1/1000 that at least the share ``keep`` of the sound trusted rows reaches; 0 without any.

    Scores lie between ln(1 - TRUST) and the log of the number of n-grams, so the
    counted steps are some ten thousands at most.
    """
    rows = scored.where("trusted AND NOT base_failed")
    steps = rows.groupBy(F.floor(F.col("score") * STEPS).alias("step")).count().orderBy(F.desc("step")).collect()
    least, reached = keep * sum(r["count"] for r in steps), 0
    for r in steps:
        reached += r["count"]
        if reached >= least:
            return r.step / STEPS
    return 0.0


def quality_rules(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", keep: float = KEEP, threshold: float | None = None
) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, kept`` of every document.

    ``score`` is the mean, over a text's words and neighbouring pairs, of the
    log ratio of their hashed shares in the trusted documents (keys of
    ``target``) and in all documents, both without the text itself; ``kept`` is
    ``score >= threshold`` unless the base rules fail. The threshold, if not
    given, is the one that ``keep`` of the trusted documents reach. No draw is
    made, so every run decides alike.

    A null text counts as empty: all counts are 0 and it fails. A text without
    n-grams has score 0. Null and repeated keys keep a row per input row (a null
    key is never trusted). Without any trusted text all scores are equal and the
    base rules alone decide. An empty table gives no row. Other columns are
    ignored.
    """
    rows = with_trust(with_hashes(with_words(df, key, text)), target, key)
    raw, wanted = bucket_counts(rows)
    scored = with_score(with_rules(rows), raw, wanted)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    scored = written(scored.select("key", "trusted", *counts))
    if threshold is None:
        threshold = trusted_threshold(scored, keep) if sum(wanted) else -math.inf
    return scored.select(
        F.col("key").alias(key), *counts, F.lit(threshold).alias("threshold"),
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
    )
