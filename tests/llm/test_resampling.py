"""Importance resampling against a plain recount, and its quickselect against a sort."""

import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from quadrat.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    w = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(rows, wanted, percent=10, least=20, longest=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for total, texts in ((s, [x for _, x in rows]), (t, wanted)):
        for x in texts:
            for f in features(x, longest)[0]:
                total[bucket(f)] += 1
    up, down = float(sum(s) + buckets), float(sum(t) + buckets)
    gain = [math.floor(1000 * math.log((b + 1.0) * up / ((a + 1.0) * down))) for a, b in zip(s, t)]
    out, entitled = {}, []
    for key, x in rows:
        f, n = features(x, longest)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[key] = [len(f), weight, score, None]
        if n >= least:
            entitled.append((-score, key is None, key or 0, key))
    for rank, (*_, key) in enumerate(sorted(entitled)[: percent * len(entitled) // 100], 1):
        out[key][3] = rank
    return {k: tuple(v) for k, v in out.items()}


def got(df, key="doc_id"):
    rows = df.collect()
    assert df.columns == [key, "n_features", "weight", "score", "rank"]
    return {r[0]: tuple(r)[1:] for r in rows}, len(rows)


def test_whole_table(table):
    docs, wanted = table("documents"), table("benchmark")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    texts = [r.text for r in wanted.select("text").collect()]
    assert got(resampling.resample(docs, wanted))[0] == brute(rows, texts)
    assert got(resampling.resample(docs, wanted, percent=50, least_words=0, longest=3))[0] == brute(rows, texts, 50, 0, 3)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A bé É 9x\x00y"), (None, "a b c"), (4, "word " * 30_000), (5, "same text"), (6, "same text")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, score string")
    wanted = spark.createDataFrame([("a word",), (None,)], "text string")
    out, n = got(resampling.resample(docs, wanted, percent=60, least_words=1))
    assert n == len(rows) and out == brute(rows, ["a word", None], 60, 1)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 5 + [(2, "a b c")], "doc_id bigint, text string")
    rows = resampling.resample(docs, docs, percent=50, least_words=1).collect()
    assert len(rows) == 6 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resample(docs, docs).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert resampling.resample(one, docs).first()["rank"] is None  # a tenth of one row is none


def test_quickselect(spark):
    """Every place of a table with many equal scores."""
    place = F.col("id")
    rows = spark.range(500).select(
        (place % 7).alias("down"), (place % 11 == 0).alias("none"), (place % 13).alias("id"), place.alias("row")
    )
    order = sorted(tuple(r) for r in rows.collect())
    for k in (1, 2, 250, 499, 500):
        assert tuple(resampling.selected_key(rows, k, pivots=5).values()) == order[k - 1]
    assert resampling.selected_key(rows, 501, pivots=50) is None
