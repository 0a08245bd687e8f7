"""Repeated byte strings against brute force, at several shard sizes."""

import hashlib
import random

import numpy as np
import pytest

from quadrat.llm import suffix_order


def brute(rows, least=50):
    first = {}
    for key, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - least + 1) if key is not None else ():
            w = raw[i : i + least]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1) if key is not None else ():
            if first[raw[i : i + least]] < key:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((key, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcde é\U0001f600") for _ in range(n)) for n in (50, 49, 51, 120, 400)]
    rows = [(None, passages[3]), (1, None), (2, ""), (3, "short"), (4, "z" * 30_000), (5, "z" * 200 + passages[4] + "z" * 70)]
    for key in range(6, 60):
        rows.append((key, "".join(rng.choice("xyzw ß") for _ in range(rng.randrange(90))).join(rng.choices(passages, k=3))))
    rows += [(70, passages[4] * 3), (70, passages[4] * 3), (70, "other " + passages[4]), (71, "\x00" * 60), (72, "\x00" * 61)]
    return rows


SIZES = [{}, {"shard": 3000, "fan": 2}, {"shard": 40_000, "overfull": 4000, "fan": 3}]


@pytest.mark.parametrize("sizes", SIZES)
def test_odd_rows(spark, sizes):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, n_bytes int")
    assert got(suffix_order.remove_repeated_bytes(docs, **sizes)) == brute(rows)


def test_overfull_shards_are_dealt_anew(spark, monkeypatch):
    """The sizes above reach the second round."""
    seen = []
    one = suffix_order.single_windows
    monkeypatch.setattr(suffix_order, "single_windows", lambda parts: seen.append(parts) or one(parts))
    docs = spark.createDataFrame(odd_rows(), "doc_id bigint, text string")
    suffix_order.repeated_strings(docs, **SIZES[2]).count()
    assert seen


def test_whole_table(table):
    docs = table("documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(suffix_order.remove_repeated_bytes(docs)) == brute(rows)


def test_kept_bytes(spark):
    text = "The same passage of more than fifty bytes stands in both of them."
    docs = spark.createDataFrame([(1, text, "a"), (2, "<" + text + ">", "b")], "doc_id bigint, text string, lang string")
    rows = {r.doc_id: r for r in suffix_order.remove_repeated_bytes(docs, carry=["doc_id", "lang"]).collect()}
    assert bytes(rows[1].kept).decode() == text and bytes(rows[2].kept) == b"<>" and rows[2].lang == "b"


def test_empty(spark):
    assert suffix_order.remove_repeated_bytes(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_order_is_the_suffix_order():
    rng = np.random.default_rng(1)
    parts = [rng.integers(97, 100, n).astype(np.uint8) for n in (80, 200, 60, 500)]
    parts += [parts[1][20:], np.full(300, 97, np.uint8)]
    text = np.concatenate([np.append(p, 255) for p in parts]).astype(np.uint8)
    segment = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    places = np.concatenate([np.arange(s, s + len(p) - 49) for s, p in zip(segment, parts)])
    raw = text.tobytes()
    order = suffix_order.suffix_order(text, segment, places)
    strings = [raw[p : p + 50] for p in order]
    assert sorted(order.tolist()) == sorted(places.tolist()) and strings == sorted(strings)
