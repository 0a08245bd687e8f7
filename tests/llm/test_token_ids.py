"""Ids of many texts at once against the library, and the coder of the token files."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quadrat.llm import packing, token_files, word_ids

WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    *"abstmdrevlSTMREL'''''\"--..,,019  \t\n\r\x0b\x0c", "'s", "'re", "'ll", "'ve", "'S", "'LL", "é", "É", "ß", "ÿ", "×", "÷", "À", "µ", "中", "🎉", "á",
    "\x00", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", "<|", "<|endoftext|>", "|>", "’", "ſ", "K", "İ",
]


def odd_texts(n):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]
    return [*texts, None, "", "'s", "'", "''", "'s's", "x'", "'l", "'r", "e", "<", "|", "'re" * 5, "ab" * 30_000, "é" * 999]


def split(found):
    ids, ends = found
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_ids_of_many_texts_equal_the_library(monkeypatch):
    """Every kind of byte and border, parts of a few texts, a cache that overflows, sliced batches, long offsets."""
    monkeypatch.setattr(word_ids, "CACHED", 500)
    texts = odd_texts(4000)
    of = word_ids.WordIds(WORDS)
    want = [of.library.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"]).slice(3)
        got = [one for part in word_ids.text_parts(batch, 0, size=3000) for one in split(of.all_ids(part.column(0), 7))]
        assert got == want[3:]
    assert len(of) <= 500 + 3000
    assert split(of.all_ids(pa.array([None, ""], pa.string()), 7)) == [[7], [7]]
    assert split(of.all_ids(pa.array([], pa.string()), 7)) == []


def test_a_new_piece_goes_to_the_library_once():
    """Words that differ in case and signs share their pieces, and pieces share a call."""
    of, calls = word_ids.WordIds(WORDS), []

    class Counting:
        def __init__(self, bare):
            self.bare = bare

        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return self.bare.encode_batch_fast(texts, **options)

    of.bare = Counting(of.bare)
    words = [f"{a}{b}" for a in ("kor", "Kor", "KOR") for b in ("", ".", ",", "!", "?")]
    for _ in range(3):
        of.all_ids(pa.array([" ".join(words)] * 5), 1)
    assert len(calls) == 1 and sorted(calls[0].split()) == ["!", ",", ".", "?", "kor"]


def test_coder_takes_fewer_bits_than_order_0(texts_ids):
    """Each id of a chunk gets its own share, so the coder beats the entropy of single ids even with its weights."""
    counts = np.bincount(texts_ids)
    share = counts[counts > 0] / len(texts_ids)
    size, payloads, sums = token_files.encode_chunk(texts_ids)
    bits = 8 * sum(map(len, payloads)) / len(texts_ids)
    assert bits < -(share * np.log2(share)).sum()
    assert (token_files.decode_chunk(size, len(texts_ids), payloads, sums) == texts_ids).all()


@pytest.fixture(scope="module")
def texts_ids():
    """Three hundred thousand of 200 ids, spread over the vocabulary; a third follow from the id before."""
    rng = np.random.default_rng(8)
    follow = rng.integers(0, 200, 200).tolist()
    ids = [0]
    for known, fresh in zip((rng.random(300_000) < 0.35).tolist(), rng.integers(0, 200, 300_000).tolist()):
        ids.append(follow[ids[-1]] if known else fresh)
    return rng.choice(49_000, 200, replace=False).astype(np.uint16)[ids]


def test_coder_on_extremes():
    rng = np.random.default_rng(4)
    rare = np.zeros(70_000, np.uint16)
    rare[rng.integers(0, 70_000, 900)] = rng.integers(0, 65_536, 900)
    for ids in (rare, np.arange(65_536, dtype=np.uint16), rng.integers(0, 3, 50_000).astype(np.uint16), rng.permutation(np.repeat(np.uint16([1, 65_535]), [69_999, 1]))):
        size, payloads, sums = token_files.encode_chunk(ids)
        assert (token_files.decode_chunk(size, len(ids), payloads, sums) == ids).all()


def test_carries_run_through_many_words():
    """Shares next to the middle of the range keep words of ones open until a carry or its absence settles them."""
    for last in (0.0, 1.0):
        writer = token_files.Writer(1)
        pairs = [(2047.0, 2.0)] + [(1.0, 4095.0)] * 5 + [(2048.0 * last, 2048.0)] * 40
        for start, part in pairs:
            writer.put(np.array([start]), np.array([part]), 12)
        reader = token_files.Reader([np.frombuffer(writer.end()[0], "<u2")])
        for start, part in pairs:
            assert start <= reader.value(1, 12)[0] < start + part
            reader.take(np.array([start]), np.array([part]))


def test_damage_never_gives_other_ids():
    """Only a wrong count of spelt ids can do no harm; all else raises."""
    ids = np.random.default_rng(1).integers(0, 3000, 20_000).astype(np.uint16)
    size, payloads, sums = token_files.encode_chunk(ids)
    assert sums[0] == zlib.crc32(payloads[0])
    for k, payload in enumerate(payloads):
        for at in (0, 1, 2, 3, len(payload) // 2):
            bad = [*payloads[:k], payload[:at] + bytes([payload[at] ^ 255]) + payload[at + 1 :], *payloads[k + 1 :]]
            try:
                got = token_files.decode_chunk(size, len(ids), bad, sums)
                assert k and at in (2, 3) and (got == ids).all()
            except ValueError:
                pass


def test_packing_keeps_every_id_of_odd_texts(spark):
    texts = odd_texts(300)
    of = word_ids.WordIds(WORDS)
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), WORDS, length=64).collect()
    got = {k: b"" for k in range(len(texts))}
    for r in sorted(rows, key=lambda r: r.start):
        got[r.doc_id] += bytes(r.ids)
    assert got == {k: np.array(of.library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for k, t in enumerate(texts)}
