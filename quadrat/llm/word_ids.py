"""Token ids of whole texts by a tokenizers file, one piece at a time."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa

from quadrat.llm.shared import words_of

CACHED = 500_000
CALL = 512  # pieces of one call of the library
#: Printable ASCII and the accented letters of Latin-1: composed, and lower-cased letter by letter.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own split pattern, for such text in lower case.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)


def byte_kinds() -> np.ndarray:
    """Kind of each byte; bytes of two-byte letters count as letters, to be looked at again."""
    kinds = np.full(256, ODD, np.uint8)
    kinds[33:127] = SIGN
    kinds[[9, 10, 11, 12, 13, 32]] = BLANK
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    kinds[0x80:0xC0] = kinds[0xC3] = LETTER
    return kinds


KINDS, LOWER = byte_kinds().tobytes(), bytes(range(256)).lower()
BLANKS = b"\t\n\x0b\x0c\r "


def byte_letters() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: visible ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``starts``, run by run."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def text_parts(batch: pa.RecordBatch, column: int, rows: int = 1024, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` and ``size`` bytes of text (or one row), so that what a task holds beside them stays small."""
    ends = text_bytes(batch.column(column))[1][1:]
    low = 0
    while low < batch.num_rows:
        before = int(ends[low - 1]) if low else 0
        high = int(np.searchsorted(ends, before + size, "right"))
        high = min(max(high, low + 1), low + rows, batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and the last ends; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def byte_strings(values: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls; faster than ``to_pylist``."""
    _, ends, data = values.buffers()
    data, ends = data.to_pybytes(), np.frombuffer(ends, np.int32)[: len(values) + 1].tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def cut(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of texts by the tokenizer's split pattern, the pieces before each text, and the marks of odd words.

    A word of plain letters and signs is lower-cased and cut; any other word,
    and one that may hold a special token, is one odd piece as it is.
    """
    raw, size = data.tobytes(), len(data)
    kind, low = (np.frombuffer(bytearray(raw.translate(table)), np.uint8) for table in (KINDS, LOWER))
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        tail = high[data[high] < 0xC0]
        lead = np.maximum(tail - 1, 0)
        fine = (tail > 0) & (data[lead] == 0xC3) & (data[tail] != 0x97) & (data[tail] != 0xB7)
        kind[tail[~fine]] = ODD
        upper = tail[fine & (data[tail] < 0x9F)]
        low[upper] += 32
    inner = at[:-1][at[:-1] < size]  # where a text begins
    start = np.empty(size, bool)  # where a piece or a run of blanks begins
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == DIGIT
    start[inner] = True

    quote = np.flatnonzero(data == 0x27)
    quote = quote[start[quote]]
    if len(quote):
        end = at[np.searchsorted(at, quote, "right")]
        after = np.concatenate([low, np.zeros(3, np.uint8)])
        first, second = after[quote + 1], after[quote + 2]
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < end)
        two = (((first == ord("r")) | (first == ord("v"))) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        two &= quote + 2 < end
        for which, length in ((one, 2), (two, 3)):
            start[quote[which] + 1] = False
            rest = quote[which] + length
            rest = rest[rest < end[which]]
            start[rest[kind[rest] == LETTER]] = True

    odd = np.flatnonzero(kind == ODD)
    maybe = np.flatnonzero(data == 0x3C)
    maybe = maybe[maybe + 1 < size]
    odd = np.concatenate([odd, maybe[data[maybe + 1] == 0x7C]])  # "<|" may begin a special token
    odd_start = np.empty(0, np.int64)
    if len(odd):
        fresh = np.empty(size, bool)  # where a word begins
        solid = kind != BLANK
        fresh[0] = True
        np.logical_not(solid[:-1], out=fresh[1:])
        fresh[inner] = True
        fresh &= solid
        words, gaps = np.flatnonzero(fresh), np.append(np.flatnonzero(~solid), size)
        odd_start = words[np.unique(np.searchsorted(words, odd, "right") - 1)]
        odd_end = np.minimum(gaps[np.searchsorted(gaps, odd_start)], at[np.searchsorted(at, odd_start, "right")])
        inside = spans(odd_start, odd_end - odd_start)
        start[inside] = False
        start[odd_start] = True
        low[inside] = data[inside]

    place = np.flatnonzero(start)
    length, filled = np.diff(place, append=size), kind[place] != BLANK
    place = place[filled]
    offsets = np.append(0, np.cumsum(length[filled])).astype(np.int32)
    shown = low.tobytes().translate(None, BLANKS)
    pieces = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(shown)])
    return pieces, np.searchsorted(place, at), np.searchsorted(place, odd_start)


class WordIds(dict):
    """Piece or odd word -> its ids as little-endian unsigned 16-bit bytes, by the library.

    For tokenizers that lower-case, drop white space and never join across it,
    so a text's ids are its words' ids in a row. Words of plain letters and signs are cut by
    the split pattern, many texts at a time, and each different piece goes to the library's
    model; any other word goes through the whole library call.
    """

    def __init__(self, file: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(file)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.spelling = "".join(self.letters[b] if b >= 0x80 else chr(b) for b in range(256))
        self.bare = Tokenizer(self.model)  # the same model, for pieces between blanks
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.closing = np.zeros(1 << 16, bool)  # ids that end a piece
        self.closing[[i for token, i in self.bare.get_vocab().items() if token.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> bytes:
        shown = word.decode()
        if PLAIN.fullmatch(shown) and not any(s in shown for s in self.special):
            got = b"".join(map(self.piece, PIECES.findall(shown.lower())))
        else:
            got = array("H", self.library.encode(shown, add_special_tokens=False).ids).tobytes()
        return got

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of a plain word."""
        return array("H", [t.id for t in self.model.tokenize(self.spelt(piece))]).tobytes()

    def spelt(self, piece: str) -> str:
        """The piece in the characters of the byte-level vocabulary."""
        return piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))

    def pieces(self, new: list[bytes]) -> list[bytes]:
        """Ids of each of many pieces of plain words, in one call of the library's model."""
        shown = charmap_decode(b" ".join(new), "strict", self.spelling)[0]
        ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(new):  # a vocabulary without closing tokens
            return [self.piece(p.decode()) for p in new]
        data, ends = ids.tobytes(), (2 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def known(self, keys: list[bytes], odd: set[int]) -> list[bytes]:
        """Ids of different pieces; ``odd`` has the places of those that are odd words."""
        got = list(map(self.get, keys))
        missing = [k for k, g in enumerate(got) if g is None]
        for k in odd.intersection(missing):
            got[k] = self[keys[k]]
        plain = [k for k in missing if k not in odd] if odd else missing
        new, ids = [keys[k] for k in plain], []
        for low in range(0, len(new), CALL):
            ids += self.pieces(new[low : low + CALL])
        for k, one in zip(plain, ids):
            got[k] = one
        if len(self) + len(missing) > CACHED:  # frequent pieces came early
            early = list(islice(self.items(), CACHED // 2))
            self.clear()
            self.update(early)
        self.update(zip(new, ids) if max(map(len, new), default=0) <= 48 else [(a, b) for a, b in zip(new, ids) if len(a) <= 48])
        self.update((keys[k], got[k]) for k in odd if len(keys[k]) <= 48)
        return got

    def all_ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """16-bit ids of all texts in a row, each followed by the end id, and where each text's begin and the last's end."""
        data, at = text_bytes(texts)
        if not len(data):
            return np.full(len(texts), end_id, np.uint16), np.arange(len(texts) + 1)
        pieces, before, odd = cut(data, at)
        pieces = pieces.dictionary_encode()
        of = pieces.indices.to_numpy()
        known = self.known(byte_strings(pieces.dictionary), set(of[odd].tolist()))
        flat = np.frombuffer(b"".join(known), "<u2")
        length = np.fromiter(map(len, known), np.int64, len(known)) // 2
        begin, size = (np.cumsum(length) - length)[of], length[of]
        ends = np.concatenate([[0], np.cumsum(size)])[before] + np.arange(len(at))
        out = np.empty(ends[-1], np.uint16)
        inside = np.ones(len(out), bool)
        inside[ends[1:] - 1] = False
        out[ends[1:] - 1] = end_id
        out[inside] = flat[spans(begin, size)]
        return out, ends

    def ids(self, text: str | None, end_id: int) -> bytes:
        """Ids of a text and the end id, 16 bits each, word by word."""
        return b"".join(map(self.__getitem__, words_of(text))) + array("H", [end_id]).tobytes()


@lru_cache(2)
def word_ids(file: str) -> WordIds:
    """One cache per Python worker."""
    return WordIds(file)
