"""Repeated byte strings: content-addressed shards put into suffix order by prefix-free parsing."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import keep_freed_memory, written
from quadrat.llm.substrings import mixed, runs, spans

#: Length of a repeated string, and of the run of bytes that addresses it.
WINDOW, GRAM = 50, 12
#: Bytes that one task cuts at a time; windows hashed at a time.
CHUNK, BLOCK = 4 << 20, 1 << 16
#: Bytes aimed at in a shard; a shard with more than OVERFULL different bytes is dealt anew, window by window.
#: A task puts about SLICE bytes of its shard in order at a time.
SHARD, OVERFULL, SLICE = 16 << 20, 96 << 20, 4 << 20
#: Most parts that one exchange deals a chunk into.
FAN = 1024
#: Length of a trigger, and one trigger in so many places.
TRIGGER, DENSITY = 6, 16
#: Ends a segment in the parsed text; no UTF-8 text holds it.
END = 255

BASE = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def numbers(x: np.ndarray, kind: str) -> np.ndarray:
    """The whole number that starts at every byte of ``x`` (bytes in the order of ``kind``)."""
    wide = np.dtype(kind).itemsize
    return np.ndarray((max(len(x) - wide + 1, 0),), kind, np.ascontiguousarray(x).data, 0, (1,)).astype(kind[1:])


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the content hash and of its inverse."""
    base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b)])) for b in (base, inverse))


def content(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each span of ``x``."""
    up, down = powers(1 << max(17, int(len(x)).bit_length()))
    total = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[x] * up[: len(x)])])
    return mixed((total[start + size] - total[start]) * down[start] ^ size.astype(np.uint64))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the run of ``GRAM`` bytes that starts at every place."""
    n = len(x) - GRAM + 1
    return mixed(mixed(numbers(x, "<u8")[:n] * LETTERS[1]) + numbers(x, "<u4")[8:][:n].astype(np.uint64) * LETTERS[2])


def cut(x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of a chunk: (first window, number of windows, place of the gram in the first window, gram, content).

    The gram of a window is its smallest hashed run of bytes; a segment is a run
    of windows with one gram, so equal windows always meet at one gram.
    ``inside`` marks the windows that end in their own document.
    """
    bits, reach = np.uint64(17), WINDOW - GRAM + 1
    place = np.arange(BLOCK + reach, dtype=np.uint64)
    out = []
    for begin in range(0, len(x) - WINDOW + 1, BLOCK):
        part = x[begin : begin + BLOCK + WINDOW - 1]
        low = gram_hashes(part) >> bits << bits
        low |= place[: len(low)]
        step = 1
        while step * 2 <= reach:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: len(low) - (reach - step)], low[reach - step :])
        window = np.flatnonzero(inside[begin : begin + len(low)])
        if not len(window):
            continue
        gram = low[window] >> bits
        new = np.ones(len(window), bool)
        new[1:] = (np.diff(window) != 1) | (gram[1:] != gram[:-1])
        head = np.flatnonzero(new)
        first, count = window[head], np.diff(np.append(head, len(window)))
        offset = (low[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) - first
        out.append((first + begin, count, offset, gram[head], content(part, first, count + WINDOW - 1)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(map(np.concatenate, zip(*out)))


def equal_spans(x: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of two spans are the same."""
    if not len(size):
        return np.zeros(0, bool)
    same = x[spans(a, size)] == x[spans(b, size)]
    return np.logical_and.reduceat(same, np.cumsum(size) - size)


def copies(x: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which spans hold the very bytes of one in a document with a smaller key (``key``: their content hash)."""
    order = np.lexsort((doc, key))
    follows = np.zeros(len(order), bool)
    follows[1:] = key[order][1:] == key[order][:-1]
    head = order[np.maximum.accumulate(np.where(follows, 0, np.arange(len(order))))]
    later = np.flatnonzero(doc[order] > doc[head])
    out = np.zeros(len(order), bool)
    a, b = order[later], head[later]
    alike = size[a] == size[b]
    a, b = a[alike], b[alike]
    for part in range(0, len(a), 1 << 14):
        i, j = a[part : part + (1 << 14)], b[part : part + (1 << 14)]
        out[i] = equal_spans(x, start[i], start[j], size[i])
    return out


def two_documents(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a key occurs in two documents or more."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((doc, key))
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    tail = np.append(head[1:], len(order)) - 1
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(doc[order[head]] != doc[order[tail]], tail - head + 1)
    return out


class Segments(dict):
    """``doc, mark, first, windows, offset`` of each segment and their ``bytes`` one after the other."""

    COLUMNS = ("doc", "mark", "first", "windows", "offset")

    @property
    def size(self) -> np.ndarray:
        return self["windows"] + WINDOW - 1

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def take(self, at: np.ndarray) -> "Segments":
        out = Segments({name: self[name][at] for name in self.COLUMNS})
        out["bytes"] = self["bytes"][spans(self.start[at], self.size[at])]
        return out

    @classmethod
    def joined(cls, parts: list["Segments"]) -> "Segments":
        return parts[0] if len(parts) == 1 else cls({name: np.concatenate([p[name] for p in parts]) for name in parts[0]})

    def contents(self) -> np.ndarray:
        """Content hash of each segment, worked out in runs of about a block of bytes."""
        ends = np.cumsum(self.size)
        if not len(ends):
            return np.zeros(0, np.uint64)
        edges = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)), [len(ends)]]))
        start, size, out = self.start, self.size, []
        for a, b in zip(edges[:-1], edges[1:]):
            out.append(content(self["bytes"][start[a] : ends[b - 1]], start[a:b] - start[a], size[a:b]))
        return np.concatenate(out)

    def grams(self) -> np.ndarray:
        """The gram of each segment, from its place in the first window."""
        at = self.start + self["offset"]
        x = self["bytes"][at[:, None] + np.arange(GRAM)].ravel()
        return gram_hashes(x)[::GRAM] >> np.uint64(17)

    def promising(self) -> np.ndarray:
        """Segments that may share a window with another document.

        A window holds its gram and, before it or after it, at least half of the
        other bytes. So equal windows share the gram and one of these sides.
        """
        gram = self.grams()
        side = (WINDOW - GRAM) // 2
        at, out = self.start + self["offset"], np.zeros(len(gram), bool)
        shared = two_documents(gram, self["doc"])
        before = shared & (self["offset"] >= side)
        after = shared & (self["offset"] - self["windows"] + 1 <= side)
        for having, start in ((before, at - side), (after, at + GRAM)):
            k = np.flatnonzero(having)
            x = self["bytes"][start[k][:, None] + np.arange(side)]
            out[k] |= two_documents(mixed(x.astype(np.uint64) @ LETTERS[:side]) ^ gram[k], self["doc"][k])
        return out

    def pack(self) -> bytes:
        """Compressed bytes: keys and marks once per run of segments of a row, number planes apart."""
        import zstandard

        new = np.ones(len(self["doc"]), bool)
        new[1:] = (np.diff(self["doc"]) != 0) | (np.diff(self["mark"]) != 0)
        planes = lambda x, kind: x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()
        parts = [
            len(new), np.packbits(new).tobytes(), planes(np.diff(self["doc"][new], prepend=0), "<i8"), planes(self["mark"][new], "<i4"),
            planes(self["first"], "<u4"), planes(self["windows"], "<u4"), planes(self["offset"], "<u1"), self["bytes"].tobytes(),
        ]
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, 5))

    @classmethod
    def unpack(cls, blob: bytes) -> "Segments":
        import zstandard

        n, new, doc, mark, first, windows, offset, data = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        row = np.cumsum(np.unpackbits(np.frombuffer(new, np.uint8), count=n).astype(np.int64)) - 1

        def whole(raw: bytes, kind: str) -> np.ndarray:
            wide = np.dtype(kind).itemsize
            return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).ravel().astype(np.int64)

        return cls(
            doc=np.cumsum(whole(doc, "<i8"))[row], mark=whole(mark, "<i4")[row], first=whole(first, "<u4"), windows=whole(windows, "<u4"),
            offset=whole(offset, "<u1"), bytes=np.frombuffer(data, np.uint8),
        )


Decided = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def without_copies(s: Segments, contents: np.ndarray | None = None) -> tuple[Segments, Decided]:
    """The segments without copies of one in a smaller document, and the windows of these copies: (doc, mark, first, last)."""
    gone = copies(s["bytes"], s.start, s.size, s.contents() if contents is None else contents, s["doc"])
    done = s["doc"][gone], s["mark"][gone], s["first"][gone], (s["first"] + s["windows"])[gone]
    return (s.take(np.flatnonzero(~gone)) if gone.any() else s), done


def ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the number of smaller ones, from 1, and the places whose key is not alone."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(head + 1, size)
    return out, order[np.repeat(size > 1, size)]


def refined(rank: np.ndarray, tied: np.ndarray, left: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by twice as many symbols, each place's rank and then that ``step`` further if so many are ``left``.

    Only ``tied`` places are sorted anew.
    """
    second = np.zeros(len(tied), np.int64)
    more = left[tied] > step
    second[more] = rank[tied[more] + step]
    own = rank[tied]
    place, still = ranks(own * (len(rank) + 1) + second)
    # Numbers inside the tied places become numbers inside their old group.
    order = np.argsort(place)
    first = np.ones(len(tied), bool)
    first[1:] = own[order][1:] != own[order][:-1]
    base = np.empty(len(tied), np.int64)
    base[order] = np.maximum.accumulate(np.where(first, place[order], 0))
    out = rank.copy()
    out[tied] = own + place - base
    return out, tied[still]


def distinct_phrases(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase the number of its dictionary entry, and for each entry one phrase that spells it."""
    salt = np.uint64(1)
    while True:
        # Hash only to group; every phrase is compared with its entry byte by byte.
        weight = mixed(LETTERS[text] * salt)
        up, down = powers(1 << max(17, int(len(text)).bit_length()))
        total = np.concatenate([[np.uint64(0)], np.cumsum(weight * up[: len(text)])])
        key = (total[start + size] - total[start]) * down[start] ^ size.astype(np.uint64)
        _, entry, number = np.unique(key, return_index=True, return_inverse=True)
        if (size == size[entry][number]).all() and equal_spans(text, start, start[entry][number], size).all():
            return number, entry
        salt += np.uint64(2)


def suffix_order(text: np.ndarray, segment: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` of ``text`` in the order of the first ``WINDOW`` bytes (or more) of their suffixes, by prefix-free parsing.

    ``segment`` holds where segments start; each ends with ``END``. A phrase
    runs from a trigger (a place whose next bytes have a rolling hash divisible
    by ``DENSITY``) or a segment's start through the next trigger. The suffix
    order of the distinct phrases, then that of the sequence of phrases, give
    that of the text: a place goes by its rest of the phrase, and equal rests by
    what the parse has next. No rest longer than a trigger begins another one.
    """
    n = len(text)
    end = np.append(segment[1:], n)
    trigger = mixed((numbers(np.append(text, np.zeros(8, np.uint8)), "<u8")[:n] & np.uint64((1 << 8 * TRIGGER) - 1)) * LETTERS[3])
    cutting = trigger % np.uint64(DENSITY) == 0
    for back in range(1, TRIGGER + 1):  # a trigger lies before its segment's end mark
        cutting[end[end - back >= 0] - back] = False
    cutting[segment] = True
    start = np.flatnonzero(cutting)
    which = np.searchsorted(segment, start, "right") - 1
    final = np.append(which[1:] != which[:-1], True)
    size = np.where(final, end[which], np.append(start[1:], n) + TRIGGER) - start
    number, entry = distinct_phrases(text, start, size)

    # Suffixes of the dictionary, by 7, 14, 28 and 56 bytes; the rest of a phrase that is shorter comes first.
    length = size[entry]
    words = text[spans(start[entry], length)]
    at = np.cumsum(length) - length
    left = np.repeat(at + length, length) - np.arange(len(words))
    seven = np.minimum(left, 7).astype(np.uint64)
    raw = numbers(np.append(words, np.zeros(8, np.uint8)), ">u8")[: len(words)] >> np.uint64(8)
    drop = (np.uint64(7) - seven) * np.uint64(8)
    rank, tied = ranks((raw >> drop << drop) << np.uint64(8) | seven)
    depth = 7
    while depth < WINDOW and (left[tied] > depth).any():
        rank, tied = refined(rank, tied, left, depth)
        depth *= 2

    # Suffixes of the parse, by 1, 2, 4, ... phrases of the same segment.
    tail = np.append(np.flatnonzero(final), len(start))
    left_phrases = tail[np.searchsorted(tail, np.arange(len(start)))] - np.arange(len(start)) + 1
    parse, tied = ranks(rank[at[number]])
    step = 1
    while step < WINDOW and (left_phrases[tied] > step).any():
        parse, tied = refined(parse, tied, left_phrases, step)
        step *= 2

    phrase = np.searchsorted(start, places, "right") - 1
    rest = rank[at[number[phrase]] + places - start[phrase]]
    following = np.where(final[phrase], 0, np.append(parse, 0)[phrase + 1])
    return places[np.argsort(rest * (int(parse.max(initial=0)) + 1) + following)]


def decide(s: Segments) -> Decided:
    """Windows of one shard that also start in a smaller document: runs of (doc, mark, first, last)."""
    s, done = without_copies(s.take(np.flatnonzero(s.promising())))
    if not len(s["doc"]):
        return done
    size = s.size
    text = np.full(int(size.sum()) + len(size), END, np.uint8)
    start = np.cumsum(size + 1) - (size + 1)
    text[spans(start, size)] = s["bytes"]
    windows = s["windows"]
    places = spans(start, windows)
    order = suffix_order(text, start, places)
    # Neighbours in the order are compared byte by byte.
    eight = numbers(np.append(text, np.zeros(8, np.uint8)), "<u8")
    same = np.ones(max(len(order) - 1, 0), bool)
    for step in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        ahead = eight[order + step]
        same &= ahead[1:] == ahead[:-1]
    owner = np.repeat(s["doc"], windows)
    index = np.searchsorted(places, order)
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.repeat(np.minimum.reduceat(owner[index], heads), np.diff(np.append(heads, len(order))))
    smallest = np.empty(len(order), np.int64)
    smallest[index] = least
    segment = np.repeat(np.arange(len(windows)), windows)
    first, last = runs(smallest < owner, segment)
    of = segment[first]
    offset = s["first"][of] - (np.cumsum(windows) - windows)[of]
    got = s["doc"][of], s["mark"][of], first + offset, last + offset
    return tuple(np.concatenate(p) for p in zip(done, got))


#: Rows between the steps: packed segments of a part, or (without ``blob``) a run of windows to remove.
ROWS = "part int, doc long, mark int, first int, last int, blob binary"
NAMES = [f.split(" ")[0] for f in ROWS.split(", ")]


def blob_row(part: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.int32())] * 3, pa.array([blob], pa.binary())], NAMES)


def decided_rows(done: Decided, parts: int = 1) -> pa.RecordBatch:
    """Decisions, spread over the parts."""
    n = len(done[0])
    numbers_ = [pa.array(x.astype(np.int32)) for x in (np.arange(n) % parts, *done[1:])]
    return pa.RecordBatch.from_arrays([numbers_[0], pa.array(done[0], pa.int64()), *numbers_[1:], pa.nulls(n, pa.binary())], NAMES)


def dealt(s: Segments, gram: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Segments packed by the part of their gram."""
    to = (mixed(gram) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(edges)).tolist():
        yield part, s.take(order[edges[part] : edges[part + 1]]).pack()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, lengths, keys, marks) of runs of whole documents."""
    held, total = [], 0
    for batch in batches:
        for part in range(0, batch.num_rows, 256):  # few texts as Python objects at a time
            for doc, text, mark in zip(*(c.to_pylist() for c in batch.slice(part, 256).columns)):
                raw = text.encode()
                if len(raw) < WINDOW:
                    continue
                held.append((doc, raw, mark))
                total += len(raw)
                if total >= CHUNK:
                    yield closed(held)
                    held, total = [], 0
    if held:
        yield closed(held)


def closed(held: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, ...]:
    held.sort(key=lambda h: h[0])
    docs, raws, marks = zip(*held)
    return np.frombuffer(b"".join(raws), np.uint8), np.array(list(map(len, raws))), np.array(docs, np.int64), np.array(marks, np.int64)


def cut_documents(parts: int):
    """Map side: segments of each chunk without its own copies, packed per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for x, lengths, docs, marks in chunks(batches):
            begin = np.cumsum(lengths) - lengths
            inside = np.ones(len(x), bool)
            inside[spans(begin + lengths - (WINDOW - 1), np.full(len(begin), WINDOW - 1))] = False
            first, windows, offset, gram, key = cut(x, inside)
            row = np.searchsorted(begin, first, "right") - 1
            size = windows + WINDOW - 1
            gone = copies(x, first, size, key, docs[row])
            place = first - begin[row]
            if gone.any():
                mask = np.zeros(len(x), bool)  # neighbouring segments as one run
                mask[spans(first[gone], windows[gone])] = True
                a, b = runs(mask, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths))
                r = np.searchsorted(begin, a, "right") - 1
                yield decided_rows((docs[r], marks[r], a - begin[r], b - begin[r]), parts)
            kept = np.flatnonzero(~gone)
            to = (mixed(gram[kept]) % np.uint64(parts)).astype(np.int64)
            kept = kept[np.argsort(to, kind="stable")]
            edges = np.searchsorted(np.sort(to), np.arange(parts + 1))
            for part in np.flatnonzero(np.diff(edges)).tolist():
                k = kept[edges[part] : edges[part + 1]]
                r = row[k]
                s = Segments(doc=docs[r], mark=marks[r], first=place[k], windows=windows[k], offset=offset[k], bytes=x[spans(first[k], size[k])])
                yield blob_row(part, s.pack())

    return run


def finer(parts: int, whole: bool):
    """Between two exchanges: the segments of a part dealt out to its finer parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def close():
            s = Segments.joined(held)
            for part, blob in dealt(s, s.contents() if whole else s.grams(), parts):
                yield blob_row(part, blob)

        for batch in batches:
            yield batch.filter(batch.column("blob").is_null())
            for blob in batch.column("blob").drop_null().to_pylist():
                held.append(Segments.unpack(blob))
                total += len(held[-1]["bytes"])
                if total >= CHUNK:
                    yield from close()
                    held, total = [], 0
        if held:
            yield from close()

    return run


def single_windows(parts: int):
    """Every window of overfull shards as a segment of its own, placed by the hash of the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                s = Segments.unpack(blob)
                windows = spans(np.zeros(len(s["windows"]), np.int64), s["windows"])
                of = np.repeat(np.arange(len(s["windows"])), s["windows"])
                start = s.start
                for a in range(0, len(of), CHUNK // WINDOW):
                    w, o = windows[a : a + CHUNK // WINDOW], of[a : a + CHUNK // WINDOW]
                    one = np.ones(len(o), np.int64)
                    data = s["bytes"][spans(start[o] + w, one * WINDOW)]
                    part = Segments(doc=s["doc"][o], mark=s["mark"][o], first=s["first"][o] + w, windows=one, offset=one * 0, bytes=data)
                    part, done = without_copies(part)
                    yield decided_rows(done, parts)
                    for number, packed in dealt(part, part.contents(), parts):
                        yield blob_row(number, packed)

    return run


def sliced(s: Segments) -> Iterator[np.ndarray]:
    """The segments of a shard in slices; equal windows share a gram, and so a slice."""
    n = -(-len(s["bytes"]) // SLICE)
    to = (mixed(mixed(s.grams())) >> np.uint64(20)) % np.uint64(max(1, n))
    for k in range(n):
        yield np.flatnonzero(to == k)


def search(overfull: int, pass_on: bool):
    """Reduce side: one shard after the other (rows come sorted by part).

    Copies are dropped whenever the segments held grow past half of
    ``overfull``. With ``pass_on`` a shard that still holds more is handed on as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        now, held, total, least, passing = None, [], 0, 0, False

        def close():
            if held and not passing:
                s = Segments.joined(held)
                held.clear()
                for at in sliced(s):
                    yield decided_rows(decide(s.take(at)))
            for s in held if passing else []:
                yield blob_row(now, s.pack())

        for batch in batches:
            yield batch.filter(batch.column("blob").is_null())
            batch = batch.filter(batch.column("blob").is_valid())
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                if part != now:
                    yield from close()
                    now, held, total, least, passing = part, [], 0, 0, False
                held.append(Segments.unpack(blob))
                total += len(held[-1]["bytes"])
                if passing and total >= CHUNK:
                    yield from close()
                    held, total = [], 0
                elif not passing and total > max(overfull // 2, 2 * least):
                    kept, done = without_copies(Segments.joined(held))
                    yield decided_rows(done)
                    held, total = [kept], len(kept["bytes"])
                    least = total
                    passing = pass_on and total > overfull
        yield from close()

    return run


def exchanged(rows: DataFrame, shards: int, whole: bool, fan: int) -> DataFrame:
    """Rows brought together by shard: at once, or by exchanges of at most ``fan`` ways each where shards are many.

    Parts nest: a shard's part is its number modulo the number of parts.
    """
    parts = min(shards, fan)
    while True:
        rows = rows.repartition(parts, "part").sortWithinPartitions("part")
        if parts == shards:
            return rows
        parts = min(parts * fan, shards)
        rows = rows.mapInArrow(finer(parts, whole), ROWS)


def shard_count(size: int, shard: int, fan: int) -> int:
    """Shards for so many bytes of segments: a multiple of the ways of all exchanges but the last."""
    wanted, ways = max(4, -(-size // shard)), fan
    if wanted <= fan:
        return wanted
    while ways * fan < wanted:
        ways *= fan
    return ways * -(-wanted // ways)


def repeated_strings(
    df: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD, overfull: int = OVERFULL, fan: int = FAN
) -> DataFrame:
    """``doc, first, last``, and ``mark`` if keys repeat: runs of windows (by first byte) that also start in a smaller document.

    ``mark`` is the hash of the row's text and tells rows with one key apart.
    See ``remove_repeated_bytes`` for the rules.
    """
    docs = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    repeated = bool(docs.groupBy("doc").count().where("count > 1").limit(1).count())
    docs = docs.withColumn("mark", F.hash("text") if repeated else F.lit(0))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shard_count(int(size * 3.4), shard, fan)
    met = exchanged(docs.mapInArrow(cut_documents(min(shards, fan)), ROWS), shards, False, fan)
    got = written(met.mapInArrow(search(overfull, True), ROWS))
    rest = got.where("blob is not null").agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    done = got.where("blob is null")
    if rest:  # a window takes 50 bytes; packed segments about half of theirs
        shards = shard_count(rest * 2 * WINDOW // 3, shard, fan)
        single = got.where("blob is not null").select("blob").mapInArrow(single_windows(min(shards, fan)), ROWS)
        done = done.unionByName(exchanged(single, shards, True, fan).mapInArrow(search(overfull, False), ROWS))
    return done.select("doc", *(["mark"] if repeated else []), "first", "last")


def remove_repeated_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, **sizes: int) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every row; with ``carry`` also those columns and ``kept``, the bytes left over.

    A text is its UTF-8 bytes. A byte goes if a string of 50 bytes covers it
    that also starts in a document with a smaller key; strings are judged on the
    input and never cross documents. ``n_spans`` counts the maximal runs removed.

    Strings meet at shards addressed by content. A shard's segments are put into
    suffix order by prefix-free parsing, and neighbours in that order are
    compared over 50 bytes, so nothing rests on a hash. Copies of a segment in a
    smaller document are dropped on the way (after a byte-wise comparison). A
    shard with more than ``overfull`` different bytes, as under one very common
    run of bytes, is dealt out again window by window. ``sizes`` are those of
    ``repeated_strings``.

    A null or empty text has no bytes. Rows with a null key keep all bytes and
    count for no other row. Rows with one key never remove bytes from each
    other. A text under 50 bytes is never touched. An empty table gives no row.
    Other columns are ignored. ``key`` must be an integer.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, parts, kept, digest = [], [], [], [], []
            for one, runs_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (one or "").encode()
                n.append(len(raw))
                count = 0
                if runs_:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    first, last = np.array([(r["first"], r["last"] + WINDOW - 1) for r in runs_]).T
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    count = int(np.count_nonzero(np.diff(stays.astype(np.int8), prepend=1) < 0))
                    raw = np.frombuffer(raw, np.uint8)[stays].tobytes()
                removed.append(n[-1] - len(raw))
                parts.append(count)
                kept.append(raw)
                digest.append(hashlib.sha256(raw).hexdigest())
            columns = [*(pa.array(c, pa.int64()) for c in (n, removed, parts)), pa.array(digest, pa.string())]
            if carry:
                columns += [pa.array(kept, pa.binary()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    found = repeated_strings(df, key, text, **sizes)
    on = [c for c in ("doc", "mark") if c in found.columns]
    found = found.groupBy(*on).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    others = [F.col(c).alias(f"other{i}") for i, c in enumerate(carry or [])]
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *others)
    docs = docs.withColumns({"doc": F.col("key").cast("long"), "mark": F.hash("text")})
    joined = docs.join(found, on, "left").select("key", "text", "runs", *[f"other{i}" for i in range(len(others))])
    kind = dict(joined.dtypes)
    schema = f"key {kind['key']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if carry:
        schema = ", ".join([schema, "kept binary", *(f"other{i} {kind[f'other{i}']}" for i in range(len(others)))])
    names = [f.split(" ")[0] for f in schema.split(", ")]
    out = joined.mapInArrow(finish, schema).withColumnRenamed("key", "_key")
    carried = ["kept", *[F.col(f"other{i}").alias(c) for i, c in enumerate(carry)]] if carry else []
    named = [] if carry else [F.col("_key").alias(key)]
    return out.select(*named, "n_bytes", "n_removed", "n_spans", "kept_sha256", *carried)
