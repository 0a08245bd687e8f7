"""Repeated word windows through FM-indexes over content-addressed shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import free_shuffles, keep_freed_memory, words_of, written

WINDOW, GRAM = 13, 5
CHUNK_WORDS = 1_500_000  # words a task cuts into segments at a time
SHARD_WORDS = 3_000_000  # words aimed at in a shard, segments' overlaps included
#: Documents that the frequent words and the crowded grams are estimated on. The
#: first only shorten what is shipped, the second only balance shards.
SAMPLED_DOCS = 5_000
BOOK = (1 << 16) - 1  # words with a two-byte code
SIEVE_BITS = 24  # bits of the map of rows with decisions: at most 4 MB
CACHED = 400_000


class WordHashes(dict):
    """Word -> 40-bit hash, kept for repeated words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        got = xxh64_intdigest(word, 11) >> 24
        if len(word) <= 48:
            if len(self) >= CACHED:
                self.clear()
            self[word] = got
        return got


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


GRAM_FACTORS, WINDOW_FACTORS = odd_numbers(GRAM, 1), odd_numbers(WINDOW, 2)
BASE = odd_numbers(1, 3)[0]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def rolling(words: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash of every run of ``len(factors)`` words."""
    n = len(words) - len(factors) + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j, f in enumerate(factors):
        total += words[j : j + n] * f
    return mixed(total)


def segments(words: np.ndarray, lengths: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cut documents into segments: (first window, number of windows, gram) by place in ``words``.

    The gram of a window is the smallest hash of its 5-word runs. A segment is a
    run of windows with one gram, so equal windows always meet at the same gram.
    Windows of a crowded gram are segments of one window each, placed by the
    hash of the whole window.
    """
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    low = rolling(words, GRAM_FACTORS)
    for step in (1, 2, 4):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:-1], rolling(words, GRAM_FACTORS)[8:])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = doc[: len(low)] == doc[WINDOW - 1 :]
    window = np.flatnonzero(inside)
    gram = low[window]
    crowded = np.isin(gram, hot)
    gram = np.where(crowded, rolling(words, WINDOW_FACTORS)[window], gram)
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(window) != 1) | (gram[1:] != gram[:-1]) | crowded[1:]
    first = np.flatnonzero(new)
    return window[first], np.diff(np.append(first, len(window))), gram[first]


def segment_grams(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gram of each segment, from its first window."""
    every = rolling(words, GRAM_FACTORS)
    low = every[at]
    for step in range(1, WINDOW - GRAM + 1):
        low = np.minimum(low, every[at + step])
    return low


def content_keys(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each segment's word sequence."""
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=1)), BASE)]))
    at = spans(first, size)
    weight = power[spans(np.zeros(len(size), np.int64), size)]
    starts = np.cumsum(size) - size
    total = np.add.reduceat(mixed(words[at]) * weight, starts) if len(size) else np.zeros(0, np.uint64)
    return mixed(total ^ size.astype(np.uint64))


class FMIndex:
    """FM-index over integer sequences joined by zeros; symbols are 1 to ``sigma``.

    Suffixes are sorted by their first 16 symbols, enough for patterns of up to
    16. The last column is kept in a wavelet matrix of packed bits with a count
    for every 64.
    """

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        rank = text.astype(np.int64)
        for step in (1, 2, 4, 8):
            second = np.zeros(n, np.int64)
            second[:-step] = rank[step:] + 1
            key = rank * (second.max() + 1) + second
            order = np.argsort(key)
            sorted_ = key[order]
            rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        self.suffixes = order
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.depth = max(1, int(sigma).bit_length())
        column = text[order - 1].astype(np.int64)
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bit = (column >> level & 1).astype(np.uint8)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            packed = packed.view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = n - int(bit.sum())
            self.levels.append((packed, counts, zeros))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        # Where the run of each symbol begins after all levels.
        self.base = self.down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Follow places in the last column down to the symbol's own run."""
        for level, (packed, counts, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            word = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(packed[word] & mask)
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """One backward step: where suffixes ``symbol`` + (suffixes before ``place``) end."""
        return self.before[symbol] + self.down(symbol, place) - self.base[symbol]


def matching(index: FMIndex, text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics of streamed text: for each end, (length, low, high).

    Length is how far the words up to ``ends`` can be followed backwards, at
    most ``longest``, with more than one occurrence in the index; low and high
    bound the suffixes that start with the match.
    """
    length, low, high = (np.zeros(len(ends), np.int64) for _ in range(3))
    live = np.arange(len(ends))
    symbol = text[ends]
    lo, hi = index.before[symbol], index.before[symbol + 1]
    for step in range(longest):
        if step:
            symbol = text[ends[live] - step]
            lo, hi = index.extend(symbol, lo), index.extend(symbol, hi)
        more = hi - lo > 1
        live, lo, hi = live[more], lo[more], hi[more]
        length[live], low[live], high[live] = step + 1, lo, hi
    return length, low, high


def earlier_windows(words: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every window of the distinct segments (``size`` words each), the smallest owner of a segment that has it."""
    values, symbol = np.unique(words, return_inverse=True)
    symbol += 1
    wide = size + 1
    text = np.zeros(int(wide.sum()), np.int64)
    first = np.cumsum(wide) - wide
    text[spans(first, size)] = symbol
    index = FMIndex(text, len(values))
    windows = size - WINDOW + 1
    starts = spans(first, windows)
    length, low, high = matching(index, text, starts + WINDOW - 1, WINDOW)
    least = np.repeat(owner, windows)
    full = length == WINDOW
    if full.any():
        of_place = np.repeat(owner, wide)[index.suffixes]
        lows, where = np.unique(low[full], return_index=True)
        highs = high[full][where]
        bounds = np.stack([lows, highs], 1).ravel()
        smallest = np.minimum.reduceat(np.append(of_place, np.iinfo(np.int64).max), bounds)[::2]
        least[full] = smallest[np.searchsorted(lows, low[full])]
    return least


def runs(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of runs of true values inside a group."""
    edge = np.ones(len(mask) + 1, bool)
    edge[1:-1] = (mask[1:] != mask[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(edge)
    first, last = at[:-1], at[1:]
    keep = mask[first] if len(mask) else np.zeros(0, bool)
    return first[keep], last[keep]


class Book:
    """Two-byte codes of frequent words; any other word is shipped as its 40-bit hash."""

    def __init__(self, frequent: np.ndarray):
        """``frequent``: hashes, the most frequent first, so that small codes abound."""
        self.order = np.argsort(frequent, kind="stable")
        self.sorted = frequent[self.order]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Code of each word, 0 for a rare one."""
        if not len(self.sorted):
            return np.zeros(len(hashes), np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at] + 1, 0).astype(np.uint16)


def symbols(codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Words as 64-bit numbers, made from what is shipped: the codes, and the hashes of the words without."""
    out = codes.astype(np.uint64)
    out[codes == 0] = rare + np.uint64(1 << 16)
    return mixed(out * np.uint64(0xD6E8FEB86659FD93))


class Blob:
    """Segments of one chunk for one shard, and windows already decided, as compressed bytes.

    Per document row: key, mark, first place in the chunk. Per segment: row and
    first place (as steps from the one before), number of words. All words'
    codes, then the rare ones' hashes in a four-byte and a one-byte plane.
    """

    FIELDS = (
        ("doc", "<i8"), ("mark", "<i4"), ("begin", "<u4"), ("row", "<u4"), ("first", "<u4"), ("size", "<u4"), ("code", "<u2"),
        ("rare_low", "<u4"), ("rare_high", "<u1"), ("done_doc", "<i8"), ("done_mark", "<i4"), ("done_first", "<i4"), ("done_last", "<i4"),
    )

    @classmethod
    def pack(cls, **fields: np.ndarray) -> bytes:
        import zstandard

        parts = [np.ascontiguousarray(fields[name], kind) for name, kind in cls.FIELDS]
        sizes = np.array([p.nbytes for p in parts], "<i8").tobytes()
        # The codes' low and high bytes apart pack better.
        planes = [p.view(np.uint8).reshape(-1, 2).T.tobytes() if name == "code" else p.tobytes() for p, (name, _) in zip(parts, cls.FIELDS)]
        return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))

    @classmethod
    def unpack(cls, blob: bytes) -> dict[str, np.ndarray]:
        """The fields, with segments' ``doc``, ``mark`` and ``first`` (in the document) and words as symbols."""
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(blob)
        sizes = np.frombuffer(data, "<i8", len(cls.FIELDS))
        at = sizes.nbytes
        f = {}
        for (name, kind), size in zip(cls.FIELDS, sizes.tolist()):
            f[name] = np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at)
            at += size
        code = np.ascontiguousarray(f["code"].view(np.uint8).reshape(2, -1).T).view("<u2").ravel()
        row = np.cumsum(f["row"], dtype=np.int64)
        first = np.cumsum(f["first"], dtype=np.int64) - f["begin"][row].astype(np.int64)
        rare = f["rare_high"].astype(np.uint64) << np.uint64(32) | f["rare_low"]
        segments_ = {"doc": f["doc"][row], "mark": f["mark"][row], "first": first, "size": f["size"].astype(np.int64)}
        return segments_ | {"words": symbols(code, rare)} | {k: v for k, v in f.items() if k.startswith("done_")}


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(40-bit word hashes, and numbers of words, keys and marks of documents) of runs of whole documents."""
    hashes = WordHashes()
    parts, lengths, docs, marks, held = [], [], [], [], 0

    def close():
        return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array(lengths, np.int64), np.array(docs, np.int64), np.array(marks, np.int64)

    for batch in batches:
        for doc, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
            words = words_of(text)
            parts.append(np.array(list(map(hashes.__getitem__, words)), np.uint64))
            lengths.append(len(words))
            docs.append(doc)
            marks.append(mark)
            held += len(words)
            if held >= CHUNK_WORDS:
                yield close()
                parts, lengths, docs, marks, held = [], [], [], [], 0
    if docs:
        yield close()


def cut(shards: int, frequent: np.ndarray, hot: np.ndarray):
    """Map side: segments of each chunk, packed per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        book = Book(frequent)
        for hashes, lengths, docs, marks in chunks_of(batches):
            start = np.cumsum(lengths) - lengths
            codes = book.codes(hashes)
            words = symbols(codes, hashes[codes == 0])
            first, windows, gram = segments(words, lengths, hot)
            row = np.searchsorted(start, first, "right") - 1
            size = windows + WINDOW - 1
            content = content_keys(words, first, size)
            order = np.lexsort((docs[row], content))
            same = np.zeros(len(order), bool)
            same[1:] = content[order][1:] == content[order][:-1]
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            least = np.empty(len(order), np.int64)
            least[order] = docs[row][order[head]]
            copied = docs[row] > least  # the same segment is in a smaller document of this chunk
            mask = np.zeros(len(words), bool)
            mask[spans(first[copied], windows[copied])] = True
            done_first, done_last = runs(mask, np.repeat(np.arange(len(lengths)), lengths))
            done_row = np.searchsorted(start, done_first, "right") - 1
            kept = np.flatnonzero(~copied)
            to = (gram[kept] >> np.uint64(8)) % np.uint64(shards)
            by_shard = np.argsort(to, kind="stable")
            kept, to = kept[by_shard], to[by_shard]
            bound = np.searchsorted(to, np.arange(shards + 1).astype(np.uint64))
            done_to = done_row % shards
            for shard in range(shards):
                k = kept[bound[shard] : bound[shard + 1]]
                d = np.flatnonzero(done_to == shard)
                if not len(k) and not len(d):
                    continue
                rows, place = np.unique(row[k], return_inverse=True)
                at, dr = spans(first[k], size[k]), done_row[d]
                code, rare = codes[at], hashes[at[codes[at] == 0]]
                blob = Blob.pack(
                    doc=docs[rows], mark=marks[rows], begin=start[rows], row=np.diff(place, prepend=0), first=np.diff(first[k], prepend=0),
                    size=size[k], code=code, rare_low=rare & np.uint64(0xFFFFFFFF), rare_high=rare >> np.uint64(32),
                    done_doc=docs[dr], done_mark=marks[dr], done_first=done_first[d] - start[dr], done_last=done_last[d] - start[dr],
                )
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    return run


def decide(blobs: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Repeated windows of one shard: (doc, mark, first, last) of runs of windows to remove."""
    f = {name: np.concatenate([b[name] for b in blobs]) for name in blobs[0]}
    out = [(f["done_doc"], f["done_mark"], f["done_first"], f["done_last"])]
    size = f["size"]
    at = np.cumsum(size) - size
    f["gram"] = segment_grams(f["words"], at)
    # Only grams that two documents share can repeat a window.
    order = np.lexsort((f["doc"], f["gram"]))
    gram, doc = f["gram"][order], f["doc"][order]
    head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(gram)) - 1
    shared = np.repeat(doc[head] != doc[tail], tail - head + 1)
    pick = order[shared]
    if len(pick):
        content = content_keys(f["words"], at[pick], size[pick])
        order = np.lexsort((f["doc"][pick], content))
        by, content = pick[order], content[order]
        new = np.concatenate([[True], content[1:] != content[:-1]])
        distinct, which = by[new], np.cumsum(new) - 1
        words = f["words"][spans(at[distinct], size[distinct])]
        least = earlier_windows(words, size[distinct], f["doc"][distinct])
        windows = size[distinct] - WINDOW + 1
        window_at = np.cumsum(windows) - windows
        count = windows[which]
        all_least = least[spans(window_at[which], count)]
        segment = np.repeat(np.arange(len(by)), count)
        removed = all_least < f["doc"][by][segment]
        first, last = runs(removed, segment)
        s = segment[first]
        offset = f["first"][by][s] - (np.cumsum(count) - count)[s]
        out.append((f["doc"][by][s], f["mark"][by][s], first + offset, last + offset))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: index and search one shard after the other (rows come sorted by shard)."""
    keep_freed_memory()
    now, held = None, []

    def close() -> pa.RecordBatch:
        doc, mark, first, last = decide([Blob.unpack(b) for b in held])
        columns = pa.array(doc, pa.int64()), pa.array(mark, pa.int32()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))
        return pa.RecordBatch.from_arrays(list(columns), ["doc", "mark", "first", "last"])

    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != now and held:
                yield close()
                held = []
            now = shard
            held.append(blob)
    if held:
        yield close()


def frequent(docs: DataFrame, rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The 65,535 most frequent words' hashes, and the grams that would fill more than a quarter of a shard.

    Estimated on about 5,000 documents, chosen by hash. There are at most
    ``4 * shards`` such grams by construction. Neither list changes what is found.
    """
    part = max(1, rows // SAMPLED_DOCS)
    some = written(docs.where(F.pmod(F.xxhash64("doc"), F.lit(part)) == 0))

    def tally(values: np.ndarray, gram: bool) -> pa.RecordBatch:
        value, n = np.unique(values, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n), pa.array(np.full(len(n), gram))], ["value", "n", "gram"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, *_ in chunks_of(batches):
            yield tally(hashes, False)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(known)
        for hashes, lengths, _, _ in chunks_of(batches):
            codes = book.codes(hashes)
            yield tally(segments(symbols(codes, hashes[codes == 0]), lengths, np.zeros(0, np.uint64))[2], True)

    def totals(step) -> DataFrame:
        return some.mapInArrow(step, "value long, n long, gram boolean").groupBy("value").agg(F.sum("n").alias("n"))

    known = totals(words).where("n > 1").orderBy(F.desc("n"), "value").limit(BOOK).collect()
    known = np.array([r.value for r in known], np.int64).view(np.uint64)
    counts = written(totals(grams).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    crowded = counts.where(F.col("n") >= max(16, total / (4 * shards))).collect()
    return known, np.array([r.value for r in crowded], np.int64).view(np.uint64)


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, mark, first, last``: runs of 13-word windows (by first word) whose words also start in a smaller document.

    ``mark`` is the hash of the row's text: rows with one key and text share
    their decisions. See ``remove_repeats`` for the rules.
    """
    docs = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), F.hash(text).alias("mark")
    )
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(4, int((size or 0) / 6.4 * 3.4 / SHARD_WORDS))
    blobs = docs.mapInArrow(cut(shards, *frequent(docs, rows, shards)), "shard int, blob binary")
    return blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(search, "doc long, mark int, first int, last int")


def place() -> Column:
    """Bit of the row ``doc, mark`` in the map of decided rows; it depends on nothing else."""
    return F.pmod(F.xxhash64(F.col("doc").cast("long"), F.col("mark").cast("int")), F.lit(1 << SIEVE_BITS))


def decided(runs: DataFrame) -> DataFrame:
    """``word, bits``: bit map of the rows that have decisions.

    At most ``2^(SIEVE_BITS - 6)`` rows of 16 bytes at every input size. A full
    map only means that more texts go through the join.
    """
    bits = runs.select(place().alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit")
    )
    return bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every document; with ``carry`` also those columns and ``kept``.

    ``kept`` is the text left over: the kept words joined by blanks, or the text itself if none goes.

    A word goes if a window of 13 consecutive words covers it whose sequence
    also starts in a document with a smaller key; windows are judged on the
    input. ``kept_sha256`` is of the kept words joined by one space.

    Windows meet at shards addressed by content, so each is looked up in one
    FM-index. Segments equal to one in a smaller document of the same chunk are
    decided on the spot, and equal segments are indexed once per shard, so a
    large group of copies stays small.

    A null or empty text has no words. Rows with a null key keep all words and
    count for no other row. Rows with one key never remove words from each
    other. A text under 13 words is never touched. An empty table gives no row.
    Other columns are ignored. ``key`` must be an integer.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept, digest = [], [], [], []
            for one, runs_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(one)
                n.append(len(words))
                if runs_:
                    edge = np.zeros(len(words) + 1, np.int64)
                    first, last = np.array([(r["first"], r["last"] + WINDOW - 1) for r in runs_]).T
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                joined = b" ".join(words)
                removed.append(n[-1] - len(words))
                kept.append(joined.decode() if runs_ else one)
                digest.append(hashlib.sha256(joined).hexdigest())
            columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            if carry:
                columns += [pa.array(kept, pa.string()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    runs = written(repeated_windows(df, key, text))
    free_shuffles(df.sparkSession)
    found = runs.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    others = [F.col(c).alias(f"other{i}") for i, c in enumerate(carry or [])]
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *others)
    docs = docs.withColumns({"doc": F.col("key").cast("long"), "mark": F.hash("text")})
    # Only texts that may have decisions are shuffled to them.
    bit = F.call_function("shiftright", "bits", (place() % 64).cast("int")).bitwiseAND(F.lit(1))
    docs = docs.withColumn("word", F.shiftright(place(), 6)).join(F.broadcast(decided(runs)), "word", "left")
    docs = docs.withColumn("asked", F.coalesce(bit == 1, F.lit(False))).drop("word", "bits")
    columns = ["key", "text", "runs", *[f"other{i}" for i in range(len(others))]]
    asked = docs.where("asked").join(found, ["doc", "mark"], "left").select(*columns)
    passed = docs.where("NOT asked").withColumn("runs", F.lit(None).cast(asked.schema["runs"].dataType)).select(*columns)
    kind = dict(asked.dtypes)
    schema = f"key {kind['key']}, n_words long, n_removed long, kept_sha256 string"
    if carry:
        schema = ", ".join([schema, "kept string", *(f"other{i} {kind[f'other{i}']}" for i in range(len(others)))])
    names = [f.split(" ")[0] for f in schema.split(", ")]
    out = passed.mapInArrow(finish, schema).unionAll(asked.mapInArrow(finish, schema))
    if not carry:
        return out.withColumnRenamed("key", key)
    return out.select("n_words", "n_removed", "kept_sha256", "kept", *[F.col(f"other{i}").alias(c) for i, c in enumerate(carry)])
