"""SimHash near-duplicates through covering-code anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.graph import components, star_edges
from quadrat.llm.shared import keep_freed_memory, words_of, written

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: First bit and width of the three blocks of a fingerprint. Two fingerprints at
#: four or fewer differing bits differ in at most one bit of some block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Homes of one anchor that a task compares at a time; more are dealt over splits.
MOST_HOMES = 4096
PAIRS = 500_000


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all 4-word shingles, as a signed number.

    A-Z are lower-cased; fewer than four words are one shingle; no word gives zero.
    """
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    last = min(SHINGLE, len(words)) - 1
    starts, ends = (end - size)[: len(words) - last].tolist(), end[last:].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[low : low + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` of every whole text, in place; a null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    plain = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, f"key {kind}, fp long")


def block_anchors(values: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Anchors near each block value: (row numbers, anchors, whether the anchor is the value's home).

    The anchors are the words whose lowest 15 bits form a Hamming codeword and
    whose other bits are free: a code of covering radius 1 (15 = 2**4 - 1, so
    the syndrome names the one bit to flip). A value's home is its nearest
    anchor; it also visits all anchors within 1 + 1 bits, which are, by the
    number of flipped free bits: 0 - the home and, if that is one bit away, the
    seven codewords two bits away; 1 - the nearest codeword if any is within
    one bit, that is always; 2 - only if the low part is a codeword itself.
    """
    syndrome = np.zeros(len(values), np.int64)
    for bit in range(15):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    flip = np.where(syndrome > 0, np.left_shift(1, np.maximum(syndrome - 1, 0)), 0)
    home = values ^ flip
    every = np.arange(len(values))
    yield every, home, True
    off = np.flatnonzero(syndrome)
    for i in range(1, 16):
        j = syndrome[off] ^ i
        rows = off[j > i]
        yield rows, values[rows] ^ (1 << (i - 1)) ^ np.left_shift(1, j[j > i] - 1), False
    free = range(15, width)
    for i in free:
        yield every, home ^ (1 << i), False
    on = np.flatnonzero(syndrome == 0)
    for i in free:
        for j in range(i + 1, width):
            yield on, values[on] ^ (1 << i) ^ (1 << j), False


def near_links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` at ``threshold`` (4) or fewer differing bits.

    Every fingerprint goes to its home anchor and to the anchors it visits, in
    each of three blocks; per anchor the homes are compared with the visitors on
    all 64 bits. If two fingerprints differ in at most one bit of a block, each
    visits the other's home, so no link is lost. Of the links found side by side
    only a spanning star is kept. An anchor with more than 4,096 homes is split:
    homes are dealt out, visitors go to every split and are streamed.
    """
    if threshold > len(BLOCKS) + 1:
        raise ValueError("three blocks at radius one cover at most 4 differing bits")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for b, (first, width) in enumerate(BLOCKS):
                values = (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
                for rows, anchors, home in block_anchors(values, width):
                    for visit in (0, 1) if home else (1,):
                        columns = (anchors * 4 + b).astype(np.int32), np.full(len(rows), visit, np.int8), fp[rows]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "visit", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # homes of the group that the last batch ended in
        for batch in batches:
            group = batch.column(0).to_numpy().astype(np.int64) << 20 | batch.column(1).to_numpy()
            visit, fp = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            homes = visit == 0
            home_group, home_fp = np.concatenate([held[0], group[homes]]), np.concatenate([held[1], fp[homes]])
            guest_group, guest_fp = group[~homes], fp[~homes]
            from_ = np.searchsorted(home_group, guest_group, "left")
            count = np.searchsorted(home_group, guest_group, "right") - from_
            found = [], []
            total = np.cumsum(count)
            low = 0
            while low < len(count):
                high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
                c = count[low:high]
                guest = np.repeat(np.arange(low, high), c)
                home = np.repeat(from_[low:high] - (np.cumsum(c) - c), c) + np.arange(len(guest))
                x, y = guest_fp[guest], home_fp[home]
                near = (np.bitwise_count((x ^ y).view(np.uint64)) <= threshold) & (x != y)
                if near.any():
                    names, place = np.unique(np.concatenate([x[near], y[near]]), return_inverse=True)
                    half = len(place) // 2
                    far, root = star_edges(names, place[:half], place[half:])
                    found[0].append(far)
                    found[1].append(root)
                low = high
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], ["a", "b"])
            if len(group):
                last = home_group == group[-1]
                held = home_group[last], home_fp[last]

    placed = fps.select("fp").mapInArrow(replicate, "anchor int, visit byte, fp long")
    # At most 2**24 anchors exist, whatever the input; the crowded ones are far fewer.
    homes = fps.select("fp").mapInArrow(replicate, "anchor int, visit byte, fp long").where("visit = 0")
    crowded = homes.groupBy("anchor").count().where(F.col("count") > MOST_HOMES)
    crowded = written(crowded.select("anchor", F.ceil(F.col("count") / MOST_HOMES).cast("int").alias("splits")))
    dealt = placed.join(F.broadcast(crowded), "anchor", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    one = F.array(F.pmod(F.xxhash64("fp"), "splits").cast("int"))
    dealt = dealt.withColumn("split", F.explode(F.when(F.col("visit") == 0, one).otherwise(F.sequence(F.lit(0), F.col("splits") - 1))))
    dealt = dealt.select("anchor", "split", "visit", "fp").repartition("anchor", "split")
    return dealt.sortWithinPartitions("anchor", "split", "visit").mapInArrow(compare, "a long, b long")


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, fingerprint`` (16 hex digits) ``, component_id`` of every document.

    Documents whose fingerprints differ in at most 4 bits are linked; a
    component is named by its smallest key. Equal fingerprints are one node, so
    a large group of copies costs one row. A null text counts as empty (zero
    fingerprint, linked like any other). A null key gets a row and can be in a
    component but never names one unless all its keys are null. Repeated rows
    are kept. An empty table gives no row. Other columns are ignored.
    """
    marked = written(fingerprints(df, key, text))
    fps = written(marked.groupBy("fp").agg(F.min("key").alias("least")))
    found = components(near_links(fps))
    named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return marked.join(label, "fp").select(
        F.col("key").alias(key), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
