"""Near-duplicate texts by the exact Jaccard similarity of their five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm import simhash
from quadrat.llm.graph import components
from quadrat.llm.shared import discard, free_shuffles, keep_freed_memory, words_of, written

SHINGLE, SEED = 5, 42
#: Least similarity of a link, as a fraction; whole numbers keep the comparison exact.
NUMERATOR, DENOMINATOR = 4, 5
#: Texts whose shingles are counted to put the frequent ones last, and most such shingles. Any order gives the same links.
SAMPLE_ROWS, MOST_FREQUENT = 5000, 200_000
#: Members of a run that are all compared at once; of a larger run, each meets this many pivots first.
SMALL_RUN, PIVOTS = 16, 4
#: Times that the shingles of long runs are moved to the end of the order.
ROUNDS = 2
#: Places of the sketches that pairs are compared by; the broad one is for sets of over ``SKETCH`` members.
SKETCH, BROAD = 1024, 8192
SLICE = 512
PAIRS = 200_000
#: Smallest shingles of a node that its rows carry, to name a pair at one of its common shingles only.
LEAST, NONE = 16, (1 << 63) - 1


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of all 5-word shingles, A-Z lower-cased; fewer than five words are one shingle, no word is none."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words).lower()
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    last = min(SHINGLE, len(words)) - 1
    starts, ends = (end - size)[: len(words) - last].tolist(), end[last:].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with so many common members have at least the wanted similarity."""
    return (DENOMINATOR + NUMERATOR) * common >= NUMERATOR * (a + b)


def slices(n: int) -> int:
    """Slices of a set of n members: the smallest power of two that leaves at most 512 in each on average."""
    return 1 << max(0, (-(-n // SLICE) - 1).bit_length())


def frequent_shingles(rows: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles found in three or more of the sampled texts, and their counts."""
    share = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], ["h"])

    counts = some.mapInArrow(run, "h long").groupBy("h").count().where("count >= 3")
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toPandas()  # bounded
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["count"].to_numpy(np.int64)[order]


def first_shingles(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The prefix of a set: its first n - ceil(0.8 n) + 1 members, the frequent ones last in the order, else by value."""
    names, weights = frequent
    n = len(h)
    weight = np.zeros(n, np.int64)
    if len(names) and n:
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        weight = np.where(names[at] == h, weights[at], 0)
    return h[np.argsort(weight, kind="stable")[: n + NUMERATOR * -n // DENOMINATOR + 1 if n else 0]].view(np.int64)


def marks(rows: DataFrame, key: str, text: str, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``key, digest, n, prefix, sketch, broad, wide`` of every text.

    ``prefix`` holds the first n - ceil(0.8 n) + 1 shingles in one order for all
    texts (frequent ones last, else by value): two sets of similarity 0.8 share
    at least ceil(0.8 n) of the larger one's n shingles, so their prefixes meet.
    ``sketch`` has the parity of the shingles in each of 1,024 places; it differs
    in at most as many places as the sets differ in shingles. ``broad`` is the
    same in 8,192 places, empty for sets of at most 1,024 shingles: in a sketch
    of few places all large sets look alike.
    """
    from hashlib import blake2b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            out = [], [], [], [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t)
                broad = parities(h, BROAD) if len(h) > SKETCH else b""
                for column, value in zip(out, (blake2b(h.tobytes(), digest_size=16).digest(), len(h), first_shingles(h, frequent), parities(h, SKETCH), broad, wide_sketch(h))):
                    column.append(value)
            kinds = pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
            arrays = [batch.column(0), *(pa.array(column, kind) for column, kind in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "digest", "n", "prefix", "sketch", "broad", "wide"])

    plain = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "key long, digest binary, n int, prefix array<long>, sketch binary, broad binary, wide binary")


def settled_prefixes(rows: DataFrame, key: str, text: str, nodes: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``node, prefix`` in an order that puts the shingles of long runs last, by their counts in the prefixes of all nodes.

    A sample only shows shingles of a fixed share of the texts, whose runs grow
    with the input. Shingles only ever move towards the end of the order, so a
    prefix without a moved one stays as it is; the others are taken anew.
    """
    prefixes = nodes.select("node", "prefix")
    moved = np.zeros(0, np.int64)
    for k in range(ROUNDS):
        free_shuffles(rows.sparkSession)
        counts = prefixes.select(F.explode("prefix").alias("hash")).groupBy("hash").count().where(F.col("count") > SMALL_RUN)
        top = counts.orderBy(F.desc("count"), "hash").limit(MOST_FREQUENT + len(moved)).toPandas()  # bounded
        h, count = top["hash"].to_numpy(np.int64), top["count"].to_numpy(np.int64)
        new = ~np.isin(h, moved)
        if not new.any():
            break
        late, moved = np.sort(h[new]), np.concatenate([moved, h[new]])
        names, weights = np.concatenate([h[new].view(np.uint64), frequent[0]]), np.concatenate([count[new] + (1 << 40), frequent[1]])
        names, at = np.unique(names, return_index=True)  # the first of equal names: the moved one
        frequent = names, weights[at]
        old = prefixes

        def parted(has_late: bool, late: np.ndarray = late, old: DataFrame = old) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    lists = batch.column(1)
                    flat = lists.flatten().to_numpy()
                    hit = np.zeros(batch.num_rows, bool)
                    at = np.minimum(np.searchsorted(late, flat), len(late) - 1)
                    hit[pc.list_parent_indices(lists).to_numpy()[late[at] == flat]] = True
                    yield batch.filter(pa.array(hit == has_late))

            return old.mapInArrow(run, "node long, prefix array<long>")

        def again(batches: Iterator[pa.RecordBatch], frequent: tuple[np.ndarray, np.ndarray] = frequent) -> Iterator[pa.RecordBatch]:
            keep_freed_memory()
            for batch in batches:
                first = [first_shingles(shingles(t), frequent) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.list_(pa.int64()))], ["node", "prefix"])

        wanted = written(parted(True).select(F.col("node").alias(key)))
        plain = rows.join(wanted, key, "left_semi").select(F.col(key).alias("node"), F.col(text).cast("string").alias("text"))
        prefixes = written(parted(False).unionByName(plain.mapInArrow(again, "node long, prefix array<long>")))
        discard(wanted, *[old] * (k > 0))
    return prefixes


def distinct_runs(runs: DataFrame) -> DataFrame:
    """The runs (``hash, node, place, size``) without those that have the same nodes as another one.

    One run of several with the same nodes is enough: the filter on places holds
    for every common shingle, so a pair that fails it anywhere is not similar.
    Nodes are compared by 128 bits of their hashes.
    """
    nodes = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    kept = runs.groupBy("hash", "size").agg(*nodes).groupBy("x", "y", "size").agg(F.min("hash").alias("hash"))
    return written(runs.join(kept.select("hash"), "hash", "left_semi"))


def parities(h: np.ndarray, bits: int) -> bytes:
    """Parity of a set's members in each of so many places, a power of two of at least 64."""
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_sketch(h: np.ndarray) -> bytes:
    """Parities of a set in four to eight places a member, a power of two of at least 64; halves fold into one another."""
    return parities(h, max(64, 1 << (4 * len(h)).bit_length()))


def places_apart(x: bytes, y: bytes) -> int:
    """Places in which two wide sketches, folded to the shorter one's length, differ."""
    x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def candidates(placed: DataFrame, all_pairs: bool) -> DataFrame:
    """Pairs ``a, b`` of nodes of one shingle's run that sizes, places and sketches don't rule out.

    With ``all_pairs`` every pair of different components is compared, else
    those of runs of at most 16; members of a larger run meet the run's four
    smallest nodes. A pair is left to the smallest common one of the shingles in
    both nodes' ``least``, whose runs must be compared whole: if it does not pass
    there, it is not similar. Sketches of the length that the texts need rule
    out those that only have a passage in common, so that the pairs that leave
    grow with the similar texts, not with the square of a passage's texts.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()

        def near(run: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            hash_, node, n, place, component, sketch, least, broad = run
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            common = np.minimum(n[x] - place[x], n[y] - place[y]) + np.minimum(place[x], place[y])
            fine = (node[x] != node[y]) & (component[x] != component[y]) & (DENOMINATOR * small >= NUMERATOR * large) & similar(common, n[x], n[y])
            x, y = x[fine], y[fine]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low in range(0, len(x), PAIRS // 16):
                u, v = x[low : low + PAIRS // 16], y[low : low + PAIRS // 16]
                apart = np.bitwise_count(sketch[u] ^ sketch[v]).sum(1, dtype=np.int64)
                fine = similar((n[u] + n[v] - apart) // 2, n[u], n[v])
                u, v = u[fine], v[fine]
                large = np.flatnonzero((n[u] > SKETCH) & (n[v] > SKETCH))
                i, j = u[large], v[large]
                wide = [np.frombuffer(b"".join(broad[at]), np.uint64).reshape(-1, BROAD // 64) for at in (i, j)]
                apart = np.bitwise_count(wide[0] ^ wide[1]).sum(1, dtype=np.int64)
                fine = np.ones(len(u), bool)
                fine[large] = similar((n[i] + n[j] - apart) // 2, n[i], n[j])
                u, v = u[fine], v[fine]
                shared = least[u][:, :, None] == least[v][:, None, :]
                first = ~(shared.any(2) & (least[u] < hash_[u][:, None])).any(1)
                a.append(node[u[first]])
                b.append(node[v[first]])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def paired(run: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Candidates of whole runs, sorted by shingle."""
            starts = np.flatnonzero(np.r_[True, run[0][1:] != run[0][:-1]])
            ends = np.r_[starts[1:], len(run[0])]
            size = ends - starts
            for m in np.unique(size[(size > 1) & (size <= SMALL_RUN)]).tolist():
                i, j = np.triu_indices(m, 1)
                of = starts[size == m]
                step = max(1, PAIRS // len(i))
                for low in range(0, len(of), step):
                    base = of[low : low + step, None]
                    yield from near(run, (base + i).ravel(), (base + j).ravel())
            for low, high in zip(starts[size > SMALL_RUN].tolist(), ends[size > SMALL_RUN].tolist()):
                rows = np.arange(low, high)
                if not all_pairs:
                    for pivot in rows[np.argsort(run[1][rows])[:PIVOTS]].tolist():
                        yield from near(run, rows, np.full(len(rows), pivot))
                    continue
                # Only rows outside the run's largest component, each with all rows that are near in size.
                names, of = np.unique(run[4][low:high], return_inverse=True)
                main = of == np.argmax(np.bincount(of))
                n = run[2][low:high]  # ascending
                left, after = (low + np.searchsorted(n, -(NUMERATOR * -n // DENOMINATOR)), low + np.searchsorted(n, DENOMINATOR * n // NUMERATOR, "right"))
                others = np.flatnonzero(~main)
                step = max(1, PAIRS // len(rows))
                for at in range(0, len(others), step):
                    mine = others[at : at + step]
                    count = after[mine] - left[mine]
                    x = np.repeat(mine + low, count)
                    y = np.repeat(left[mine] - (np.cumsum(count) - count), count) + np.arange(len(x))
                    once = main[y - low] | (y > x)
                    yield from near(run, x[once], y[once])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, SKETCH // 64))
            now.append(batch.column(6).flatten().to_numpy().reshape(-1, LEAST))
            now.append(np.array(batch.column(7).to_pylist(), object))
            if held is not None:
                now = [np.concatenate(c) for c in zip(held, now)]
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            if cut:
                yield from paired([c[:cut] for c in now])
            held = [c[cut:] for c in now]
        if held is not None:
            yield from paired(held)

    rows = placed.select("hash", "node", "n", "place", "component", "sketch", "least", "broad").repartition("hash").sortWithinPartitions("hash", "n", "node")
    return rows.mapInArrow(compare, "a long, b long")


def verified(rows: DataFrame, key: str, text: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have a similarity of 0.8 or more.

    Wide sketches rule out most others. The sets of the rest meet in slices by
    hash of about 512 members, so that no row holds a whole long text.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            apart = np.array([places_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            yield batch.filter(pa.array(similar((n + m - apart) // 2, n, m))).select([0, 1, 2, 3])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingles(t)
                own = slices(len(h))
                # A similar set has 0.8 to 1.25 times as many members, so the larger one's count is the own or the next.
                for count in (own, 2 * own):
                    ends = np.searchsorted(h, np.arange(1, count).astype(np.uint64) << np.uint64(64 - (count.bit_length() - 1))) if count > 1 else []
                    parts = [p.tobytes() for p in np.split(h, ends)]
                    columns = pa.array([node] * count, pa.int64()), pa.array([count] * count, pa.int32()), pa.array(range(count), pa.int32()), pa.array(parts, pa.binary())
                    yield pa.RecordBatch.from_arrays(list(columns), ["node", "slices", "slice", "set"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(k).to_pylist() for k in (2, 3)))
            common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64())], ["a", "b", "common"])

    free_shuffles(rows.sparkSession)
    side = {c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab"}
    open_ = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
    pairs = written(open_.mapInArrow(sift, "a long, b long, n_a int, n_b int"))
    wanted = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).distinct()
    plain = rows.join(wanted, key, "left_semi").select(F.col(key).alias("node"), F.col(text).cast("string").alias("text"))
    found = plain.mapInArrow(sets, "node long, slices int, slice int, set binary")
    found = written(found)
    most = F.greatest("n_a", "n_b")
    # As in ``slices``: the length in binary of the number of full slices before the last.
    full = F.floor((most - 1) / SLICE).cast("long")
    split = pairs.withColumn("slices", F.when(full < 1, 1).otherwise(F.pow(F.lit(2.0), F.length(F.bin(full))).cast("int")))
    both = split.join(found.select(F.col("node").alias("a"), "slices", "slice", F.col("set").alias("x")), ["a", "slices"])
    both = both.join(found.select(F.col("node").alias("b"), "slices", "slice", F.col("set").alias("y")), ["b", "slices", "slice"])
    common = both.select("a", "b", "x", "y").mapInArrow(overlap, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    fine = (DENOMINATOR + NUMERATOR) * F.col("common") >= NUMERATOR * (F.col("n_a") + F.col("n_b"))
    links = written(common.join(pairs, ["a", "b"]).where(fine).select("a", "b"))
    discard(pairs, found)
    return links


def fingerprint_pairs(rows: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes that SimHash links: each with the least node of its fingerprint, and these along the spanning stars."""
    free_shuffles(rows.sparkSession)
    prints = simhash.fingerprints(rows, key, text).withColumnRenamed("key", "node")
    named = written(nodes.select("node").join(prints, "node"))
    heads = written(named.groupBy("fp").agg(F.min("node").alias("head")))
    same = named.join(heads, "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    ends = {c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab"}
    stars = simhash.near_links(heads.select("fp")).join(ends["a"], "a").join(ends["b"], "b")
    both = same.unionByName(stars.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")))
    return written(both.distinct())


def near_copy_groups(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, component_id`` (smallest key) of every text; texts of Jaccard similarity 0.8 or more are linked.

    Similarity is that of the sets of 64-bit hashes of all five-word shingles
    (A-Z lower-cased). Equal sets are one node. SimHash comes first: pairs whose
    fingerprints differ in at most 4 bits are checked on the whole sets and
    linked. It finds most close copies, but a similarity of 0.8 means about ten
    differing bits, so the rest, only of nodes not yet connected, is found by
    prefixes. No link is lost: prefixes of two similar sets meet in some
    shingle, and the filters on sizes, places and sketches only rule out pairs
    that cannot be similar; what is left is checked on the whole sets. Long runs
    are first linked through a few pivots, so that pairs already connected are
    not compared. Texts without words are one node. Keys are distinct whole
    numbers, not null.
    """
    frequent = frequent_shingles(rows, key, text)
    marked = written(marks(rows, key, text, frequent))
    digests = written(marked.select("key", "digest"))
    heads = written(digests.groupBy("digest").agg(F.min("key").alias("node")))

    def of_heads(*columns: str) -> DataFrame:
        return written(marked.select(F.col("key").alias("node"), *columns).join(heads, "node", "left_semi"))

    # Each table goes as soon as nothing reads it: all of them with the shuffles are several times the input.
    free_shuffles(rows.sparkSession)
    nodes = of_heads("n", "sketch", "broad", "wide")
    free_shuffles(rows.sparkSession)
    first = of_heads("prefix")
    discard(marked)
    settled = settled_prefixes(rows, key, text, first, frequent)
    free_shuffles(rows.sparkSession)
    runs = settled.select("node", F.posexplode("prefix").alias("place", "hash"))
    shared = written(runs.withColumn("size", F.count("*").over(W.partitionBy("hash"))).where("size > 1"))
    discard(first, settled)
    free_shuffles(rows.sparkSession)
    runs = distinct_runs(shared)
    discard(shared)
    links = verified(rows, key, text, nodes, fingerprint_pairs(rows, key, text, nodes))

    def placed(runs: DataFrame, whole: DataFrame) -> DataFrame:
        """The runs with what is known of their nodes; ``whole`` are those of them that are compared whole."""
        label = written(components(links))
        free_shuffles(rows.sparkSession)
        least = whole.groupBy("node").agg(F.array_sort(F.collect_list("hash")).alias("least"))
        named = nodes.select("node", "n", "sketch", "broad").join(label, "node", "left").join(least, "node", "left")
        padded = F.concat(F.coalesce("least", F.array().cast("array<long>")), F.array_repeat(F.lit(NONE), LEAST))
        named = named.withColumn("component", F.coalesce("component", "node")).withColumn("least", F.slice(padded, 1, LEAST))
        return runs.join(named, "node")

    short, long_runs = runs.where(F.col("size") <= SMALL_RUN), runs.where(F.col("size") > SMALL_RUN)
    links = links.unionByName(verified(rows, key, text, nodes, written(candidates(placed(runs, short), False).distinct())))
    if not long_runs.isEmpty():
        links = links.unionByName(verified(rows, key, text, nodes, written(candidates(placed(long_runs, long_runs), True).distinct())))
    free_shuffles(rows.sparkSession)
    named = heads.join(components(links), "node", "left")
    named = named.select("digest", F.coalesce("component", "node").alias("component_id"))
    return digests.join(named, "digest").select(F.col("key").alias(key), "component_id")
