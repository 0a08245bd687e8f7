"""Token ids in compressed files: context mixing and range coding in independent blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.word_ids import text_parts, word_ids

BLOCK = 4096  # ids of a block
CHUNK = 1 << 23  # ids coded side by side, a few bytes of working memory each
SLOTS1, SLOTS2 = 1024, 2048  # of a block's order-1 and order-2 tables
ONE = 12  # bits of the mixing weights
FINE = 20  # bits of the order-0 weights
LEAST, WORD = 2.0**32, 2.0**16  # a coder's width stays in 2**32 to 2**48; all its numbers are whole and below 2**53

CHUNK_SCHEMA = (
    "slot int, chunk int, doc_ids array<{kind}>, lengths array<long>, n_tokens long, "
    "block_tokens int, payloads array<binary>, checksums array<long>"
)


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """Whole weights in proportion to the counts (rows), at least 1 where a count is above 0; a row adds up to ``whole``."""
    counts = counts.astype(np.int64)
    kinds = np.count_nonzero(counts, axis=1)[:, None]
    weights = np.where(counts > 0, counts * (whole - kinds) // np.maximum(counts.sum(1, keepdims=True), 1) + 1, 0)
    rows = np.arange(len(counts))
    weights[rows, counts.argmax(1)] += np.where(kinds[:, 0] > 0, whole - weights.sum(1), 0)
    return weights


def counted(values: np.ndarray, kinds: int) -> np.ndarray:
    """How often each of 0 to ``kinds - 1`` occurs; by parts, as they are widened."""
    flat = values.reshape(-1)
    return sum((np.bincount(flat[low : low + 65536], minlength=kinds) for low in range(0, len(flat), 65536)), np.zeros(kinds, np.int64))


class Mixer:
    """Adaptive model of many blocks side by side, one lane each, all starting afresh.

    Orders 2 and 1 each predict one id from a hashed table with a confidence of
    0 to 3 (an entry is 4 * id + confidence). Their case, 0 to 31, is both
    confidences and whether they agree; it decides how order 2, order 1 and
    order 0, which covers all other ids, share the range. Integers only, so
    reader and writer stay in step.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int64)
        self.off = np.stack([lane * SLOTS2, lane * SLOTS1 + lanes * SLOTS2])  # order 2, then order 1, here and below
        self.at, self.table = self.off, np.zeros(lanes * (SLOTS1 + SLOTS2), np.int32)
        self.last = np.zeros(lanes, np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids predicted by orders 2 and 1 (rows), and their case."""
        self.was = self.table.take(self.at, mode="clip")
        self.sure, self.guess = self.was & 3, self.was >> 2
        return self.guess, self.sure[0] << 3 | self.sure[1] << 1 | (self.guess[0] == self.guess[1])

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """Move both tables towards the ids that came."""
        miss = np.where(self.sure > 0, self.was - 1, ids << 2)
        self.table[self.at] = np.where(hit, np.minimum(self.was + 1, self.was | 3), miss)
        wide = ids.astype(np.int64)
        hashed, self.at = wide * 40503, np.empty_like(self.off)
        np.add(hashed + self.last >> 3 & (SLOTS2 - 1), self.off[0], out=self.at[0])
        np.add(hashed >> 4 & (SLOTS1 - 1), self.off[1], out=self.at[1])
        self.last = wide * 30011


class Writer:
    """Range coders side by side; carries into words already out are settled at the end."""

    def __init__(self, lanes: int):
        self.low, self.width = np.zeros(lanes), np.full(lanes, LEAST * WORD)
        self.words: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, start: np.ndarray, part: np.ndarray, bits: int) -> None:
        """Code a share of the range, out of ``2**bits``, in each of the first lanes."""
        n = len(start)
        low, width = self.low[:n], self.width[:n]
        unit = np.floor(width * 0.5**bits)
        low += unit * start
        np.multiply(unit, part, out=width)
        go = (width < LEAST).nonzero()[0]
        while len(go):
            self.out(go)
            width[go] *= WORD
            go = go[width[go] < LEAST]

    def out(self, lanes: np.ndarray) -> None:
        """Shift one word out; with a carry it has a 17th bit."""
        low = self.low[lanes]
        word = np.floor(low / LEAST)
        self.low[lanes] = (low - word * LEAST) * WORD
        self.words.append((lanes.astype(np.uint16 if len(self.low) <= 1 << 16 else np.int32), word.astype(np.int32)))

    def end(self) -> list[bytes]:
        """The words of each lane."""
        lanes = len(self.low)
        for _ in range(3):
            self.out(np.arange(lanes))
        lane = np.concatenate([a for a, _ in self.words])
        order = np.argsort(lane, kind="stable")
        word, ends = np.concatenate([b for _, b in self.words])[order], np.cumsum(np.bincount(lane, minlength=lanes))
        firsts = np.append(0, ends[:-1])
        while len(over := np.flatnonzero(word >= 1 << 16)):  # a lane's first word has no carry
            word[over] -= 1 << 16
            np.add.at(word, over - 1, 1)
        data = word.astype("<u2").tobytes()
        return [data[a:b] for a, b in zip((2 * firsts).tolist(), (2 * ends).tolist())]


class Reader:
    """Range decoders side by side, in step with ``Writer``."""

    def __init__(self, streams: list[np.ndarray]):
        self.data = np.concatenate([*streams, np.zeros(3, "<u2")])
        self.at = np.cumsum([0, *map(len, streams[:-1])])
        self.code, self.width = np.zeros(len(streams)), np.full(len(streams), LEAST * WORD)
        for _ in range(3):
            self.code = self.code * WORD + self.data.take(self.at, mode="clip")
            self.at += 1

    def value(self, n: int, bits: int) -> np.ndarray:
        """The place in the range, out of ``2**bits``, of each of the first lanes."""
        self.unit = np.floor(self.width[:n] * 0.5**bits)
        return np.minimum(self.code[:n] / self.unit, 2.0**bits - 1).astype(np.int64)

    def take(self, start: np.ndarray, part: np.ndarray) -> None:
        """Leave the share of the range that the value lay in."""
        n = len(start)
        code, width = self.code[:n], self.width[:n]
        code -= self.unit * start
        np.multiply(self.unit, part, out=width)
        go = (width < LEAST).nonzero()[0]
        while len(go):
            at = self.at[go]
            code[go] = code[go] * WORD + self.data.take(at, mode="clip")
            self.at[go] = at + 1
            width[go] *= WORD
            go = go[width[go] < LEAST]


class Weights:
    """Shares of a chunk: of orders 2, 1 and 0 for each case, and of each id that orders 2 and 1 missed.

    Both are learned from the chunk and stand before its blocks.
    """

    def __init__(self, mixing: np.ndarray, order0: np.ndarray):
        self.mixing, self.order0 = mixing, order0
        self.part = mixing.T.ravel().astype(np.float64)  # by 32 * order + case
        self.start = (np.cumsum(mixing, 1) - mixing).T.ravel().astype(np.float64)
        self.part0 = order0.astype(np.float64)
        self.start0 = np.cumsum(self.part0) - self.part0

    def of_event(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of events start, and their sizes."""
        event = event.astype(np.int64)
        return self.start.take(event, mode="clip"), self.part.take(event, mode="clip")

    def of_id(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for ids that orders 2 and 1 missed."""
        ids = ids.astype(np.int64)
        return self.start0.take(ids, mode="clip"), self.part0.take(ids, mode="clip")

    @classmethod
    def learned(cls, events: np.ndarray, missed: np.ndarray) -> Weights:
        """From the counts of events (32 * order + case) and of ids missed."""
        return cls(shares(events.reshape(3, 32).T + 1, 1 << ONE), shares(missed[None], 1 << FINE)[0])

    def stored(self) -> bytes:
        return zlib.compress(self.mixing.astype("<u2").tobytes() + self.order0.astype("<u4").tobytes())

    @classmethod
    def read(cls, data: bytes) -> Weights:
        data = zlib.decompress(data)
        return cls(np.frombuffer(data[:192], "<u2").reshape(32, 3).astype(np.int64), np.frombuffer(data[192:], "<u4").astype(np.int64))


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The weights, then the range-coded ids (lanes x size), each row on its own.

    A block is two streams: which order named each id, and the ids that only
    order 0 names. Before them stand the words of the first and the ids of the second.
    """
    lanes, size = ids.shape
    model, steps = Mixer(lanes), np.ascontiguousarray(ids.T)
    events, (named2, named1, named0) = np.empty((size, lanes), np.uint8), np.array([0, 32, 64], np.uint8)
    for t in range(size):
        now = steps[t].astype(np.int32)
        guess, case = model.predict()
        hit = guess == now
        events[t] = case + np.where(hit[0], named2, np.where(hit[1], named1, named0))
        model.learn(now, hit)
    missed = np.ascontiguousarray((events >= 64).T)  # lanes x size
    rest, many = ids[missed], np.count_nonzero(missed, axis=1)
    weights = Weights.learned(counted(events, 96), counted(rest, 1 << 16))
    named = Writer(lanes)
    for now in events:
        named.put(*weights.of_event(now), ONE)
    order = np.argsort(-many, kind="stable")  # blocks with most ids left first, so those still at work are the first lanes
    first, left = (np.cumsum(many) - many)[order], -many[order]
    spelt = Writer(lanes)
    for t in range(int(many.max())):
        now = rest[first[: np.searchsorted(left, -t)] + t]
        spelt.put(*weights.of_id(now), FINE)
    second = dict(zip(order.tolist(), spelt.end()))
    blocks = [np.array([len(a) // 2, n], "<u2").tobytes() + a + second[k] for k, (a, n) in enumerate(zip(named.end(), many.tolist()))]
    return [weights.stored(), *blocks]


def decode_blocks(payloads: list[bytes], size: int) -> np.ndarray:
    """The ids (lanes x size) that ``encode_blocks`` was given."""
    weights, lanes = Weights.read(payloads[0]), len(payloads) - 1
    blocks = [np.frombuffer(p, "<u2") for p in payloads[1:]]
    named = Reader([b[2 : 2 + int(b[0])] for b in blocks])
    many = np.minimum([int(b[1]) for b in blocks], size)  # more only in a damaged block
    order = np.argsort(-many, kind="stable")
    spelt = Reader([blocks[k][2 + int(blocks[k][0]) :] for k in order.tolist()])
    at = np.cumsum(many) - many
    rest, first, left = np.zeros(int(many.sum()) + 1, np.int32), at[order], -many[order]
    by_place = np.repeat(np.arange(1 << 16, dtype=np.uint16), weights.order0)
    for t in range(int(many.max())):
        n = int(np.searchsorted(left, -t))
        now = by_place.take(spelt.value(n, FINE), mode="clip")
        spelt.take(*weights.of_id(now))
        rest[first[:n] + t] = now
    by_case = np.repeat(np.tile(np.arange(0, 96, 32, dtype=np.uint8), 32) + np.repeat(np.arange(32, dtype=np.uint8), 3), weights.mixing.ravel())
    model, ids = Mixer(lanes), np.empty((size, lanes), np.uint16)
    for t in range(size):
        guess, case = model.predict()
        event = by_case.take((case << ONE) + named.value(lanes, ONE), mode="clip")
        named.take(*weights.of_event(event))
        now = np.where(event < 32, guess[0], guess[1])
        miss = (event >= 64).nonzero()[0]
        place = at[miss]
        now[miss] = rest.take(place, mode="clip")
        at[miss] = place + 1
        ids[t] = now
        model.learn(now, guess == now)
    return np.ascontiguousarray(ids.T)


def encode_chunk(ids: np.ndarray) -> tuple[int, list[bytes], list[int]]:
    """Block size, payloads (the weights first) and checksums (crc32 of the weights, then of a block's 16-bit ids) of a run of ids."""
    size = min(BLOCK, len(ids))
    lanes = -(-len(ids) // size)
    full = np.zeros(lanes * size, np.uint16)
    full[: len(ids)] = ids
    blocks = full.reshape(lanes, size)
    payloads = encode_blocks(blocks)
    return size, payloads, [zlib.crc32(payloads[0]), *(zlib.crc32(b.tobytes()) for b in blocks)]


def decode_chunk(size: int, n: int, payloads: list[bytes], checksums: list[int]) -> np.ndarray:
    """The run of ids of a chunk; raises if the weights' or a block's checksum differs."""
    if zlib.crc32(payloads[0]) != checksums[0]:
        raise ValueError("the weights of a token file are damaged")
    blocks = decode_blocks(payloads, size)
    for k, (block, checksum) in enumerate(zip(blocks, checksums[1:])):
        if zlib.crc32(block.tobytes()) != checksum:
            raise ValueError(f"block {k} of a token file is damaged")
    return blocks.reshape(-1)[:n]


def write_token_files(
    df: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending ``key`` order to ``path``.

    The texts are range-sorted once by key and encoded where they land. A row
    of the files is a chunk: whole documents (ids and lengths), the weights
    learned from it, and their ids in blocks of 4,096, each with its own
    order-1 and order-2 tables, coder and checksum. ``slot`` and ``chunk`` give the order. A null text is its end id alone; null keys come
    first; rows with equal keys stay apart, ordered by a hash of their text; an
    empty table writes no chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, slot, chunk = word_ids(tokenizer_file), TaskContext.get().partitionId(), 0
        names, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            size, payloads, checksums = encode_chunk(np.concatenate(parts))
            columns = [slot], [chunk], [names], [[len(p) for p in parts]], [held], [size], [payloads], [checksums]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields)

        for batch in batches:
            types = [pa.int32(), pa.int32(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            for part in text_parts(batch, 1, 4096, 1 << 23):
                ids, ends = of.all_ids(part.column(1), end_id)
                for name, low, high in zip(part.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    names.append(name)
                    parts.append(ids[low:high])
                    held += high - low
                    if held >= CHUNK:
                        yield close()
                        names, parts, held, chunk = [], [], 0, chunk + 1
        if parts:
            yield close()

    kind = df.schema[key].dataType.simpleString()
    schema = CHUNK_SCHEMA.format(kind=kind)
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    slots = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    by = [F.col("key"), F.xxhash64("text")]
    rows = rows.repartitionByRange(slots, *by).sortWithinPartitions(*by)
    rows.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids`` (32-bit little-endian) of every document in the files.

    ``start`` counts the ids of all documents before it. Every block's checksum is checked.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sums = files.groupBy("slot", "chunk").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("slot", "chunk").rowsBetween(W.unboundedPreceding, 0)
    starts = sums.select("slot", "chunk", (F.sum("n").over(before) - F.col("n")).alias("before"))  # a row per 8 million ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_chunk(row["block_tokens"], row["n_tokens"], row["payloads"], row["checksums"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                for low in range(0, len(ends), 1000):
                    part = slice(low, low + 1000)
                    data = [ids[a:b].tobytes() for a, b in zip(starts[part], ends[part])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][part], batch.schema.field("doc_ids").type.value_type), pa.array(starts[part] + row["before"]), pa.array(row["lengths"][part], pa.int64()), pa.array(data, pa.binary())],
                        ["key", "start", "n_tokens", "ids"],
                    )

    # A chunk is a few MB: one per batch.
    located = files.join(F.broadcast(starts), ["slot", "chunk"])
    return located.mapInArrow(run, f"key {kind}, start long, n_tokens long, ids binary").withColumnRenamed("key", key)
