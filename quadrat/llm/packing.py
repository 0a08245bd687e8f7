"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import running_start, written
from quadrat.llm.word_ids import text_parts, word_ids

BUCKETS, DIMENSIONS, BITS = 1024, 3, 10


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[bytes]) -> np.ndarray:
    """Hilbert key of each list of ids.

    Ids are hashed into 1,024 buckets; the square roots of the counts, scaled to
    length one, are projected to three normal coordinates and put on a grid.
    """
    directions = np.random.default_rng(17).standard_normal((BUCKETS, DIMENSIONS))
    bags = np.empty((len(ids), BUCKETS))
    for k, one in enumerate(ids):
        at = np.frombuffer(one, "<u2").astype(np.uint32) * np.uint32(2654435761) >> np.uint32(22)
        bags[k] = np.bincount(at, minlength=BUCKETS)
    bags = np.sqrt(bags)
    bags /= np.maximum(np.linalg.norm(bags, axis=1, keepdims=True), 1e-9)
    grid = np.clip((np.einsum("ij,jk->ik", bags, directions) + 3) * (2**BITS / 6), 0, 2**BITS - 1)
    return hilbert_key(grid.astype(np.int64), BITS)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what a task holds beside them stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def pack(
    df: DataFrame, tokenizer_file: str, end_id: int = 1, length: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces ``key, start, length, doc_tokens, sequence_id, offset, ids`` (32-bit little-endian) of all documents.

    Documents follow one another by Hilbert key, then ``key``; the stream is cut
    every ``length`` ids, so all sequences but the last are full. Row sizes
    (not ids) are range-sorted to get each document's place in the stream; ids
    are written once and meet their place in one equi-join on a unique number.

    A null or empty text is its end id alone. Rows with equal or null keys are
    documents of their own. An empty table gives no piece. A document longer
    than a sequence gives as many pieces as it needs. Other columns are ignored.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_ids(tokenizer_file)
        for batch in batches:
            for part in text_parts(batch, 1):
                flat, ends = of.all_ids(part.column(1), end_id)
                data, at = flat.tobytes(), (2 * ends).tolist()
                ids = [data[a:b] for a, b in zip(at, at[1:])]
                columns = [part.column(0), pa.array(ids, pa.binary()), pa.array(np.diff(ends), pa.int64()), pa.array(curve_keys(ids))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "n", "curve"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in sliced(batches):
            keys, n = batch.column(0), batch.column(2).to_numpy()
            place = batch.column(3).to_numpy()
            first, last = place // length, (place + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low = np.maximum(sequence * length, place[row])
            high = np.minimum((sequence + 1) * length, (place + n)[row])
            start, size = low - place[row], high - low
            wide = [np.frombuffer(b, "<u2").astype("<u4") for b in batch.column(1).to_pylist()]
            ids = [wide[r][a : a + m].tobytes() for r, a, m in zip(row.tolist(), start.tolist(), size.tolist())]
            columns = [start, size, n[row], sequence, low - sequence * length]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row)), *map(pa.array, columns), pa.array(ids, pa.binary())], names
            )

    kind = df.schema[key].dataType.simpleString()
    ids = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ids = ids.mapInArrow(keyed, f"key {kind}, ids binary, n long, curve long")
    ids = written(ids.withColumn("row", F.monotonically_increasing_id()))
    places = running_start(ids.select("row", "key", "n", "curve"), ["curve", "key", "row"], "n", "place")
    joined = ids.select("row", "key", "ids", "n").join(places.select("row", "place"), "row")
    schema = f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return joined.select("key", "ids", "n", "place").mapInArrow(pieces, schema).withColumnRenamed("key", key)
