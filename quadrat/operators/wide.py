"""Covariances and correlations of hundreds of columns: blocks of products from Arrow batches, added up in a tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import number

#: Tables of more columns than this take products in blocks instead of one expression for each pair.
WIDE_COLUMNS = 60
BLOCK = 64  # columns of a block
FAN = 64  # partial sums that one task of the tree adds up
ROWS = 2_048  # rows multiplied at a time
SHIFT_ROWS = 1_000  # rows whose medians the columns are shifted by; they only keep digits, results don't depend on them


def _shift(rows: DataFrame) -> np.ndarray:
    """A value near the middle of every column (0 without one)."""
    few = rows.limit(SHIFT_ROWS).toPandas().to_numpy(float)
    middle = np.zeros(few.shape[1])
    for j in range(few.shape[1]):
        there = np.sort(few[np.isfinite(few[:, j]), j])
        if len(there):
            middle[j] = there[len(there) // 2]
    return middle


def product_blocks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, v)``, i <= j: six stacked blocks of sums over the rows where both columns are present.

    They are the row counts, the sums of the first and of the second column,
    those of their squares, and of their products, all after the shift. One
    pass; a task holds four matrices of the columns' size and returns blocks,
    which are added ``FAN`` at a time, whatever the number of tasks.
    """
    rows = df.select(*[number(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    shift, p = _shift(rows), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, square, both = np.zeros((4, p, p))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]) - shift
                there = ~np.isnan(x)
                if there.all():
                    n += len(x)
                    first += x.sum(axis=0)[:, None]
                    square += (x * x).sum(axis=0)[:, None]
                else:
                    x[~there] = 0.0
                    mask = there.astype(float)
                    n += mask.T @ mask
                    first += x.T @ mask
                    square += (x * x).T @ mask
                both += x.T @ x
        yield from cut(n, first, square, both)

    def cut(n: np.ndarray, first: np.ndarray, square: np.ndarray, both: np.ndarray) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i in range(0, p, BLOCK):
            for j in range(i, p, BLOCK):
                a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
                v = np.stack([n[a, b], first[a, b], first[b, a].T, square[a, b], square[b, a].T, both[a, b]])
                yield pa.RecordBatch.from_pydict({"i": [i], "j": [j], "task": [task], "v": [v.ravel()]}, schema=kind)

    def nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from cut(*np.zeros((4, p, p)))

    def added(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[:1].copy()
        one["v"] = [np.add.reduce(np.stack(group["v"].to_list()))]
        return one

    kind = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("task", pa.int32()), ("v", pa.list_(pa.float64()))])
    schema = "i int, j int, task int, v array<double>"
    none = df.sparkSession.range(0, 1, 1, 1).mapInArrow(nothing, schema)  # so that a table without rows has its pairs
    blocks = rows.mapInArrow(run, schema).unionAll(none)
    for _ in range(3):  # up to FAN^3 tasks of the pass
        blocks = blocks.withColumn("task", F.expr(f"task DIV {FAN}").cast("int")).groupBy("i", "j", "task").applyInPandas(added, schema)
    return blocks


def wide_pairs(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """``(x, y, r)`` of column pairs: ``corr`` (i < j) or ``cov`` (i <= j), each over the rows with both present.

    Null where the pair has fewer than two rows, or a column of it does not vary.
    """
    names = np.array(list(columns), object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, j, v in zip(frame["i"], frame["j"], frame["v"]):
                h, w = min(BLOCK, len(names) - i), min(BLOCK, len(names) - j)
                n, a, b, aa, bb, ab = np.asarray(v, float).reshape(6, h, w)
                with np.errstate(all="ignore"):
                    cov = ab - a * b / n
                    if kind == "cov":
                        r = np.where(n > 1, cov / (n - 1), np.nan)
                    else:
                        own = np.maximum(aa - a * a / n, 0.0) * np.maximum(bb - b * b / n, 0.0)
                        r = np.where((n > 1) & (own > 0), cov / np.sqrt(own), np.nan)
                s, t = np.meshgrid(np.arange(i, i + h), np.arange(j, j + w), indexing="ij")
                wanted = s <= t if kind == "cov" else s < t
                found = r[wanted]
                yield pd.DataFrame({"x": names[s[wanted]], "y": names[t[wanted]], "r": found})

    pairs = product_blocks(df, columns).mapInPandas(run, "x string, y string, r double")
    return pairs.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))
