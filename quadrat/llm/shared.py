"""Helpers of the training-data operators: words, written tables, running totals."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.durable import checkpoint_folder

#: A word is a run of anything but these six ASCII characters; ``bytes.split()`` cuts at the same six.
BLANKS = r"[ \t\n\x0B\f\r]+"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; none for null."""
    return text.encode().split() if text else []


@lru_cache(1)
def keep_freed_memory() -> None:
    """Let this Python worker reuse freed arrays of up to 32 MB instead of handing each back to the system.

    Page faults of short-lived arrays otherwise cost more than the arithmetic.
    Sets glibc's trim and map thresholds; elsewhere nothing happens.
    """
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-1, 64 << 20)
            libc.mallopt(-3, 32 << 20)


def give_back_memory() -> None:
    """Hand this process's freed memory back to the system; glibc otherwise keeps most of it. Elsewhere nothing happens."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


_recorded: list[str] = []  # tables of the pipeline's stages that are still there
_recording: list[bool] = []  # not empty inside a stage whose result is written before the next one begins


@contextmanager
def stage_tables(docs: DataFrame, first: bool, last: bool) -> Iterator[None]:
    """A stage of a pipeline that writes each stage's result before the next one begins.

    The tables of the stages before are deleted, except those that ``docs``
    still reads. The first stage deletes none, and the last one's stay until the
    session ends, as its result may be read at any time.
    """
    if not first:
        needed = docs.inputFiles()
        spark = docs.sparkSession
        for path in list(_recorded):
            if not any(path.rsplit("/", 1)[1] in file for file in needed):
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
                _recorded.remove(path)
    if not last:
        _recording.append(True)
    try:
        yield
    finally:
        if not last:
            _recording.pop()


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but column-wise and compressed. The
    folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if _recording:
        _recorded.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, so that they don't take disk until the session ends."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for file in table.inputFiles()[:1]:
            place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
            _recorded[:] = [path for path in _recorded if not path.endswith(place.getName())]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over and no longer referred to.

    It does so when the driver collects its garbage, which a quiet driver may
    not do for a long time. A hint only: results don't depend on it.
    """
    gc.collect()
    spark._jvm.System.gc()


def running_start(df: DataFrame, keys: list[str], amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows before this one in the order of ``keys``.

    Rows are range-sorted; each sorted slot is summed, the slots' sums (one row
    per slot) are added up, and each row gets its slot's start plus its place in
    the slot. No window spans more than one slot. ``keys`` must be unique together.
    """
    from pyspark.sql import Window as W

    slots = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(df.repartitionByRange(slots, *keys).withColumn("_slot", F.spark_partition_id()))
    sums = placed.groupBy("_slot").agg(F.sum(amount).alias("_sum"))
    before = sums.select(
        "_slot",
        (F.sum("_sum").over(W.orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"),
    )
    inside = W.partitionBy("_slot").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(before), "_slot")  # one row per slot
        .withColumn(out, F.col("_before") + F.sum(amount).over(inside) - F.col(amount))
        .drop("_slot", "_before")
    )
