"""Cutting lineage in a way that survives the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a table, as JSON text, that a join may broadcast.
BROADCAST_BYTES = 64 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="quadrat-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder and return the copy."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_side(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A summary table to be joined to many rows.

    It is written once and the text of its rows is measured; up to ``limit``
    bytes it is broadcast, so the large side is not shuffled on a possibly hot
    key. Beyond that the join is left to the adaptive planner.
    """
    table = durable(table)
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table
