"""Reading and writing tables, file listings, array archives and fitted models."""

from __future__ import annotations

import io
from collections.abc import Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None
) -> DataFrame:
    """CSV with a header; the key, if named, becomes the first column."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df if key is None else df.select(key, *[c for c in df.columns if c != key])


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    separator: str = "[;,]",
    null_token: str = "",
    header: bool = True,
) -> DataFrame:
    """Text with a regular-expression separator; blank fields are NULL.

    Fields are trimmed; quoted separators are not supported. Header lines are
    recognised by their first field.
    """
    parts = F.transform(F.split("value", separator, -1), lambda x: F.trim(x))
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    rows = lines.select(parts.alias("p"))
    if header:
        rows = rows.filter(F.col("p")[0] != F.lit(schema.fields[0].name))
    return rows.select(
        *[
            F.nullif(F.try_element_at("p", F.lit(i + 1)), F.lit(null_token.strip()))
            .try_cast(field.dataType)
            .alias(field.name)
            for i, field in enumerate(schema)
        ]
    )


def write_csv(df: DataFrame, path: str, key: str | None = None) -> None:
    """CSV folder with header, the key first."""
    out = df if key is None else df.select(key, *[c for c in df.columns if c != key])
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Typed binary copy of a table (Parquet)."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, verbose: bool = False) -> DataFrame:
    """Read a typed copy; ``verbose`` prints its schema."""
    df = spark.read.parquet(path)
    if verbose:
        df.printSchema()
    return df


def list_files(
    spark: SparkSession, folder: str, extension: str, recursive: bool = True
) -> DataFrame:
    """``(path, name, stem, folder, length, modified)``; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{extension}")
        .option("recursiveFileLookup", recursive)
        .load(folder)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        name.alias("name"),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"),
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
        "length",
        "modified",
    )


def list_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct folders below ``folder`` that hold files."""
    return list_files(spark, folder, "").select("folder").distinct()


ARCHIVE = "path string, key string, values array<double>, shape array<int>, error string"


def _unpack(batches):
    import numpy as np

    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    for key in archive.files:
                        array = archive[key]
                        rows.append((path, key, array.astype(float).ravel().tolist(),
                                     list(array.shape), None))
            except Exception as error:  # a broken file is reported, not fatal
                rows.append((path, None, [], [], f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(rows, columns=["path", "key", "values", "shape", "error"])


def read_array_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, key, values, shape, error)`` of all arrays in ``.npz`` files."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.npz")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "content")
    )
    return files.mapInPandas(_unpack, ARCHIVE)


def archive_summary(arrays: DataFrame) -> DataFrame:
    """``(read, files)``: how many files could be read."""
    return arrays.groupBy(F.col("error").isNull().alias("read")).agg(
        F.count_distinct("path").alias("files")
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline."""
    return PipelineModel.load(path)


def describe_params(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """``(stage, name, value)`` of every parameter of every stage."""
    rows = [
        (type(stage).__name__, param.name, str(value))
        for stage in model.stages
        for param, value in stage.extractParamMap().items()
    ]
    return spark.createDataFrame(rows, "stage string, name string, value string")
