"""Registration and rounding of catalogue queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register ``function(t)``, where ``t("orders")`` reads a table.

    Double columns of the result are rounded, as the SQL does, because the two
    engines add numbers in different orders.
    """

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            def table(name: str) -> DataFrame:
                return spark.read.parquet(f"{folder}/{name}.parquet")

            return rounded(function(table), digits)

        QUERIES[function.__name__] = run
        if sql:
            CHECKS[function.__name__] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every double column; negative zero becomes zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
