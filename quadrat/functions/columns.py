"""Column helpers shared by the operators; everything here stays in Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(name: str | Column) -> Column:
    """Cast to double and turn NaN into NULL, so that aggregates skip it."""
    column = F.col(name) if isinstance(name, str) else name
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise like pandas does when a column is unknown (Spark ignores some)."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def numeric_names(df: DataFrame) -> list[str]:
    """Names of the numeric columns in schema order."""
    return [
        field.name
        for field in df.schema
        if isinstance(field.dataType, T.NumericType)
    ]


def categorical_names(df: DataFrame) -> list[str]:
    """Columns marked ``role=category``; every string column if none is marked."""
    marked = [f.name for f in df.schema if f.metadata.get("role") == "category"]
    return marked or [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType)
    ]


def pretty_label(column: str | Column) -> Column:
    """``snake_case`` to ``Title Case``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def extract_key(column: str | Column, start: int, end: int | None = None) -> Column:
    """Part before the first run of ``_``, sliced ``[start:end]`` (0-based)."""
    column = F.col(column) if isinstance(column, str) else column
    head = F.split(column, "_+").getItem(0)
    length = F.length(head) if end is None else F.lit(end - start)
    return F.substring(head, F.lit(start + 1), length)


def order_hash(keys: Sequence[str], seed: int) -> Column:
    """Reproducible pseudo-random order: md5 over the key columns and a seed."""
    parts = [F.col(key).cast("string") for key in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def is_missing(df: DataFrame, name: str) -> Column:
    """Whether a cell is missing: NULL, or NaN in a floating-point column."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def percent_of(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` with NULL instead of a division by zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def adjusted_skewness(n: Column, g1: Column) -> Column:
    """Bias-adjusted skewness G1 from the population g1 (needs n > 2)."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-adjusted excess kurtosis G2 from the population g2 (needs n > 3)."""
    n = n.cast("double")
    scale = (n - 1) / ((n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * g2 + 6))


def jarque_bera_value(n: Column, g1: Column, g2: Column) -> Column:
    """Jarque-Bera statistic from biased moments."""
    return n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)


def melt(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    as_text: bool = False,
) -> DataFrame:
    """Long form ``(keep..., feature, value)`` of several columns, one scan.

    The rows grow p-fold inside the stage only; all consumers aggregate before
    they shuffle.
    """
    cast = (lambda c: F.col(c).cast("string")) if as_text else number
    wide = df.select(*keep, *[cast(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"__v{i}").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(*keep, F.inline(cells))

