"""Statistics along one array column, as higher-order expressions (no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _mean(values: Column) -> Column:
    return F.try_divide(_total(values), F.size(values).cast("double"))


def array_mean(column: str | Column, digits: int | None = 3) -> Column:
    """Mean of the elements, rounded half-even; ``None`` leaves it unrounded."""
    value = _mean(_doubles(column))
    return value if digits is None else F.bround(value, digits)


def array_median(column: str | Column, digits: int | None = 3) -> Column:
    """Median of the elements; the two middle ones are averaged."""
    values = F.array_sort(_doubles(column))
    n = F.size(values)
    low = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(values, (F.floor(n / 2) + 1).cast("int"))
    value = F.when(n > 0, (low + high) / 2.0)
    return value if digits is None else F.bround(value, digits)


def array_std(column: str | Column, digits: int | None = 3) -> Column:
    """Population standard deviation of the elements."""
    values = _doubles(column)
    mean = _mean(values)
    squares = F.transform(values, lambda x: (x - mean) * (x - mean))
    value = F.sqrt(_mean(squares))
    return value if digits is None else F.bround(value, digits)


def row_std(columns: Sequence[str]) -> Column:
    """Population standard deviation along each row, unrounded."""
    return array_std(F.array(*[F.col(c).cast("double") for c in columns]), None)


def array_length(column: str | Column) -> Column:
    """Number of elements."""
    return F.size(F.col(column) if isinstance(column, str) else column)
