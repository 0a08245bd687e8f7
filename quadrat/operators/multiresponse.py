"""Multivariate analysis of variance per term of a linear model with factors and covariates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.columns import number
from quadrat.operators.hypotheses import MANOVA_SCHEMA, multivariate_statistics
from quadrat.operators.linalg import complete_rows

#: A column of which the ones before leave less than this share adds nothing to the model.
ALIASED = 1e-9


def _terms(terms: Sequence[str | Sequence[str]]) -> list[tuple[str, ...]]:
    out = [(t,) if isinstance(t, str) else tuple(t) for t in terms]
    if not out or len({frozenset(t) for t in out}) < len(out) or any(len(set(t)) < len(t) for t in out):
        raise ValueError("one or more different terms")
    return out


def sweep(a: np.ndarray, k: int) -> None:
    """Sweep the symmetric matrix on its diagonal element ``k``, in place."""
    pivot = a[k, k]
    row = a[k] / pivot
    a -= np.outer(a[:, k], row)
    a[k] = row
    a[:, k] = row
    a[k, k] = -1.0 / pivot


def cell_products(df: DataFrame, factors: list[str], values: list[str]) -> DataFrame:
    """``factors, s``: sums of products of all pairs of ``values`` and 1, per combination of levels.

    The one pass over the rows: it ends in a row per combination that occurs.
    """
    numbers = [F.lit(1.0), *[number(v) for v in values]]
    pairs = list(combinations_with_replacement(range(len(numbers)), 2))
    sums = F.array(*[F.sum(numbers[i] * numbers[j]) for i, j in pairs])
    keys = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(factors)]
    return df.groupBy(*keys).agg(sums.alias("s"))


def design_products(cells: DataFrame, marks: list[dict[int, str]], parts: list[int], width: int) -> np.ndarray:
    """Products of all design columns, added up over the cells.

    Column ``i`` is 1 where every factor of ``marks[i]`` has the level given
    there, times value ``parts[i]``. Partitions return their sums; only the
    matrix of the model's columns reaches the driver.
    """
    pairs = {p: k for k, p in enumerate(combinations_with_replacement(range(width), 2))}
    which = np.array([[pairs[min(a, b), max(a, b)] for b in parts] for a in parts])
    names = cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(which.shape)
        for batch in batches:
            levels = {i: np.array(batch.column(i).to_pylist(), object) for i in range(len(names) - 1)}
            sums = np.array(batch.column(len(names) - 1).to_pylist(), float)
            on = np.ones((batch.num_rows, len(marks)), bool)
            for j, mark in enumerate(marks):
                for i, level in mark.items():
                    on[:, j] &= levels[i] == level
            for row, s in zip(on, sums):
                at = np.flatnonzero(row)  # few columns hold for one cell
                total[np.ix_(at, at)] += s[which[np.ix_(at, at)]]
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    table = cells.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(which.shape)
    out[table["i"], table["j"]] = table["v"]
    return out


def manova_terms(df: DataFrame, responses: Sequence[str], terms: Sequence[str | Sequence[str]]) -> DataFrame:
    """Four statistics per term: ``(term, statistic, value, df1, df2, f, p)``.

    ``terms`` are columns or tuples of columns (interactions). Numeric columns
    are covariates; text, boolean and date columns are factors with the first
    level as reference. Each term, and the intercept, is tested next to all
    others: its coefficients are zero. Columns that the ones before explain are
    left out; a term without columns left, a table without rows and a model
    without residual degrees of freedom give no lines. Rows with a missing
    value do not count.

    One pass ends in sums per combination of levels; the matrix of the model's
    columns is swept on the driver.
    """
    terms = _terms(terms)
    used = list(dict.fromkeys(c for t in terms for c in t))
    numeric = [c for c in used if isinstance(df.schema[c].dataType, T.NumericType)]
    factors = [c for c in used if c not in numeric]
    rows = df.filter(complete_rows(df, [*responses, *numeric])).dropna(subset=factors) if factors else df.filter(complete_rows(df, [*responses, *numeric]))
    schema = "term string, " + MANOVA_SCHEMA
    middle = rows.agg(F.count(F.lit(1)), *[F.avg(number(c)) for c in responses]).first()
    if not middle[0]:
        return df.sparkSession.createDataFrame([], schema)
    monomials = sorted({tuple(c for c in t if c in numeric) for t in terms} - {()})
    values = {f"v{k}": _product(m) for k, m in enumerate(monomials)}
    values |= {f"y{k}": number(c) - F.lit(middle[k + 1]) for k, c in enumerate(responses)}
    plain = rows.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(factors)], *[v.alias(k) for k, v in values.items()])
    cells = cell_products(plain, [f"g{i}" for i in range(len(factors))], list(values)).persist()
    try:
        levels = [
            [r[0] for r in cells.select(f"f{i}").distinct().orderBy(f"f{i}").collect()] for i in range(len(factors))
        ]  # one per dummy column of the model
        marks, parts, owner = [{}], [0], [None]
        for t in terms:
            own = [factors.index(c) for c in t if c in factors]
            part = 1 + monomials.index(m) if (m := tuple(c for c in t if c in numeric)) else 0
            for choice in product(*[levels[i][1:] for i in own]):
                marks.append(dict(zip(own, choice, strict=True)))
                parts.append(part)
                owner.append(t)
        p, x = len(responses), len(marks)
        marks += [{}] * p
        parts += [1 + len(monomials) + k for k in range(p)]
        a = design_products(cells, marks, parts, 1 + len(values))
    finally:
        cells.unpersist()
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    a /= np.outer(scale, scale)
    swept = []
    for k in range(x):
        if a[k, k] > ALIASED:
            sweep(a, k)
            swept.append(k)
    y = np.arange(x, x + p)
    e, v = a[np.ix_(y, y)], middle[0] - len(swept)
    if v < p or np.linalg.matrix_rank(e, tol=1e-12) < p:
        return df.sparkSession.createDataFrame([], schema)
    lines = []
    for t in [None, *terms]:
        own = [k for k in swept if owner[k] == t]
        if t is None:  # responses were shifted: the intercept's coefficient is put back
            back = np.zeros(p) if 0 not in own else np.array(middle[1:], float) * scale[0] / scale[y]
        if not own:
            continue
        b = a[np.ix_(own, y)] + (back if t is None else 0.0)
        h = b.T @ np.linalg.solve(-a[np.ix_(own, own)], b)
        name = "Intercept" if t is None else " * ".join(t)
        lines += [(name, *line) for line in multivariate_statistics(h, e, len(own), v)]
    return df.sparkSession.createDataFrame(lines, schema)


def _product(columns: tuple[str, ...]):
    out = number(columns[0])
    for c in columns[1:]:
        out = out * number(c)
    return out
