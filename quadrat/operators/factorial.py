"""Least squares on the table of factor-level cells: analysis of variance with any number of factors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import number
from quadrat.operators.durable import durable

#: Most columns of a model whose normal equations are solved at once; larger ones go by conjugate gradients in Spark.
DENSE_COLUMNS = 1_000

Margin = frozenset  # of factor positions
EVERY = 1e-13  # a step that lowers the residual sum by less than this share of the whole counts as none


def _keys(margin: Margin) -> list[str]:
    return [f"f{i}" for i in sorted(margin)]


@dataclass
class Cells:
    """Cells of all factors with their row counts and centred means.

    ``table`` has ``f0, f1, …, n, z``, one row per combination that occurs.
    ``between`` is the sum of squares between cells and ``within`` that inside.
    """

    table: DataFrame
    levels: list[int]
    count: int
    rows: int
    between: float
    within: float
    dense: int = DENSE_COLUMNS
    known: dict = field(default_factory=dict)

    def fit(self, margins: frozenset[Margin]) -> tuple[float, int]:
        """Residual sum of squares between cells, and rank, of the model with these largest margins.

        A margin stands for its interaction and everything below it.
        """
        if margins not in self.known:
            self.known[margins] = self._fit(sorted(margins, key=sorted))
        return self.known[margins]

    def _fit(self, margins: list[Margin]) -> tuple[float, int]:
        if any(len(m) == len(self.levels) for m in margins):
            return 0.0, self.count
        totals = [
            self.table.groupBy(*_keys(m)).agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("z")).alias("s"))
            for m in margins
        ]
        if len(margins) == 1:
            row = totals[0].agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("ss")).first()
            return max(self.between - row["ss"], 0.0), row["k"]
        sizes = [t.count() for t in totals]
        if sum(sizes) <= self.dense:
            return self._solve(margins, totals)
        return self._descend(margins), self._rank(margins, sizes)

    def _solve(self, margins: list[Margin], totals: list[DataFrame]) -> tuple[float, int]:
        """Normal equations of at most ``dense`` columns, from the counts of pairs of margin cells."""
        places, right, scale = [], [], []
        for m, total in zip(margins, totals, strict=True):
            place = {}
            for r in total.collect():  # bounded by ``dense``
                place[tuple(r[k] for k in _keys(m))] = len(right)
                right.append(r["s"] / np.sqrt(r["c"]))
                scale.append(np.sqrt(r["c"]))
            places.append(place)
        gram = np.eye(len(right))
        for (a, at), (b, bt) in combinations(zip(margins, places, strict=True), 2):
            for r in self.table.groupBy(*_keys(a | b)).agg(F.sum("n").alias("c")).collect():  # at most dense^2 / 4
                i, j = at[tuple(r[k] for k in _keys(a))], bt[tuple(r[k] for k in _keys(b))]
                gram[i, j] = gram[j, i] = r["c"] / (scale[i] * scale[j])
        values, vectors = np.linalg.eigh(gram)
        real = values > 1e-11 * len(values)
        explained = float(((vectors[:, real].T @ np.array(right)) ** 2 / values[real]).sum())
        return max(self.between - explained, 0.0), int(real.sum())

    def _descend(self, margins: list[Margin]) -> float:
        """Residual sum of squares by conjugate gradients, preconditioned by the margins' counts.

        The state lives on the cells: residual ``r`` and the fit ``q`` of the
        search direction. A step averages the residual over every margin, one
        equi-join each; only five sums come back.
        """
        keys = _keys(frozenset(range(len(self.levels))))
        state = self.table.select(*keys, "n", F.col("z").alias("r"), F.lit(0.0).alias("q"))
        last, idle = None, 0
        while True:
            step = state
            for i, m in enumerate(margins):
                mean = F.sum(F.col("n") * F.col("r")) / F.sum("n")
                step = step.join(state.groupBy(*_keys(m)).agg(mean.alias(f"h{i}")), _keys(m))
            x = reduce(add, [F.col(f"h{i}") for i in range(len(margins))])
            step = durable(step.select(*keys, "n", "r", "q", x.alias("x")))
            s = step.agg(
                *[F.sum(F.col("n") * F.col(a) * F.col(b)).alias(a + b) for a, b in ("rx", "xx", "xq", "qq", "rr")]
            ).first()
            if not s["rx"] or s["rx"] <= 0 or not s["xx"]:
                return s["rr"]
            beta = s["rx"] / last if last else 0.0
            length = s["rx"] / (s["xx"] + 2 * beta * s["xq"] + beta * beta * s["qq"])
            idle = idle + 1 if length * s["rx"] <= EVERY * self.between else 0
            if idle == 2:
                return s["rr"]
            last, q = s["rx"], F.col("x") + beta * F.col("q")
            state = step.select(*keys, "n", (F.col("r") - length * q).alias("r"), q.alias("q"))

    def _rank(self, margins: list[Margin], sizes: list[int]) -> int:
        """Rank of a model too large to be solved at once.

        Two margins: their cells less one for each connected part. More: a
        count of contrasts, which needs every combination of levels to occur.
        """
        if len(margins) == 2:
            return sum(sizes) - self._parts(*margins)
        if self.count != int(np.prod([float(v) for v in self.levels])):
            raise ValueError(
                "degrees of freedom of three or more overlapping interactions with empty cells "
                f"need at most {self.dense} columns; raise dense_columns"
            )
        below = {s for m in margins for k in range(len(m) + 1) for s in combinations(sorted(m), k)}
        return sum(int(np.prod([self.levels[i] - 1 for i in s])) for s in below)

    def _parts(self, a: Margin, b: Margin) -> int:
        """Connected parts of the graph whose edges are the cells and whose nodes the cells of two margins."""
        start = F.struct(*_keys(a))
        state = durable(self.table.groupBy(*_keys(a | b)).agg(F.min(start).alias("part")))
        while True:
            over = state.join(state.groupBy(*_keys(b)).agg(F.min("part").alias("over")), _keys(b))
            least = over.groupBy(*_keys(a)).agg(F.min("over").alias("least"))
            state = durable(state.join(least, _keys(a)))
            moved = state.where("least != part").head(1)
            state = state.drop("part").withColumnRenamed("least", "part")
            if not moved:
                return state.select("part").distinct().count()


def factor_cells(df: DataFrame, y: str, factors: Sequence[str], dense: int = DENSE_COLUMNS) -> Cells | None:
    """The cells of complete rows; None without any."""
    keys = [f"f{i}" for i in range(len(factors))]
    rows = df.filter(number(y).isNotNull()).dropna(subset=list(factors))
    table = durable(
        rows.groupBy(*[F.col(f).cast("string").alias(k) for f, k in zip(factors, keys, strict=True)]).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(number(y)).alias("mean"),
            F.coalesce(F.var_samp(number(y)), F.lit(0.0)).alias("var"),
        )
    )
    s = table.agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("n").alias("rows"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
        *[F.count_distinct(k).alias(k) for k in keys],
    ).first()
    if not s["count"]:
        return None
    table = table.select(*keys, "n", (F.col("mean") - F.lit(s["grand"])).alias("z"))
    between = table.agg(F.sum(F.col("n") * F.col("z") * F.col("z"))).first()[0]
    return Cells(table, [s[k] for k in keys], s["count"], s["rows"], between, s["within"], dense)


def type_two_effects(cells: Cells, factors: Sequence[str]) -> list[tuple[str, float, int]]:
    """``(source, sum of squares, df)`` of every main effect and interaction.

    An effect is judged next to all terms that do not contain it. Empty cells
    lower its degrees of freedom to what the data can tell apart.
    """
    whole = frozenset(range(len(factors)))
    out = []
    for size in range(1, len(factors) + 1):
        for term in combinations(range(len(factors)), size):
            others = frozenset(whole - {i} for i in term)
            less, more = cells.fit(others), cells.fit(others | {frozenset(term)})
            dof = more[1] - less[1]
            gain = max(less[0] - more[0], 0.0) if dof else 0.0
            out.append((" * ".join(factors[i] for i in term), gain, dof))
    return out
