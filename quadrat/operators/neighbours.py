"""Nearest neighbours without comparing every pair through a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.operators.durable import durable

#: Points that pivots are drawn from, most pivots, points aimed at per pivot.
PIVOT_SAMPLE, MOST_PIVOTS, PER_PIVOT = 2000, 2000, 1000
#: Distances a task holds at a time.
BLOCK = 1_000_000
#: Most points a task holds; a larger cell is dealt over more slices.
SLICE = 4096

NEIGHBOURS = "id string, vector array<double>, label string, found array<struct<distance double, id string, vector array<double>, label string>>"


def _squares(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, one dimension at a time."""
    out = np.zeros((len(q), len(vectors)))
    for d in range(q.shape[1]):
        out += np.subtract.outer(q[:, d], vectors[:, d]) ** 2
    return out


def _search(query, ids, vectors, labels, k: int) -> list[list[dict]]:
    """The k nearest points of each query row, itself excluded."""
    q = np.stack(query["vector"].to_numpy())
    names = query["id"].to_numpy()
    own = {}
    for j, name in enumerate(ids):
        own.setdefault(name, []).append(j)
    step = max(1, BLOCK // len(ids))
    out = []
    for start in range(0, len(q), step):
        gap = _squares(q[start:start + step], vectors)
        for i, row in enumerate(gap):
            same = own.get(names[start + i])
            if same:
                row[same] = np.inf
        top = min(k, len(ids))
        edges = np.partition(gap, top - 1, axis=1)[:, :top]
        counts = np.isfinite(edges).sum(axis=1)
        for i, row in enumerate(gap):
            m = int(counts[i])
            edge = edges[i, :m].max() if m else -1.0
            near = sorted(np.flatnonzero(row <= edge), key=lambda j: (row[j], ids[j]))[:m]
            out.append(
                [
                    {"distance": float(np.sqrt(row[j])), "id": ids[j],
                     "vector": vectors[j].tolist(), "label": labels[j]}
                    for j in near
                ]
            )
    return out


def _in_cells(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Search each asked ``(cell, slice)`` for its queries; points come first and are held, queries stream by."""

    def run(batches):
        held, parts = None, []
        for batch in batches:
            for cell, rows in batch.groupby(["cell", "slice"], sort=False):
                if cell != held:
                    held, parts = cell, []
                new = rows[rows["role"] == 0]
                if len(new):
                    parts.append(new)
                queries = rows[rows["role"] == 1][["id", "vector", "label"]].copy()
                if len(queries) and parts:
                    parts = [pd.concat(parts)]
                    pool = parts[0]
                    vectors = np.stack(pool["vector"].to_numpy())
                    queries["found"] = _search(queries, pool["id"].to_numpy(), vectors, pool["label"].to_numpy(), k)
                    yield queries

    columns = ["cell", "slice", "id", "vector", "label"]
    rows = points.select(*columns, F.lit(0).alias("role")).unionByName(asked.select(*columns, F.lit(1).alias("role")))
    rows = rows.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "role")
    return rows.mapInPandas(run, NEIGHBOURS)


def nearest(queries: DataFrame, points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``(id, vector, label, found)``: the k nearest of ``points`` for each query row, exactly.

    Both tables hold ``(id string, vector array<double>, label string)``. Points
    go to the cell of their nearest pivot. A query looks through its own cell,
    which bounds its k-th distance, and then only through cells that can hold a
    closer point: those whose pivot is no farther than that distance and the
    cell's radius together, and whose border with the own cell is no farther
    than that distance. Crowded cells are dealt over slices of about 4,096
    points, so no task holds more.
    """
    columns = ["id", "vector", "label"]
    points = durable(points.select(*columns))
    queries = durable(queries.select(*columns))
    total = points.count()
    if not total:
        none = F.array().cast(T._parse_datatype_string(NEIGHBOURS)["found"].dataType)
        return queries.withColumn("found", none)
    drawn = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(PIVOT_SAMPLE).collect()
    wanted = min(MOST_PIVOTS, -(-total // PER_PIVOT))
    pivots = np.unique(np.array([r["vector"] for r in drawn[:wanted]], float), axis=0)

    def blocks(batches):
        step = max(1, BLOCK // len(pivots))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start:start + step].copy()
                yield part, np.sqrt(_squares(np.stack(part["vector"].to_numpy()), pivots))

    def place(batches):
        for part, gap in blocks(batches):
            part["cell"], part["gap"] = gap.argmin(axis=1), gap.min(axis=1)
            yield part

    schema = "id string, vector array<double>, label string, cell int, gap double"
    placed = points.mapInPandas(place, schema)
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    slices = {c: -(-r["n"] // SLICE) for c, r in sizes.items()}
    count = F.element_at(F.create_map(*[F.lit(int(x)) for item in slices.items() for x in item]), F.col("cell"))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("id"), count).cast("int"))
    every = F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))
    own = queries.mapInPandas(place, schema).where(F.col("cell").isin([int(c) for c in slices]))
    first = durable(_merged(_in_cells(placed, own.withColumn("slice", every), k), k))
    bound = F.when(F.size("found") >= k, F.element_at("found", -1)["distance"]).otherwise(F.lit(float("inf")))
    bounds = queries.join(first.select("id", bound.alias("bound")), "id", "left").fillna({"bound": float("inf")})
    radius = np.array([sizes[c]["radius"] if c in sizes else -np.inf for c in range(len(pivots))])

    apart = np.sqrt(_squares(pivots, pivots))

    def others(batches):
        for part, gap in blocks(batches):
            bound = part["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12
            home = gap.argmin(axis=1)
            # A cell lies beyond the plane half-way between its pivot and the own one.
            beyond = gap**2 - gap.min(axis=1)[:, None] ** 2 - 1e-9 * gap**2
            with np.errstate(invalid="ignore"):  # the own cell, unbounded: no distance times infinity
                go = (gap <= bound + radius) & (beyond <= 2 * bound * apart[home]) & np.isfinite(radius)
            go[np.arange(len(part)), home] = False
            row, cell = np.nonzero(go)
            out = part.iloc[row][columns].copy()
            out["cell"], out["gap"] = cell, 0.0
            yield out

    rest = bounds.mapInPandas(others, schema).withColumn("slice", every)
    merged = _merged(first.unionByName(_in_cells(placed, rest, k)), k)
    alone = queries.join(merged.select("id"), "id", "left_anti")
    none = F.array().cast(merged.schema["found"].dataType)
    return durable(merged.unionByName(alone.withColumn("found", none)))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest over all lists of a query, one row per id."""
    return (
        found.groupBy("id")
        .agg(
            F.first("vector").alias("vector"), F.first("label").alias("label"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"),
        )
        .withColumn("found", F.slice("found", 1, k))
    )


def as_points(df: DataFrame, key: str, columns, label: str) -> DataFrame:
    """``(id, vector, label)`` of complete rows."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    return (
        df.select(F.col(key).cast("string").alias("id"), *columns, F.col(label).cast("string").alias("label"))
        .dropna()
        .select("id", vector.cast(T.ArrayType(T.DoubleType())).alias("vector"), "label")
    )
