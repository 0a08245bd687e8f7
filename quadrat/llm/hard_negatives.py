"""Hard negatives for anchors: clusters of anchors share lists of candidates, walked until certified ends."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.llm.shared import written

#: Anchors that the cluster centres are fitted on at most, centres, and anchors aimed at in a cluster.
FIT_ROWS, MOST_CENTRES, CLUSTER = 4_096, 256, 64
#: Most anchors of one block of a cluster; candidates aimed at in one slice of a list.
BLOCK, SLICE = 4_000, 2_048
#: Candidates that the members of a block look at before they test for the end of their walk.
STRIDE = 512
#: A bound is raised by this share and amount before it ends a walk, above any rounding of its cosines.
SLACK, MARGIN = 1e-9, 1e-3


def whole_rows(df: DataFrame, anchor: Column, key: str, vector: str, label: str, factor: int) -> DataFrame:
    """``id, label, q, anchor, row`` of the rows that take part; ``q`` holds the whole-number components as 64-bit bytes."""
    rows = df.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))

    def whole(v: list[float]) -> bytes:
        x = np.floor(np.array(v, float) * factor)
        if np.abs(x).max(initial=0) >= 2.0**55:
            raise ValueError("components beyond 55 bits")
        return x.astype("<i8").tobytes()

    def run(batches):
        for b in batches:
            q = list(map(whole, b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(q, pa.binary()), b.column(3)], ["id", "label", "q", "anchor"])

    return written(rows.mapInArrow(run, "id long, label long, q binary, anchor boolean").withColumn("row", F.monotonically_increasing_id()))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Components of vectors as 64-bit whole numbers, one row each, short vectors filled up with zeros."""
    vectors = column.to_pylist()
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        got = np.frombuffer(v, "<i8")
        out[i, : len(got)] = got
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum (and its 128-fold) stays a whole double, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**46:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if top >= 2.0**56:
        raise ValueError("scores beyond 56 bits")
    return a @ b.T


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means from evenly spaced starts."""
    points = unit(sample.astype(float))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (points @ centres.T).argmax(1)
        for c in range(k):
            if (own == c).any():
                centres[c] = points[own == c].mean(0)
        centres = unit(centres)
    return centres


def upper_bounds(x: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """Largest inner product of each row with any unit vector within ``radius`` (an angle) of the unit ``centre``."""
    size = np.linalg.norm(x, axis=1)
    angle = np.arccos(np.clip(x @ centre / np.where(size > 0, size, 1), -1, 1))
    bound = size * np.cos(np.maximum(angle - radius, 0))
    return bound + np.abs(bound) * SLACK + MARGIN


def best_of(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries of each row: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    sorted_ = rows[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[rank < k]


def walk(members: np.ndarray, sizes: np.ndarray, x: np.ndarray, ids: np.ndarray, bounds: np.ndarray, wants, k: int):
    """Walk one slice of a list, sorted once by bound, for all members of a block.

    ``wants`` lists slots: (member of each row, least score, most score, bar,
    allowed), where ``bar`` is a score that k known candidates reach and
    ``allowed(rows, candidates)`` tells which candidates may enter. A member's
    walk ends as soon as no later candidate of the list can reach what it still
    wants. Returns (slot row, candidate, score) of the k best of each slot row.
    """
    order = np.argsort(-bounds, kind="stable")
    x, ids, bounds = x[order], ids[order], bounds[order]
    owner, least, most, bar, allowed = wants
    bar = np.maximum(least, bar)
    got = [np.zeros(0, np.int64)] * 3
    for start in range(0, len(ids), STRIDE):
        reach = sizes[owner] * bounds[start] * (1 + SLACK) + MARGIN
        live = np.flatnonzero(reach >= bar)
        if not len(live):
            break
        part = slice(start, start + STRIDE)
        who, which = np.unique(owner[live], return_inverse=True)
        scores = products(members[who], x[part])[which]
        fits = (scores >= bar[live, None]) & (scores <= most[live, None]) & allowed(live, order[part])
        row, column = np.nonzero(fits)
        if not len(row):
            continue
        got = [np.concatenate(p) for p in zip(got, (live[row], column + start, scores[row, column]))]
        kept = best_of(got[0], got[2], ids[got[1]], k)
        got = [g[kept] for g in got]  # sorted by row, then best first
        full = np.bincount(got[0], minlength=len(owner)) == k
        ends = np.searchsorted(got[0], np.flatnonzero(full), "right") - 1
        bar[full] = np.maximum(bar[full], got[2][ends])
    return got[0], order[got[1]], got[2]


class Lists:
    """Anchor blocks, and which candidates each block's list holds."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        n, anchors, width = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.octet_length("q") / 8)).first()
        self.width = int(width or 0)
        self.slices = max(1, -(-n // SLICE))
        sample = rows.where("anchor").orderBy(F.xxhash64("row"), "row").limit(FIT_ROWS).select("q").toArrow()  # bounded by FIT_ROWS
        k = min(MOST_CENTRES, -(-anchors // CLUSTER), sample.num_rows)
        self.centres = fit_centres(matrix(sample["q"], self.width), k) if k else np.zeros((0, self.width))
        self.nearest = written(self.assigned(rows)) if k else None

    def assigned(self, rows: DataFrame) -> DataFrame:
        """Add ``centre``, the angle to it and the vector's length."""
        centres, width = self.centres, self.width

        def run(batches):
            for b in batches:
                x = matrix(b.column("q"), width).astype(float)
                cosine = unit(x) @ centres.T
                own = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(own)), own], -1, 1))
                more = [pa.array(own), pa.array(angle), pa.array(np.linalg.norm(x, axis=1))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "centre", "angle", "size"])

        return rows.mapInArrow(run, "id long, label long, q binary, anchor boolean, row long, centre long, angle double, size double")

    def anchors(self) -> DataFrame:
        """Anchors with the block they belong to: a cluster, or a hashed part of a cluster with many anchors."""
        a = self.nearest.where("anchor")
        sizes = a.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))  # one row per centre
        a = a.join(F.broadcast(sizes), "centre")
        return a.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks", "anchor")

    def blocks(self, state: DataFrame) -> list[tuple]:
        """(centre, block, angle radius, least score per length that some member still wants): one row per ``BLOCK`` anchors."""
        least = F.min(F.when(F.col("size") > 0, F.col("bar") / F.col("size")).otherwise(F.when(F.col("bar") <= 0, -float("inf")).otherwise(float("inf"))))
        got = state.groupBy("centre", "block").agg(F.max("angle").alias("radius"), least.alias("least")).collect()
        return sorted((r.centre, r.block, r.radius, r.least) for r in got)

    def routed(self, state: DataFrame, near: bool) -> DataFrame:
        """Candidates with the block and the slice of its list that they go to.

        In the first wave (``near``) a block gets the candidates of its own
        cell. In the second it gets those of the other cells that its bound does
        not exclude, which are whole lists where nothing can be excluded.
        """
        blocks, centres, width, slices = self.blocks(state), self.centres, self.width, self.slices

        def run(batches):
            for b in batches:
                x = matrix(b.column("q"), width).astype(float)
                own = b.column("centre").to_numpy(zero_copy_only=False)
                slot = b.column("row").to_numpy(zero_copy_only=False) % slices
                for centre, block, radius, least in blocks:
                    bound = upper_bounds(x, centres[centre], radius + 1e-6)
                    at = np.flatnonzero((own == centre) if near else (own != centre) & (bound >= least - MARGIN))
                    if not len(at):
                        continue
                    keys = [np.full(len(at), centre), np.full(len(at), block), slot[at], bound[at]]
                    parts = b.select(["id", "label", "q"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *parts.columns], ["centre", "block", "slice", "bound", "id", "label", "q"])

        return self.nearest.select("id", "label", "q", "centre", "row").mapInArrow(
            run, "centre long, block long, slice long, bound double, id long, label long, q binary"
        )

    def wave(self, state: DataFrame, search: Callable, schema: str, near: bool) -> DataFrame:
        """Meet every block with each slice of its list and search there.

        Groups are bounded by ``BLOCK`` anchors and about ``SLICE`` candidates.
        """
        spread = state.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1).cast("long"))))
        width = self.width

        def run(a: pa.Table, c: pa.Table) -> pa.Table:
            return search(a, matrix(a["q"], width), c, matrix(c["q"], width))

        keys = ["centre", "block", "slice"]
        lists = self.routed(state, near)
        return spread.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(run, schema)

    def topped(self, state: DataFrame, search: Callable, schema: str, keys: list[str], k: int, bars: Callable) -> DataFrame:
        """Best ``k`` rows per ``keys``: a wave over the near cell sets the bars that end the walks of the second."""
        order = W.partitionBy(*keys).orderBy(F.desc("score"), "id", "other")
        first = written(self.wave(state, search, schema, True))
        rest = self.wave(bars(state, first), search, schema, False)
        best = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return written(best)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def found(t: pa.Table, names: list[str], rows: np.ndarray, c: pa.Table, at: np.ndarray, scores: np.ndarray, more: dict) -> pa.Table:
    """Result of one search: anchor columns, candidate and score."""
    base = {n: t[n].take(pa.array(rows)) for n in names}
    return pa.table(base | more | {"id": c["id"].take(pa.array(at)), "other": pa.array(at), "score": pa.array(scores)})


def mine(
    df: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    factor: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives per anchor and positive.

    A score is the inner product of floored components ``factor * x``. An
    anchor's positives are its ``positives`` best rows of its label; negatives
    are the ``negatives`` best rows of other labels whose score lies between
    ``low`` and ``high`` hundredths of the positive's. Ties go by smaller id.

    Anchors are clustered (centres fitted on at most ``FIT_ROWS`` of them). The
    list of a cluster holds all rows under an upper bound of their score with
    any member, an angular one; it is cut into slices, each sorted once and
    walked by all members until the bound certifies that nothing better can
    follow. A first wave over the cluster's own cell gives bars for the rest.
    Nothing is estimated: where bounds exclude nothing, whole lists are walked.

    Rows with a null id, label or vector, or null or non-finite components, take
    no part. Shorter vectors are filled up with zeros. Rows that share an id act
    each by itself but are never partners of one another; equal rows give equal
    results more than once. An anchor without positives, or a positive without
    negatives in reach (any with a score below zero), gives no row; so does an
    empty table. Other columns are ignored. Scores beyond 56 bits raise.
    """
    out = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    lists = Lists(whole_rows(df, anchor, key, vector, label, factor))
    if not len(lists.centres):
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return df.sparkSession.createDataFrame([], schema)
    least = -(1 << 62)
    state = written(lists.anchors().withColumn("bar", F.lit(least).cast("long")))

    def find_positives(a: pa.Table, members: np.ndarray, c: pa.Table, x: np.ndarray) -> pa.Table:
        n = len(members)
        mine_, theirs, a_id, c_id = column(a, "label"), column(c, "label"), column(a, "id"), column(c, "id")

        def allowed(rows, at):
            return (mine_[rows, None] == theirs[at]) & (a_id[rows, None] != c_id[at])

        wants = np.arange(n), np.full(n, least), np.full(n, 1 << 62), column(a, "bar"), allowed
        rows, at, scores = walk(members, column(a, "size"), x, c_id, column(c, "bound"), wants, positives)
        return found(a, ["row"], rows, c, at, scores, {})

    def raised(state: DataFrame, first: DataFrame) -> DataFrame:
        ranked = first.withColumn("n", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"))))
        bars = ranked.where(F.col("n") == positives).select("row", F.col("score").alias("known"))
        return written(state.join(bars, "row", "left").withColumn("bar", F.coalesce("known", "bar")).drop("known"))

    schema = "row long, id long, other long, score long"
    best = lists.topped(state, find_positives, schema, ["row"], positives, raised)
    slot = F.struct(F.col("rank").alias("place"), F.col("id").alias("id"), F.col("score").alias("score"))
    slots = best.where("score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(slot)).alias("slots"))  # ``positives`` at most
    floor = F.array_min(F.transform("slots", lambda s: F.ceil(s["score"] * low / 100))).cast("long")
    state = state.drop("bar").join(slots, "row").withColumn("bar", floor)
    state = written(state.withColumn("slots", F.transform("slots", lambda s: s.withField("bar", F.lit(least).cast("long")))))

    def find_negatives(a: pa.Table, members: np.ndarray, c: pa.Table, x: np.ndarray) -> pa.Table:
        every = a["slots"].to_pylist()
        owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
        flat = [s for one in every for s in one]
        score, bar, place = (np.array([s[n] for s in flat], np.int64) for n in ("score", "bar", "place"))
        mine_, theirs, a_id, c_id = column(a, "label"), column(c, "label"), column(a, "id"), column(c, "id")

        def allowed(rows, at):
            return (mine_[owner[rows], None] != theirs[at]) & (a_id[owner[rows], None] != c_id[at])

        wants = owner, -(-score * low // 100), score * high // 100, bar, allowed
        rows, at, scores = walk(members, column(a, "size"), x, c_id, column(c, "bound"), wants, negatives)
        return found(a, ["row"], owner[rows], c, at, scores, {"place": pa.array(place[rows].astype(np.int32))})

    def raised_slots(state: DataFrame, first: DataFrame) -> DataFrame:
        ranked = first.withColumn("n", F.row_number().over(W.partitionBy("row", "place").orderBy(F.desc("score"))))
        known = ranked.where(F.col("n") == negatives).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("known"))
        wide = state.join(known, "row", "left")
        bar = lambda s: F.coalesce(F.col("known")[s["place"]], s["bar"])
        wide = wide.withColumn("slots", F.transform("slots", lambda s: s.withField("bar", bar(s))))
        lowest = F.array_min(F.transform("slots", lambda s: F.greatest(s["bar"], F.ceil(s["score"] * low / 100).cast("long"))))
        return written(wide.withColumn("bar", lowest).drop("known"))

    schema = "row long, place int, id long, other long, score long"
    got = lists.topped(state, find_negatives, schema, ["row", "place"], negatives, raised_slots)
    got = got.select("row", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = state.select("row", F.col("id").alias("anchor_id"), F.explode("slots").alias("s"))
    pairs = pairs.select("row", "anchor_id", F.col("s.place").alias("place"), F.col("s.id").alias("positive_id"), F.col("s.score").alias("positive_score"))
    return pairs.join(got, ["row", "place"]).select(*out)
