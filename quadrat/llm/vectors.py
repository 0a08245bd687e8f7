"""Near-duplicate vectors through a robust-pruned neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.graph import components, star_edges
from quadrat.llm.shared import keep_freed_memory, written

LEAST = 0.9
#: Distinct vectors that cluster centres are fitted on, most centres, vectors of a cluster aimed at.
FIT_ROWS, MOST_CENTRES, CLUSTER = 10_000, 512, 1000
#: Most members of a shard; a larger cluster is dealt over more shards.
SHARD = 3000
#: Out-degree, nearest and random candidates of a node, slack of the pruning rule, beam of the search.
DEGREE, NEAR, RANDOM, ALPHA, BEAM = 16, 48, 8, 1.2, 16
#: How much less similar than the nearest a visited centre may be, tried in turn until the audit passes.
SLACKS = (0.15, 0.35, 2.0)
AUDIT_ROWS, AUDIT_RECALL = 4096, 0.97
#: Least weight of the audited nodes with links, each counted as one part of its links, so that one large group is not many.
AUDIT_WEIGHT = 100
MARGIN = 1e-4  # of single-precision search before verification


def unit_rows(rows: list[list[float]]) -> np.ndarray:
    """Vectors of one length in double precision, scaled to length one without overflow."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its centre."""
    centres = x[np.random.default_rng(3).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for c in range(k):
            mine = x[near == c]
            if len(mine):
                total = mine.sum(0)
                centres[c] = total / max(np.linalg.norm(total), 1e-12)
    return centres


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Out-neighbours (rows x degree, -1 for none) of each vector of a shard.

    Candidates are a node's nearest vectors and a few random ones. The nearest
    is taken; every candidate that is closer to it than to the node, by the
    factor alpha, goes; and so on.
    """
    n = len(x)
    rng = np.random.default_rng(n)
    near = min(NEAR, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if near < 1:
        return out
    for low in range(0, n, 256):
        rows = np.arange(low, min(low + 256, n))
        similar = x[rows] @ x.T
        similar[np.arange(len(rows)), rows] = -2
        candidates = np.concatenate(
            [np.argpartition(-similar, near - 1, axis=1)[:, :near], rng.integers(0, n, (len(rows), RANDOM))], 1
        )
        far = 1 - np.take_along_axis(similar, candidates, 1)
        far[candidates == rows[:, None]] = np.inf
        vectors = x[candidates]
        for r in range(degree):
            pick = far.argmin(1)
            every = np.arange(len(rows))
            live = np.isfinite(far[every, pick])
            if not live.any():
                break
            chosen = candidates[every, pick]
            out[rows[live], r] = chosen[live]
            between = 1 - np.matmul(vectors, x[chosen][:, :, None])[:, :, 0]
            far[(alpha * between <= far) | (candidates == chosen[:, None])] = np.inf
    return out


def symmetric(edges_from: np.ndarray, edges_to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges in both directions as an offset table: ``to[start[i]:start[i + 1]]`` are the neighbours of i."""
    pairs = np.unique(np.concatenate([edges_from * n + edges_to, edges_to * n + edges_from]))
    return np.searchsorted(pairs // n, np.arange(n + 1)), pairs % n


def neighbours(start: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of the given nodes one after the other, and the index of the node each belongs to."""
    count = start[nodes + 1] - start[nodes]
    owner = np.repeat(np.arange(len(nodes)), count)
    return to[np.repeat(start[nodes] - (np.cumsum(count) - count), count) + np.arange(len(owner))], owner


def reachable(start: np.ndarray, to: np.ndarray, root: int) -> np.ndarray:
    seen = np.zeros(len(start) - 1, bool)
    seen[root] = True
    front = np.array([root])
    while len(front):
        near = np.unique(neighbours(start, to, front)[0])
        front = near[~seen[near]]
        seen[front] = True
    return seen


def connected(x: np.ndarray, a: np.ndarray, b: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour table in which every node can be reached from ``root``: islands are tied to the nearest reached node."""
    start, to = symmetric(a, b, len(x))
    while not (seen := reachable(start, to, root)).all():
        island, main = np.flatnonzero(~seen)[:1024], np.flatnonzero(seen)
        best = (x[island] @ x[main].T).argmax(1)
        a, b = np.concatenate([a, island]), np.concatenate([b, main[best]])
        start, to = symmetric(a, b, len(x))
    return start, to


def range_search(x: np.ndarray, start: np.ndarray, to: np.ndarray, root: int, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of at least the given similarity, found from ``root``.

    A beam search walks greedily towards each query; then every node in range
    is expanded until no new one comes, so that a whole dense group is found.
    """
    n = len(x)
    width = int((start[1:] - start[:-1]).max(initial=0))
    table = np.full((n, max(width, 1)), -1, np.int64)
    for i in range(n):
        table[i, : start[i + 1] - start[i]] = to[start[i] : start[i + 1]]
    for low in range(0, len(q), 512):
        part = q[low : low + 512]
        m = len(part)
        every = np.arange(m)
        seen = np.zeros((m, n), bool)
        seen[:, root] = True
        beam = np.full((m, BEAM), -1, np.int64)
        beam[:, 0] = root
        score = np.full((m, BEAM), -3.0, np.float32)
        score[:, 0] = part @ x[root]
        done = beam < 0
        hits = [np.flatnonzero(score[:, 0] >= least)]
        hit_nodes = [np.full(len(hits[0]), root)]
        while True:
            best = np.where(done, -4, score).argmax(1)
            rows = every[~done[every, best]]
            if not len(rows):
                break
            done[rows, best[rows]] = True
            near = table[beam[rows, best[rows]]]
            new = (near >= 0) & ~seen[rows[:, None], near]
            r, c = np.nonzero(new)
            nodes, of = near[r, c], rows[r]
            seen[of, nodes] = True
            value = np.einsum("ij,ij->i", part[of], x[nodes])
            inside = value >= least
            hits.append(of[inside])
            hit_nodes.append(nodes[inside])
            fresh = np.full(near.shape, -3.0, np.float32)
            fresh[r, c] = value
            all_score = np.concatenate([score[rows], fresh], 1)
            all_beam = np.concatenate([beam[rows], near], 1)
            all_done = np.concatenate([done[rows], ~new], 1)
            keep = np.argpartition(-all_score, BEAM - 1, axis=1)[:, :BEAM]
            score[rows], beam[rows], done[rows] = (np.take_along_axis(v, keep, 1) for v in (all_score, all_beam, all_done))
        of, nodes = np.concatenate(hits), np.concatenate(hit_nodes)
        while len(of):
            yield of + low, nodes
            next_of, next_nodes = [], []
            for cut in range(0, len(of), 20_000):
                near, owner = neighbours(start, to, nodes[cut : cut + 20_000])
                key = np.unique(of[cut : cut + 20_000][owner] * n + near)
                key = key[~seen.ravel()[key]]
                seen.ravel()[key] = True
                a, b = key // n, key % n
                inside = np.einsum("ij,ij->i", part[a], x[b]) >= least
                next_of.append(a[inside])
                next_nodes.append(b[inside])
            of, nodes = np.concatenate(next_of), np.concatenate(next_nodes)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one shard at a time, from batches sorted by shard (first column)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = np.array(batch.column(0).to_pylist())
        bounds = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(bounds, bounds[1:]):
            part = batch.slice(a, b - a)
            if held and len(part) and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            if len(part):
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def unpack(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors kept as bytes of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each shard's pruned graph, by node name."""
    keep_freed_memory()
    for rows in groups_of(batches):
        x, node = unpack(rows.column("unit")).astype(np.float32), rows.column("node").to_numpy()
        out = robust_prune(x)
        from_, rank = np.nonzero(out >= 0)
        a, b = node[from_], node[out[from_, rank]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["node", "to"])


def block_search(x: np.ndarray, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of at least the given similarity, by comparing all."""
    for low in range(0, len(q), 512):
        of, nodes = np.nonzero(q[low : low + 512] @ x.T >= least)
        yield of + low, nodes


def search(batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
    """Range search of all queries of a shard over its members; counts and a spanning star of the links.

    With ``every`` all queries are compared with all members instead.

    ``role``: 0 member whose first cluster this is, 1 other member, 2 query.
    Only role-0 members are counted, so no link counts twice.
    """
    keep_freed_memory()
    for rows in groups_of(batches):
        role = rows.column("role").to_numpy()
        member = np.flatnonzero(role < 2)
        if not len(member):
            continue
        node, size, units = rows.column("node").to_numpy(), rows.column("n").to_numpy(), unpack(rows.column("unit"))
        double = units[member]
        x = double.astype(np.float32)
        names = node[member]
        order = np.argsort(names)
        lists = rows.column("to").to_pylist()
        from_ = np.repeat(np.arange(len(member)), [len(lists[i] or ()) for i in member.tolist()])
        to = np.array([t for i in member.tolist() for t in lists[i] or ()], np.int64)
        at = np.minimum(np.searchsorted(names, to, sorter=order), len(names) - 1)
        inside = names[order[at]] == to
        queries = np.flatnonzero(role != 1)
        links = np.zeros(len(queries), np.int64)
        far, near = [], []
        wanted = units[queries].astype(np.float32)
        if every:
            hits = block_search(x, wanted, LEAST - MARGIN)
        else:
            root = int((x @ x.mean(0)).argmax())
            start, table = connected(x, from_[inside], order[at[inside]], root)
            hits = range_search(x, start, table, root, wanted, LEAST - MARGIN)
        for q, hit in hits:
            for low in range(0, len(q), 100_000):
                a, b = q[low : low + 100_000], hit[low : low + 100_000]
                exact = np.einsum("ij,ij->i", units[queries[a]], double[b]) >= LEAST
                other = node[queries[a]] != names[b]
                counted = exact & other & (role[member[b]] == 0)
                links += np.bincount(a[counted], size[member[b[counted]]], len(queries)).astype(np.int64)
                joined = exact & other
                if joined.any():
                    both, place = np.unique(np.concatenate([node[queries[a[joined]]], names[b[joined]]]), return_inverse=True)
                    half = len(place) // 2
                    f, r = star_edges(both, place[:half], place[half:])
                    far.append(f)
                    near.append(r)
        found = links > 0
        columns = [np.concatenate([node[queries[found]], *far]), np.concatenate([node[queries[found]], *near])]
        count = np.concatenate([links[found], np.zeros(len(columns[0]) - int(found.sum()), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, count)], ["a", "b", "links"])


def placed(nodes: DataFrame, centres: dict[int, np.ndarray], slack: float) -> DataFrame:
    """``dim, cluster, role, node, n, unit``: members of the two nearest clusters, queries of all within ``slack``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            dims = np.array([len(v) // 8 for v in batch.column(2).to_pylist()])
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                x = unpack(part.column(2))
                middle = centres.get(dim, np.zeros((1, dim)))
                similar = x @ middle.T
                rank = np.argsort(-similar, axis=1, kind="stable")
                best = np.take_along_axis(similar, rank[:, :1], 1)
                r, c = np.nonzero(similar >= best - slack)
                role = np.where(c == rank[r, 0], 0, 2)
                if len(middle) > 1:
                    second = rank[:, 1]
                    role[c == second[r]] = 1
                    missing = np.flatnonzero(similar[np.arange(len(x)), second] < best[:, 0] - slack)
                    # A role-1 member is a query there as well, where it is close enough.
                    extra = np.flatnonzero(role == 1)
                    r, c, role = np.concatenate([r, r[extra], missing]), np.concatenate([c, c[extra], second[missing]]), np.concatenate([role, np.full(len(extra), 2), np.ones(len(missing), np.int64)])
                taken = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), dim, np.int32)), pa.array(c.astype(np.int32)), pa.array(role.astype(np.int32)), *taken.columns],
                    ["dim", "cluster", "role", "node", "n", "unit"],
                )

    return nodes.select("node", "n", "unit").mapInArrow(run, "dim int, cluster int, role int, node long, n long, unit binary")


def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``shard``: members of a crowded cluster are dealt over slices by hash, queries, also those of its home members, go to all of them."""
    rows = rows.join(F.broadcast(sizes), ["dim", "cluster"])  # a row per centre
    own = F.pmod(F.xxhash64("node"), "slices").cast("int")
    slices = F.explode(F.when(F.col("role") == 1, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumn("slice", slices)
    rows = rows.withColumn("role", F.when((F.col("role") == 0) & (F.col("slice") != own), 2).otherwise(F.col("role")))
    return rows.withColumn("shard", F.concat_ws("/", "dim", "cluster", "slice"))


def exact_counts(nodes: DataFrame, sample: list) -> dict[int, int]:
    """Links of the sampled nodes against all rows, block by block (the sample is bounded)."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r.unit) // 8 for r in sample}:
        mine = [r for r in sample if len(r.unit) // 8 == dim]
        by_dim[dim] = np.array([r.node for r in mine]), np.frombuffer(b"".join(r.unit for r in mine), "<f8").reshape(len(mine), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                dims = np.array([len(v) // 8 for v in part.column(2).to_pylist()])
                for dim, (names, q) in by_dim.items():
                    rows = part.take(pa.array(np.flatnonzero(dims == dim)))
                    if not rows.num_rows:
                        continue
                    near = (q @ unpack(rows.column(2)).T >= LEAST) & (names[:, None] != rows.column(0).to_numpy()[None])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(near @ rows.column(1).to_numpy())], ["node", "links"])

    got = nodes.select("node", "n", "unit").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    return {r.node: r.links for r in got.collect()}  # one row per sampled node


def recall_holds(expected: dict[int, int], got: dict[int, int], whole: bool) -> bool:
    """Whether the audited nodes' mean share of links found is high enough, as it is and with each node weighted by 1 / its links.

    The weights keep one large group from standing for all others. Too few
    nodes with links prove nothing, unless the ``whole`` table is audited.
    """
    linked = [n for n, links in expected.items() if links]
    weight = np.array([1 / expected[n] for n in linked])
    if not linked or weight.sum() < AUDIT_WEIGHT:
        return whole and all(got.get(n, 0) >= expected[n] for n in linked)
    share = np.array([min(1.0, got.get(n, 0) / expected[n]) for n in linked])
    return bool(share.mean() >= AUDIT_RECALL and share @ weight >= AUDIT_RECALL * weight.sum())


def linked_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` of every vector; links are pairs of cosine 0.9 or more.

    Equal vectors are one node. Centres fitted on at most 10,000 vectors place
    each node in its two nearest clusters; a pruned graph is built per shard,
    each node's lists are united, and every node searches the united graph of
    its own and all similarly near clusters, from their medoids. Pairs found
    are checked in double precision. Recall is audited node by node on up to
    4,096 nodes, or 10,000 if these have few links, against all rows; below 0.97,
    or with too few links to tell, the search is repeated over more clusters, in
    the end by comparing all rows.

    Null, zero, empty, or vectors with null or non-finite components have no
    link and are components of their own, as are vectors compared with ones of
    another length. Rows with equal vectors link with one another. A null key
    keeps its row and is passed over in naming its component. An empty table
    gives no row. Other columns are ignored. Keys are integers.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.coalesce(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0.0))))
    grouped = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("key").alias("least"), F.count("*").alias("n"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit_rows([v])[0].astype("<f8").tobytes() for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.binary())], ["v", "least", "n", "unit"])

    nodes = grouped.mapInArrow(scale, "v array<double>, least long, n long, unit binary")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))

    total = nodes.count()
    sample = nodes.select("node", "n", "unit").orderBy(F.xxhash64("unit"), "node").limit(FIT_ROWS).collect()
    centres = {}
    for dim in {len(r.unit) // 8 for r in sample}:
        x = np.frombuffer(b"".join(r.unit for r in sample if len(r.unit) == 8 * dim), "<f8").reshape(-1, dim)
        k = min(MOST_CENTRES, max(1, math.ceil(total / CLUSTER * len(x) / len(sample))), max(1, len(x) // 4))
        centres[dim] = fit_centres(x, k)
    audit = sample[:AUDIT_ROWS]
    expected = exact_counts(nodes, audit) if audit else {}
    if sum(1 / links for links in expected.values() if links) < AUDIT_WEIGHT and len(sample) > len(audit):
        audit = sample
        expected = exact_counts(nodes, audit)

    members = placed(nodes, centres, 0.0).where("role < 2")
    sizes = members.groupBy("dim", "cluster").count()
    sizes = written(sizes.select("dim", "cluster", F.ceil(F.col("count") / SHARD).cast("int").alias("slices")))
    parts = max(8, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096))
    sharded = dealt(members, sizes).where("role < 2").select("shard", "node", "unit").repartition(parts, "shard").sortWithinPartitions("shard")
    edges = sharded.mapInArrow(build, "node long, to long")
    united = written(edges.groupBy("node").agg(F.array_distinct(F.collect_list("to")).alias("to")))  # two lists of at most 16
    whole = len(audit) == total
    unknown = not whole and sum(1 / links for links in expected.values() if links) < AUDIT_WEIGHT
    for slack, exact in [(max(SLACKS), True)] if unknown else [*((s, False) for s in SLACKS), (max(SLACKS), True)]:
        asked = dealt(placed(nodes, centres, slack), sizes).join(united.withColumn("role_", F.lit(True)), "node", "left")
        asked = asked.withColumn("to", F.when(F.col("role") < 2, F.col("to")))
        asked = asked.select("shard", "role", "node", "n", "unit", "to").repartition(parts, "shard").sortWithinPartitions("shard")
        found = written(asked.mapInArrow(partial(search, every=exact), "a long, b long, links long"))
        counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        if exact or not audit:
            break
        names = spark.createDataFrame([(r.node,) for r in audit], "node long")
        got = {r.node: r.links for r in counts.join(F.broadcast(names), "node").collect()}
        if recall_holds(expected, got, whole):
            break
    root = components(found.where("a != b").select("a", "b"))
    named = nodes.select("v", "node", "least", "n").join(root, "node", "left").join(counts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "v", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id")
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
