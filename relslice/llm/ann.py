"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample of vectors is cut into balanced parts so that few neighbours are
separated. A small classifier learns which parts a vector's neighbours lie in; it puts every row into its most
probable part and routes each query to several most probable parts, whose rows are ranked by exact distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relslice.llm.arrowmap import add_columns, column
from relslice.scratch import materialize

#: Vectors that the graph and the classifier are fitted on at most.
MAX_SAMPLE = 4096

#: Parts at least, if the sample fills them, and rows per part beyond that; a part has 16 vectors of the sample at least.
LEAST_PARTS, ROWS_PER_PART = 32, 65_536

#: Share of a held-out sample's neighbours that the visited parts must hold; searches are tuned to it.
GOAL = 0.95

#: Candidates and queries that one task compares at most.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row, by exact distances."""
    norms = (x**2).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = norms[at : at + 512, None] + norms - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 30, slack: float = 1.1) -> np.ndarray:
    """A part for each node, none larger than ``slack`` times the mean, with few separated neighbours.

    Nodes start with the nearest of ``parts`` centres that still has room; then, round after round in random
    order, each node moves to the part with room that holds most of its neighbours in either direction.
    """
    n = len(graph)
    room = math.ceil(slack * n / parts)
    centres = x[rng.choice(n, parts, replace=False)].copy()
    for _ in range(10):
        near = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for p in range(parts):
            if (near == p).any():
                centres[p] = x[near == p].mean(axis=0)
    liking = x @ centres.T - (centres**2).sum(axis=1) / 2
    part, load = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-(np.sort(liking, axis=1)[:, -1] - np.sort(liking, axis=1)[:, -2])) if parts > 1 else range(n):
        for p in np.argsort(-liking[i]):
            if load[p] < room:
                part[i] = p
                load[p] += 1
                break
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    both = [np.array([*row, *b]) for row, b in zip(graph.tolist(), back, strict=True)]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts).astype(float)
            votes[(load >= room) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                load[part[i]] -= 1
                load[best] += 1
                part[i] = best
                moved += 1
        if moved < n / 500:
            break
    return part


@dataclass
class Router:
    """A one-layer softmax classifier of vectors into parts."""

    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, parts: int, seed: int = 0, k: int = 10, steps: int = 300) -> Router:
    """Fit graph, partition and classifier on sample vectors. The classifier's goal for a vector is the
    distribution of its own part and its neighbours' parts. Deterministic for the same sample and seed."""
    n, width = x.shape
    parts = max(1, min(parts, n // 8))
    if parts == 1:
        return Router(np.zeros((width, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    scale = np.sqrt((x**2).mean()) or 1.0
    x = x / scale
    graph = neighbour_graph(x, min(k, n - 1))
    part = balanced_partition(graph, x, parts, rng)
    goal = np.zeros((n, parts))
    for column_ in graph.T:
        np.add.at(goal, (np.arange(n), part[column_]), 1.0)
    np.add.at(goal, (np.arange(n), part), 1.0)
    goal /= goal.sum(axis=1, keepdims=True)
    w, b = np.zeros((width, parts)), np.zeros(parts)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        d = (Router(w, b).probabilities(x) - goal) / n
        for i, (value, g) in enumerate(((w, x.T @ d + 1e-5 * w), (b, d.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g**2
            value -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(w / scale, b)


def usable(vector: str) -> Column:
    """Vectors that take part: not null, some component not zero, all components finite and not null."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)


@dataclass
class PartitionIndex:
    """The indexed rows (key, vector, part) as a written table, the router, the number of rows by part, and the probability at which a search may stop."""

    rows: DataFrame
    router: Router
    counts: list[int]
    mass: float = 1.0


def visited(p: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """(parts by falling probability, how many of them add up to ``mass``) for each row of probabilities."""
    order = np.argsort(-p, axis=1, kind="stable")
    needed = (np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) < mass).sum(axis=1) + 1
    return order, np.minimum(needed, p.shape[1])


def tuned_mass(router: Router, x: np.ndarray, held: np.ndarray, goal: float, k: int = 10) -> float:
    """The least probability at which the parts that ``held`` vectors visit hold ``goal`` of their ``k`` nearest among ``x``."""
    if not len(held) or len(x) <= k:
        return 1.0
    d = (held**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * held @ x.T
    near = router.probabilities(x).argmax(axis=1)[np.argpartition(d, k - 1, axis=1)[:, :k]]
    p = router.probabilities(held)
    for mass in np.arange(0.3, 1.0, 0.01):
        order, needed = visited(p, mass)
        place = np.argsort(order, axis=1)  # of each part in the order of visits
        if (np.take_along_axis(place, near, axis=1) < needed[:, None]).mean() >= goal:
            return float(mass)
    return 1.0


def build_index(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int | None = None, max_sample: int = MAX_SAMPLE, seed: int = 0, goal: float = GOAL
) -> PartitionIndex:
    """Fit graph, parts and classifier on at most ``max_sample`` vectors drawn by seeded hashes, and place every row.

    An eighth of the sample isn't fitted on; on it the probability is chosen at which searches stop, so that they
    find about ``goal`` of the neighbours. The number of parts grows with the rows as far as the sample allows.
    Rows with a null key, or with a vector that :func:`usable` leaves out, take no part, nor do those whose
    number of components isn't the most frequent one. Repeated vectors are placed alike.
    """
    good = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    sizes = good.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sizes is None:
        return PartitionIndex(good.withColumn("part", F.lit(0)), Router(np.zeros((0, 1)), np.zeros(1)), [0])
    good = good.where(F.size("vector") == sizes["width"])
    share = min(1.0, 0.95 * max_sample / sizes["count"])
    drawn = good.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(max_sample).toArrow().sort_by("key")
    parts = parts or min(max_sample // 16, max(LEAST_PARTS, math.ceil(sizes["count"] / ROWS_PER_PART)))
    sample = _matrix(drawn["vector"]) if drawn.num_rows else np.zeros((0, sizes["width"]))
    apart = np.arange(len(sample)) % 8 == 7
    router = fit_router(sample[~apart], parts, seed) if len(sample) else Router(np.zeros((sizes["width"], 1)), np.zeros(1))
    mass = tuned_mass(router, sample[~apart], sample[apart], goal)
    placed = add_columns(good, "part int", lambda b: [pa.array(router.probabilities(_matrix(column(b, "vector"))).argmax(axis=1), pa.int32())])
    placed = materialize(placed, "ann")
    counts = [0] * router.bias.size
    for r in placed.groupBy("part").count().collect():
        counts[r["part"]] = r["count"]
    return PartitionIndex(placed, router, counts, mass)


def search(index: PartitionIndex, queries: DataFrame, k: int = 10, mass: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), vec_id, score.

    A query visits its most probable parts until their probabilities add up to ``mass`` (the index's own by default)
    and they hold more than ``k`` rows, and compares with every row there: part by part in blocks of BLOCK_ROWS rows
    and BLOCK_QUERIES queries, each a task's work, of which the ``k`` best of each block are merged. A query that has
    found fewer than ``k`` visits all other parts. The score is the Euclidean distance in double precision; ties go to
    the smaller key. Rows with the query's own key are no candidates. A key that repeats counts once: as a query
    with its smallest vector, as a candidate with its nearest. Unusable queries have no rows.
    """
    width = index.router.weights.shape[0]
    asked = queries.where(usable(vector) & F.col(key).isNotNull() & (F.size(vector) == width)).groupBy(F.col(key).alias("query_id")).agg(F.min(vector).alias("vector"))
    router = index.router

    counts, until = np.array(index.counts), index.mass if mass is None else mass

    def route(batch: pa.RecordBatch) -> list[pa.Array]:
        order, needed = visited(router.probabilities(_matrix(column(batch, "vector"))), until)
        needed = np.minimum(np.maximum(needed, (np.cumsum(counts[order], axis=1) <= k).sum(axis=1) + 1), len(counts))
        return [pa.array([o[:n] for o, n in zip(order.astype(np.int32), needed, strict=True)], pa.list_(pa.int32()))]

    routed = materialize(add_columns(asked, "parts array<int>", route), "queries")
    found = materialize(_visits(index, routed, k), "found")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    every = F.sequence(F.lit(0), F.lit(len(counts) - 1)).cast("array<int>")
    short = routed.where(F.size("parts") < len(counts)).join(enough, "query_id", "left_anti").withColumn("parts", F.array_except(every, "parts"))
    short = materialize(short, "short")
    if not short.isEmpty():
        found = found.unionByName(_visits(index, short, k))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visits(index: PartitionIndex, routed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the nearest rows that each query finds in any of its ``parts``."""
    blocks = F.array(*[F.lit(max(1, math.ceil(c / BLOCK_ROWS))) for c in index.counts])
    left = routed.select("query_id", "vector", F.explode("parts").alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)))
    asking = {r["part"]: r["n"] for r in routed.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    query_blocks = F.array(*[F.lit(math.ceil(asking.get(p, 0) / BLOCK_QUERIES)) for p in range(len(index.counts))])
    left = left.withColumn("query_block", F.pmod(F.xxhash64("query_id"), query_blocks[F.col("part")]).cast("int"))
    spot = F.xxhash64("key", F.monotonically_increasing_id())
    right = index.rows.withColumn("block", F.pmod(spot, blocks[F.col("part")]).cast("int")).where(query_blocks[F.col("part")] > 0)
    right = right.withColumn("query_block", F.explode(F.sequence(F.lit(0), query_blocks[F.col("part")] - 1)))
    by = ["part", "block", "query_block"]
    kind = index.rows.schema["key"].dataType.simpleString()

    def compare(q: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", q.schema.field("query_id").type), ("vec_id", rows.schema.field("key").type), ("score", pa.float64())])
        if not q.num_rows or not rows.num_rows:
            return schema.empty_table()
        a, b, ids = _matrix(q["vector"]), _matrix(rows["vector"]), rows["key"].to_numpy()
        own = q["query_id"].to_numpy()
        norms, found = (b**2).sum(axis=1), []
        slack = 1e-9 * (1 + norms.max())
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            near = (some**2).sum(axis=1)[:, None] + norms - 2 * some @ b.T
            near[own[at : at + 256][:, None] == ids] = np.inf
            edge = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
            for i, row in enumerate(near):
                # All that rounding could put among the k nearest, then exactly.
                c = np.flatnonzero((row <= edge[i] + slack * (1 + edge[i])) & (row < np.inf)) if edge[i] < np.inf else np.flatnonzero(row < np.inf)
                d = np.sqrt(((b[c] - some[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[c], d))[:k]
                found.append((np.full(best.size, own[at + i]), ids[c][best], d[best]))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], schema=schema)

    schema = f"query_id {kind}, vec_id {kind}, score double"
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, schema)
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
