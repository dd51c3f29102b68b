"""Centroid clustering in whole numbers with heap-ordered bounds.

A vector's gap is the distance to its second nearest centroid less the distance
to its own. When centroids move, the gap shrinks by no more than the move of its
own centroid plus the largest move of another. Every cluster accumulates that
sum as its drift, and keeps its vectors in a heap by gap plus the drift at the
time the gap was measured: while that key is above the cluster's drift, no other
centroid can be nearer. A round pops what has expired, rescans these vectors
against all centroids and pushes them into the heap of their nearest one; the
others are not looked at. Gaps are rounded down and drifts up, and equal
distances count as expired, so the rounding of square roots changes nothing:
assignments are those of exact arithmetic.

Vectors lie in blocks of ``ROWS``, one row of a table each: the components, the
cluster of each vector and one heap per cluster. A round is one pass over the
blocks, written to the shared checkpoint folder; it returns how the clusters'
sums and counts change, added up over the cluster to one number per component,
and the driver holds the centroids. If no centroid moves, the rounds left change
nothing and are not run.

Components become floor(1024 x). Squared distances are 64-bit numbers: a vector
with a component beyond ``LARGEST`` could exceed them and is an error.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component are left out; a null vec_id counts as the empty text where
ids are hashed and stays null; repeated rows are clustered one by one, equal ids
are taken in the order of their components as first centroids; with fewer
vectors than clusters every vector starts one; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import checkpointed, shared_folder, small_batches, table

CLUSTERS = 8
COMPONENTS = 64
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Vectors of a block.
ROWS = 512
#: Largest component (times SCALE) whose squared distances fit 64 bits.
LARGEST = 2 ** 27
#: Relative error that gaps and drifts allow for.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, x): the usable vectors as whole numbers."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.filter((F.size("embedding") == components) & F.coalesce(finite, F.lit(False)))
    fits = F.forall(x, lambda v: F.abs(v) < LARGEST / SCALE)
    checked = F.when(fits, F.transform(x, lambda v: F.floor(v * SCALE).cast("int"))).otherwise(
        F.raise_error(F.lit(f"a component is beyond {LARGEST / SCALE}: squared distances would not fit 64 bits")).cast("array<int>"))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), checked.alias("x"))


def _seed_hash() -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


@dataclass
class Centroids:
    """Whole-number centroids and, for each cluster, the accumulated drift."""
    at: np.ndarray
    drift: np.ndarray

    def moved(self, to: np.ndarray) -> Centroids:
        step = np.sqrt(((to - self.at) ** 2).sum(1).astype(float)) * (1 + SLACK)
        others = np.array([max([0.0, *np.delete(step, c).tolist()]) for c in range(len(step))])
        return Centroids(to, (self.drift + step + others) * (1 + SLACK))


def scan(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number) and the key of
    its gap."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centroids.at], 1)
    own = d.argmin(1)
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    near = np.partition(d, 1, axis=1)[:, :2].astype(float)
    gap = np.sqrt(near[:, 1]) * (1 - SLACK) - np.sqrt(near[:, 0]) * (1 + SLACK)
    return own, gap + centroids.drift[own] * (1 - SLACK)


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """For each cluster the sum of its vectors and, last, their count."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    np.add.at(out[:, :-1], cluster, x)
    out[:, -1] = np.bincount(cluster, minlength=k)
    return out


class Block:
    """Vectors with their clusters and the clusters' heaps of (key, vector)."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, heaps: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.cluster, self.heaps = x, cluster, heaps

    @staticmethod
    def first(x: np.ndarray, centroids: Centroids) -> tuple[Block, np.ndarray]:
        cluster, key = scan(x, centroids)
        heaps = []
        for c in range(len(centroids.at)):
            own = np.flatnonzero(cluster == c)
            own = own[np.argsort(key[own], kind="stable")]  # a sorted list is a heap
            heaps.append((key[own], own.astype(np.int32)))
        return Block(x, cluster, heaps), sums(x, cluster, len(centroids.at))

    def round(self, centroids: Centroids) -> tuple[np.ndarray, int]:
        """Reassign the vectors whose gap expired: how the sums change, and how
        many were rescanned."""
        k, opened, expired = len(centroids.at), {}, []
        for c, (key, own) in enumerate(self.heaps):
            if len(key) and key[0] <= centroids.drift[c]:
                heap = opened[c] = list(zip(key.tolist(), own.tolist()))
                while heap and heap[0][0] <= centroids.drift[c]:
                    expired.append(heapq.heappop(heap)[1])
        if not expired:
            return np.zeros((k, self.x.shape[1] + 1), np.int64), 0
        at = np.array(expired)
        before = self.cluster[at]
        now, key = scan(self.x[at], centroids)
        for i, c, g in zip(expired, now.tolist(), key.tolist()):
            if c not in opened:
                opened[c] = list(zip(self.heaps[c][0].tolist(), self.heaps[c][1].tolist()))
            heapq.heappush(opened[c], (g, i))
        for c, heap in opened.items():
            self.heaps[c] = (np.array([g for g, _ in heap], float), np.array([i for _, i in heap], np.int32))
        self.cluster[at] = now
        moved = now != before
        return sums(self.x[at[moved]], now[moved], k) - sums(self.x[at[moved]], before[moved], k), len(at)


_STATE = "vec_id array<bigint>, x binary, cluster binary, heap_sizes binary, keys binary, vectors binary, change array<bigint>, rescanned bigint"
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def _state(rows: list[tuple[pa.Scalar, Block, np.ndarray, int]]) -> pa.RecordBatch:
    columns = list(zip(*((ids, b.x.astype("<i4").tobytes(), b.cluster.astype("<i4").tobytes(),
                          np.array([len(k) for k, _ in b.heaps], "<i4").tobytes(), np.concatenate([k for k, _ in b.heaps]).astype("<f8").tobytes(),
                          np.concatenate([v for _, v in b.heaps]).astype("<i4").tobytes(), change.ravel().tolist(), n)
                         for ids, b, change, n in rows))) or [()] * len(_FIELDS)
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _FIELDS)


def _blocks(batch: pa.RecordBatch, components: int) -> Iterator[tuple[list, Block]]:
    column = {n: batch.column(batch.schema.get_field_index(n)) for n in _FIELDS}
    for i in range(batch.num_rows):
        read = lambda n, t: np.frombuffer(column[n][i].as_py(), t)  # noqa: B023, E731
        end = np.cumsum(read("heap_sizes", "<i4"))[:-1]
        heaps = list(zip(np.split(read("keys", "<f8"), end), np.split(read("vectors", "<i4"), end)))
        yield column["vec_id"][i].as_py(), Block(read("x", "<i4").reshape(-1, components).astype(np.int64), read("cluster", "<i4").astype(np.int64), heaps)


def _starting(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(parts)
            return _state([(ids, *Block.first(x, centroids), len(x))])

        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            for a in range(0, batch.num_rows, ROWS):
                ids += batch.column(0)[a:a + ROWS].to_pylist()
                parts.append(x[a:a + ROWS])
                n += len(parts[-1])
                if n >= ROWS:
                    yield block()
                    ids, parts, n = [], [], 0
        if n:
            yield block()
    return run


def _rounding(centroids: Centroids):
    components = centroids.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _state([(ids, block, *block.round(centroids)) for ids, block in _blocks(batch, components)])
    return run


def _measuring(centroids: Centroids):
    """(vec_id, cluster, distance) of every vector."""
    components = centroids.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in _blocks(batch, components):
                distance = ((block.x - centroids.at[block.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(block.cluster.astype(np.int32)), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])
    return run


def _changes(state: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The blocks' changes added up: one row per cluster and component."""
    found = state.select(F.posexplode("change").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(shape[0] * shape[1], object)
    for r in found:
        out[r["at"]] = r["n"]
    return out.reshape(shape)


def fit(vectors: DataFrame, clusters: int = CLUSTERS, components: int = COMPONENTS, rounds: int = ROUNDS) -> tuple[DataFrame, Centroids] | None:
    """The blocks after the last assignment and the centroids; None without any
    usable vector."""
    spark = vectors.sparkSession
    shared_folder(spark)
    small_batches(spark)
    whole = whole_vectors(vectors, components)
    first = whole.orderBy(_seed_hash(), "x").limit(clusters).collect()
    if not first:
        return None
    now = Centroids(np.array([r["x"] for r in first], np.int64), np.zeros(len(first)))
    state = checkpointed(whole.mapInArrow(_starting(now), _STATE))
    total = np.zeros((len(first), components + 1), object)
    for _ in range(rounds):
        total = total + _changes(state, total.shape)
        to = np.array([[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(total, now.at)], np.int64)
        if (to == now.at).all():
            break
        now = now.moved(to)
        state = checkpointed(state.mapInArrow(_rounding(now), _STATE))
    return state, now


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, components: int = COMPONENTS, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance (squared, to its
    centroid), cluster_inertia, inertia, centroid_sha256."""
    fitted = fit(vectors, clusters, components, rounds)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    state, centroids = fitted
    measured = state.mapInArrow(_measuring(centroids), "vec_id bigint, cluster int, distance bigint")
    inertia = {r["cluster"]: r["n"] for r in measured.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row per cluster
    per = [(c, inertia.get(c, 0), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.at.tolist())]
    of = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in per]), F.col("cluster") + 1)
    return measured.select("vec_id", "cluster", "distance", of(1).cast("bigint").alias("cluster_inertia"),
                           F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of(2).alias("centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    """Assignment and update, written out round by round over (vector, component)."""
    kept = f"len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {COMPONENTS}"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id) AS r, vec_id,
  list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {kept})""",
             "c0 AS MATERIALIZED (SELECT CAST(r - 1 AS INTEGER) AS cluster, x FROM v WHERE r <= " + str(CLUSTERS) + ")"]
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, min(distance) AS distance, arg_min(cluster, (distance, cluster)) AS cluster FROM (
  SELECT r, cluster, CAST(list_sum(list_transform(list_zip(v.x, c{n}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM v CROSS JOIN c{n}) GROUP BY r)""")
        if n < ROUNDS:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m.x, c{n}.x) AS x FROM c{n} LEFT JOIN (
  SELECT cluster, list(y ORDER BY i) AS x FROM (SELECT cluster, i, CAST(floor(sum(e)::DOUBLE / count(*)) AS BIGINT) AS y
    FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, {COMPONENTS + 1})) AS i FROM v JOIN a{n} USING (r)) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c ON a.cluster = c.cluster"""


SQL = _sql()
