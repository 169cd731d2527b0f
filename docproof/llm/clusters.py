"""Centroid clustering with heap-ordered bounds, in whole numbers.

Each block of vectors keeps one heap per cluster. An entry is a vector's gap, its distance to the
second nearest centroid less that to its own, plus the drift its cluster had accumulated when it
entered. When centroids move, only the cluster's accumulated drift grows: its own centroid's step
and the largest step of any other. Entries whose gap that drift has used up are popped, exactly
measured against all centroids and pushed anew; no other vector is looked at, since it cannot have
changed its cluster. Sums per cluster are carried on by what the moved vectors take along.
"""

from functools import reduce
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docproof.llm.integers import longs, narrow, whole, widen
from docproof.llm.support import discard, ship_package, stored
from docproof.llm.vectors import is_finite_vector

BLOCK = 8192
# Doubles hold whole numbers exactly below this.
EXACT = 2.0**52
# Bounds are kept in doubles; a gap counts as used up this much (relatively) too early.
SLACK = 1e-9

STATE = "ids binary, known binary, rows binary, clusters binary, keys binary, counts array<long>, sums array<long>, looked_at long"


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of 64-bit integer vectors, rows x centroids."""
    reach = float(max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * reach * reach * centroids.shape[1] >= EXACT:
        if 4 * reach * reach * centroids.shape[1] >= 2.0**63:
            raise ValueError("squared distances are beyond 64 bits")
        return np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    x, c = rows.astype(np.float64), centroids.astype(np.float64)
    products = x @ c.T
    return ((x * x).sum(axis=1)[:, None] - 2 * products + (c * c).sum(axis=1)).astype(np.int64)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row its nearest centroid (ties: the smaller number), squared distance, and gap to the second nearest."""
    squares = squared_distances(rows, centroids)
    own = squares.argmin(axis=1)
    lowest = squares[np.arange(len(rows)), own]
    if squares.shape[1] == 1:
        return own, lowest, np.full(len(rows), np.inf)
    second = np.partition(squares, 1, axis=1)[:, 1]
    return own, lowest, np.sqrt(second.astype(np.float64)) - np.sqrt(lowest.astype(np.float64))


def steps(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much each cluster's gaps may shrink: its centroid's step and the largest of the others."""
    moved = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
    others = [np.delete(moved, j).max(initial=0) for j in range(len(moved))]
    return moved + np.array(others)


class Heaps:
    """One heap per cluster of (gap plus the drift at entry, place in the block)."""

    def __init__(self, clusters: np.ndarray, keys: np.ndarray, k: int):
        self.clusters, self.keys = clusters.copy(), keys.copy()
        self.heaps = [[] for _ in range(k)]
        for place, (cluster, key) in enumerate(zip(clusters.tolist(), keys.tolist(), strict=True)):
            self.heaps[cluster].append((key, place))
        for heap in self.heaps:
            heapify(heap)

    def pop_expired(self, drift: np.ndarray) -> np.ndarray:
        """Take out every vector whose gap its cluster's drift may have used up."""
        out = []
        for heap, used in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= used:
                out.append(heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, places: np.ndarray, clusters: np.ndarray, gaps: np.ndarray, drift: np.ndarray) -> None:
        keys = gaps - SLACK * (1 + np.abs(gaps)) + drift[clusters]
        keys = np.where(gaps > 0, keys, -np.inf)
        self.clusters[places], self.keys[places] = clusters, keys
        for cluster, key, place in zip(clusters.tolist(), keys.tolist(), places.tolist(), strict=True):
            heappush(self.heaps[cluster], (key, place))


def _start(scale: float, size: int):
    """Blocks of rows (vec_id, v) without clusters yet."""
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                ids, rows = piece.column(0), whole(piece.column(1), scale)
                blobs = [ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), narrow(rows)]
                empty = [[pa.array([None], kind)] for kind in (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([b], pa.binary()) for b in blobs], *[e[0] for e in empty], pa.array([0], pa.int64())], names=_names()
                )

    return pack


def _names() -> list[str]:
    return [c.split()[0] for c in STATE.split(", ")]


def _rows_of(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(name)[at].as_py() for name in batch.schema.names}


def _assign(centroids: np.ndarray, drift: np.ndarray):
    """One round over blocks: pop what has expired, measure it, push it; with what counts and sums gained."""
    import pyarrow as pa

    k, dims = centroids.shape

    def run(batches):
        for row in _rows_of(batches):
            n = len(row["ids"]) // 8
            rows = widen(row["rows"], n)
            counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
            if row["clusters"] is None:
                heaps, popped = Heaps(np.zeros(0, np.int64), np.zeros(0), k), np.arange(n)
                heaps.clusters, heaps.keys = np.zeros(n, np.int64), np.zeros(n)
            else:
                heaps = Heaps(np.frombuffer(row["clusters"], np.int32).astype(np.int64), np.frombuffer(row["keys"]), k)
                popped = heaps.pop_expired(drift)
                np.subtract.at(counts, heaps.clusters[popped], 1)
                np.subtract.at(sums, heaps.clusters[popped], rows[popped])
            if len(popped):
                clusters, _, gaps = nearest(rows[popped], centroids)
                heaps.push(popped, clusters, gaps, drift)
                np.add.at(counts, clusters, 1)
                np.add.at(sums, clusters, rows[popped])
            blobs = [row["ids"], row["known"], row["rows"], heaps.clusters.astype(np.int32).tobytes(), heaps.keys.tobytes()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([b], pa.binary()) for b in blobs], *[pa.array([v.ravel().tolist()], pa.list_(pa.int64())) for v in (counts, sums)],
                 pa.array([len(popped)], pa.int64())], names=_names(),
            )

    return run


def _total(state: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of the blocks' arrays; ``size`` numbers in all."""
    summed = state.select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(size, object)
    for r in summed.collect():
        out[r["at"]] = r["n"]
    return out


def _measured(centroids: np.ndarray):
    """Rows (vec_id, cluster, distance) of finished blocks."""
    import pyarrow as pa

    def run(batches):
        for row in _rows_of(batches):
            ids = longs(row["ids"])
            known = np.frombuffer(row["known"], bool)
            clusters = np.frombuffer(row["clusters"], np.int32)
            distances = ((widen(row["rows"], len(ids)) - centroids[clusters]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~known), pa.array(clusters), pa.array(distances)], names=["vec_id", "cluster", "distance"]
            )

    return run


def _per_cluster(values: list, kind: str) -> Column:
    whens = [(F.col("cluster") == i, F.lit(v).cast(kind)) for i, v in enumerate(values)]
    return reduce(lambda done, w: done.when(*w), whens[1:], F.when(*whens[0]))


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors of exactly ``dims`` components, none null or non-finite, take part; components x become
    floor(scale * x). Centroids start as the ``k`` vectors with the smallest hash of seed and id. Each
    round assigns every vector to its nearest centroid, ties to the smaller number, and moves
    centroids to the floors of their vectors' means; empty clusters stay where they are. ``distance``
    is squared, to the centroid after the last round.

    Rows that repeat an id are vectors of their own; of equal ids the smallest vector may start as
    centroid first. Null ids come back as null and start as centroids only if there are fewer than
    ``k`` others. With fewer than ``k`` vectors there are fewer clusters; without any the result is
    empty. Other columns are ignored. Squared distances beyond 64 bits raise an error.

    Blocks of vectors with their heaps are rewritten to the shared folder each round, in map-only
    jobs; only the ``k`` centroids and their sums come to the driver.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(
        (F.size(vector) == dims) & is_finite_vector(F.col("v"))
    )
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    chosen = good.orderBy(by_hash, "v").limit(k).collect()
    if not chosen:
        return spark.createDataFrame([], RESULT)
    centroids = np.floor(scale * np.array([r["v"] for r in chosen], np.float64)).astype(np.int64)
    drift = np.zeros(len(centroids))
    counts, sums = np.zeros(len(centroids), object), np.zeros(centroids.size, object)
    state = stored(good.mapInArrow(_start(scale, BLOCK), STATE), "blocks")
    for turn in range(rounds + 1):
        after = stored(state.mapInArrow(_assign(centroids, drift), STATE), "assigned")
        discard(state)
        state = after
        if turn == rounds:
            break
        counts, sums = counts + _total(state, "counts", len(counts)), sums + _total(state, "sums", len(sums))
        means = [[int(s) // int(n) for s in row] if n else None for n, row in zip(counts, sums.reshape(centroids.shape), strict=True)]
        moved = np.array([c if m is None else m for c, m in zip(centroids.tolist(), means, strict=True)], np.int64)
        drift = drift + steps(centroids, moved)
        centroids = moved
    found = state.select("ids", "known", "rows", "clusters").mapInArrow(_measured(centroids), "vec_id long, cluster int, distance long")
    inertia = [0] * len(centroids)
    for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect():
        inertia[r["cluster"]] = r["n"]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select(
        "vec_id", "cluster", "distance", _per_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), _per_cluster(digests, "string").alias("centroid_sha256"),
    )
