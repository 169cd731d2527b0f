import hashlib
import math

import numpy as np
import pytest

from docproof.llm import clusters as C


def rows(n=300, dims=8, seed=5):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dims)) + 3 * rng.integers(0, 4, (n, 1)))]
    for i in (20, 40, 41, 42):
        out[i] = (i, out[60][1])
    out += [(900, None), (950, [math.nan] * dims), (951, [None] * dims), (952, [math.inf] * dims), (1000, []), (1001, [1.0] * (dims + 1)),
            (None, [0.5] * dims), (1100, [0.0] * dims)]
    return out + [out[3], (4, [9.0] * dims)]


def brute(data, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [v for _, _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = [sum(d for _, d, c in last if c == j) for j in range(len(centres))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sums[c], sum(sums), digests[c]) for i, d, c in last), key=str)


def table(spark, data):
    return spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, cluster int")


@pytest.mark.parametrize(("block", "rounds", "k"), [(8192, 3, 7), (16, 6, 5), (50, 0, 4), (50, 9, 1)])
def test_equals_plain_rounds(spark, monkeypatch, block, rounds, k):
    monkeypatch.setattr(C, "BLOCK", block)
    data = rows()
    found = C.cluster(table(spark, data).repartition(3), k=k, rounds=rounds, dims=8, scale=16.0).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(data, k, rounds, 8, 16.0)


def test_few_and_no_vectors(spark):
    data = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [5.0, 5.0])]
    found = C.cluster(table(spark, data), k=16, rounds=3, dims=2, scale=1.0).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(data, 16, 3, 2, 1.0)
    empty = C.cluster(table(spark, data).limit(0), dims=2)
    assert empty.collect() == [] and empty.columns == [c.split()[0] for c in C.RESULT.split(", ")]


def test_only_expired_vectors_are_measured():
    """Bounds leave most vectors alone, and never one whose nearest centroid has changed."""
    rng = np.random.default_rng(1)
    data = (rng.integers(0, 6, (4000, 1)) * 200 + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    centres = data[:6].copy()
    drift = np.zeros(6)
    own, _, gaps = C.nearest(data, centres)
    heaps = C.Heaps(np.zeros(0, np.int64), np.zeros(0), 6)
    heaps.clusters, heaps.keys = np.zeros(4000, np.int64), np.zeros(4000)
    heaps.push(np.arange(4000), own, gaps, drift)
    looked = []
    for _ in range(8):
        moved = np.array([data[heaps.clusters == j].sum(axis=0) // max(1, (heaps.clusters == j).sum()) for j in range(6)])
        drift = drift + C.steps(centres, moved)
        centres = moved
        popped = heaps.pop_expired(drift)
        looked.append(len(popped))
        clusters, _, gaps = C.nearest(data[popped], centres)
        heaps.push(popped, clusters, gaps, drift)
        assert (heaps.clusters == C.nearest(data, centres)[0]).all()
    assert looked[-1] < 400


def test_wide_components_are_exact():
    rows = np.array([[1 << 29, 3], [0, 1], [-(1 << 28), 7]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in rows] for r in rows]
    assert C.squared_distances(rows, rows).tolist() == want
    with pytest.raises(ValueError, match="64 bits"):
        C.squared_distances(rows << 4, rows << 4)
