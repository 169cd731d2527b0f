import math

import numpy as np
import pytest

from docproof.llm import hard_negatives as H


def rows(n=240, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    out = [(i, int(i % 4) if i % 3 else 0, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dims)))]
    for i in (20, 40, 41, 42, 43):
        out[i] = (i, out[i][1], out[60][2])
    out += [(900, None, [1.0] * dims), (None, 1, [1.0] * dims), (910, 1, None), (920, 1, []), (930, 1, [None] * dims),
            (940, 1, [math.nan] * dims), (950, 1, [math.inf] * dims), (960, 2, [1.0, 2.0]), (961, 3, [0.5, 1.0]), (962, 2, [1.5, 2.0]),
            (970, 77, [1.0] * dims), (980, 0, [0.0] * dims)]
    return out + [out[5], (5, out[5][1] + 1, out[5][2])]


def brute(data, every, k, n, low=30, high=90):
    good = {}
    for i, label, v in data:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(256 * x) for x in v])
            good[i] = min(good.get(i, row), row)
    out = []
    for a in sorted(i for i in good if i % every == 0):
        label, own = good[a]
        scored = sorted((-sum(x * y for x, y in zip(own, v)), i, other) for i, (other, v) in good.items() if i != a and len(v) == len(own))
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            reach = [(s, i) for s, i, other in scored if other != label and low * -p <= 100 * -s <= high * -p][:n]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(reach, 1)]
    return sorted(out)


def table(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, label int, embedding array<double>, rank int, block string")


@pytest.mark.parametrize(("items", "anchors"), [(4096, 512), (16, 5)])
def test_equals_all_pairs(spark, monkeypatch, items, anchors):
    monkeypatch.setattr(H, "ITEMS", items)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    data = rows()
    found = sorted(tuple(r) for r in H.hard_negatives(table(spark, data), "vec_id % 10 = 0", 3, 4).collect())
    assert found == brute(data, 10, 3, 4) and len(found) > 100


def test_empty_table_and_one_label(spark):
    none = table(spark, rows()).limit(0)
    assert H.hard_negatives(none, "vec_id % 10 = 0").collect() == []
    alone = table(spark, [(i, 1, [1.0, float(i)]) for i in range(30)])
    assert H.hard_negatives(alone, "vec_id % 10 = 0").collect() == []


@pytest.mark.parametrize(("low", "high", "dims", "n"), [
    (-150, 150, 64, 1000), (-1, 2, 3, 7), (0, 1, 5, 3), (-(10**6), 10**6, 64, 100), (-(10**8), 10**8, 64, 101), (5, 9, 4, 10), (-9, -5, 4, 10)])
def test_packed_products_are_exact(low, high, dims, n):
    rng = np.random.default_rng(n)
    items, anchors = rng.integers(low, high, (n, dims)), rng.integers(low, high, (9, dims))
    assert (H.packed_scores(items, anchors) == anchors @ items.T).all()


def test_products_beyond_64_bits_are_refused():
    huge = np.full((2, 4), 1 << 40)
    with pytest.raises(ValueError, match="64 bits"):
        H.packed_scores(huge, huge)


def test_anchor_blocks_are_not_copied_for_each_block_of_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "ITEMS", 16)
    monkeypatch.setattr(H, "ANCHORS", 5)
    monkeypatch.setattr(H, "GROUP", 2)
    data = rows(seed=5)
    found = H.hard_negatives(table(spark, data), "vec_id % 10 = 0", 3, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan and "Join" not in plan
    assert sorted(tuple(r) for r in found.collect()) == brute(data, 10, 3, 4)
