import math
import random

import numpy as np

from docproof.llm import top_products
from docproof.llm.top_products import top_products as search


def rows(n=300, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dims)) * np.exp(rng.normal(size=(n, 1)))
    out = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    for i in (20, 40, 41, 42):
        out[i] = (i, out[60][1])
    out += [(900, None), (950, [float("nan")] * dims), (951, [None] * dims), (952, [math.inf] + [0.0] * (dims - 1)), (1000, []),
            (None, [1.0] * dims), (1050, [1.0, 2.0]), (1051, [3.0, -1.0]), (1100, [0.0] * dims)]
    return out + [out[3]]


def brute(data, every, k):
    good = {i: [math.floor(256 * x) for x in v] for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in good if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def table(spark, data):
    return spark.createDataFrame([(i, v, 1.5) for i, v in data], "vec_id long, embedding array<double>, score double")


def test_equals_all_products(spark):
    data = rows()
    found = sorted(tuple(r) for r in search(table(spark, data), "vec_id % 10 = 0").collect())
    assert found == brute(data, 10, 5)


def test_many_small_blocks_prune_and_lose_nothing(spark, monkeypatch):
    data = rows(seed=2)
    monkeypatch.setattr(top_products, "ITEMS", 16)
    monkeypatch.setattr(top_products, "QUERIES", 8)
    monkeypatch.setattr(top_products, "HEAD", 4)
    found = sorted(tuple(r) for r in search(table(spark, data), "vec_id % 10 = 0", k=3).collect())
    assert found == brute(data, 10, 3)


def test_ties_go_to_smaller_ids_and_empty_table(spark):
    data = [(i, [1.0, 1.0]) for i in random.Random(1).sample(range(200), 60)] + [(0, [1.0, 1.0])]
    data = list(dict(data).items())
    found = sorted(tuple(r) for r in search(table(spark, data), "vec_id % 50 = 0").collect())
    assert found == brute(data, 50, 5)
    assert search(table(spark, data).limit(0), "vec_id % 50 = 0").count() == 0


def test_whole_products_beyond_double_precision():
    big = np.array([[2.0**30 + 1, 2.0**30], [1.0, 0.0]])
    assert top_products.scores(big, big)[0].tolist() == [(2**30 + 1) ** 2 + 2**60, 2**30 + 1]


def test_query_blocks_are_not_copied_for_each_block_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_products, "ITEMS", 16)
    monkeypatch.setattr(top_products, "QUERIES", 8)
    monkeypatch.setattr(top_products, "GROUP", 2)
    data = rows(seed=4)
    found = search(table(spark, data), "vec_id % 10 = 0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan and "Join" not in plan
    assert sorted(tuple(r) for r in found.collect()) == brute(data, 10, 5)
