import math

import numpy as np
import pytest
from brute import smallest_reachable

from docproof.llm import embedding_dedup
from docproof.llm.embedding_dedup import near_vectors


def data(n=400, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dims))
    rows = []
    for i in range(n):
        v = base[i % 40] + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.15, 1.0])
        rows.append((i, [float(x) for x in v * rng.uniform(0.1, 9)], [1, 2, None][i % 7 % 3]))
    rows[8] = (8, rows[15][1], rows[15][2])
    rows += [(500, None, 1), (501, [0.0] * dims, 1), (502, [math.nan] * dims, 1), (503, [None] + [1.0] * (dims - 1), 1), (504, [], 1),
             (505, rows[0][1][:2], 1), (506, rows[0][1][:2], 1), (507, [2.0], 1), (508, [3.0], 1), (509, [-3.0], 1)]
    return rows


def brute(rows, threshold):
    good = {i: (np.array(v), c) for i, v, c in rows if c is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [
        (a, b)
        for a in good
        for b in good
        if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])
        and good[a][0] @ good[b][0] / (np.linalg.norm(good[a][0]) * np.linalg.norm(good[b][0])) >= threshold
    ]
    least = smallest_reachable([i for i, *_ in rows], links)
    count = {i: sum(i in p for p in links) for i, *_ in rows}
    return {i: (count[i], least[i], least[i] == i) for i, *_ in rows}


def table(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")


@pytest.mark.parametrize("block", [2048, 7])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = data()
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table(spark, rows)).collect()}
    assert found == brute(rows, 0.98)


def test_recall_of_a_fine_grid():
    rng = np.random.default_rng(7)
    rows = embedding_dedup._unit(rng.normal(size=(3000, 64)))
    noise = rng.normal(size=rows.shape)
    noise -= (noise * rows).sum(1, keepdims=True) * rows
    partners = 0.98 * rows + math.sqrt(1 - 0.98**2) * embedding_dedup._unit(noise)
    index = embedding_dedup.fit(rows, 1024 * 32**2, 0.98)
    assert len(index.first) == len(index.second) == 32
    cells = index.cells(partners)
    visits = index.visits(rows)
    assert np.mean([c in v for c, v in zip(cells, visits)]) >= 0.99
    assert np.mean([len(v) for v in visits]) < 32**2 / 2
    own = index.cells(rows)
    assert all(v[0] == c for v, c in zip(visits, own))


def test_repeats_nulls_and_empty_table(spark):
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    found = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(table(spark, rows)).collect())
    assert found == [(False, 2, 1, 2, True), (False, 3, 1, 2, False), (True, 0, 0, None, True)]
    assert near_vectors(table(spark, rows).limit(0)).count() == 0
