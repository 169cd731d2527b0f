import random

from brute import smallest_reachable

from docproof.llm.components import components


def found(spark, links):
    return {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}


def test_chains_stars_and_random_links(spark):
    rng = random.Random(4)
    chain = [(i + 1, i) for i in range(1000, 1060)]
    star = [(5000, 2000 + i) for i in range(200)]
    loose = [(rng.randrange(10_000, 10_200), rng.randrange(10_000, 10_200)) for _ in range(120)]
    links = chain + star + loose + [(1, 1), (None, 3), (1001, 1000)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    rng.shuffle(links)
    assert found(spark, links) == smallest_reachable({i for p in real for i in p}, real)


def test_no_links(spark):
    assert found(spark, []) == {}


def test_links_that_are_stars_already_need_no_round(spark, monkeypatch):
    from docproof.llm import components as module

    written = []
    monkeypatch.setattr(module, "stored", lambda df, purpose: written.append(purpose) or df.localCheckpoint())
    monkeypatch.setattr(module, "discard", lambda df: None)
    links = [(i, 1) for i in range(2, 30)] + [(51, 50)]
    assert found(spark, links) == {**{i: 1 for i in range(1, 30)}, 50: 50, 51: 50}
    assert written == ["links"]
    assert found(spark, [(3, 2), (2, 1), (3, 1)]) == {1: 1, 2: 1, 3: 1}
