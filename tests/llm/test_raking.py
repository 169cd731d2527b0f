from collections import defaultdict

import pytest

from docproof.llm import raking
from docproof.llm.raking import AXES, KEEP, cells_of, mixture, probabilities, rake, reached, sample_to_targets, topic_of, token_count


def cells(spark):
    rows = [(s, lang, t, 10 + 7 * i + 13 * j + 5 * k * k) for i, s in enumerate(["a", "b", None]) for j, lang in enumerate(["en", "de"])
            for k, t in enumerate(["prose", "code", "brief"])]
    return spark.createDataFrame([*rows, ("a", "fr", "prose", 0)], "source string, lang string, topic string, tokens long")


def targets(spark):
    shares = {"source": {"a": 0.2, "b": 0.5, None: 0.3}, "lang": {"en": 0.75, "de": 0.25}, "topic": {"prose": 0.6, "code": 0.3, "brief": 0.1}}
    return {a: spark.createDataFrame(list(s.items()), f"{a} string, share double") for a, s in shares.items()}, shares


def test_sums_meet_targets_and_ratios_factor(spark):
    tables, shares = targets(spark)
    rows = rake(cells(spark), tables).collect()
    total = sum(r.tokens for r in rows)
    for axis, share in shares.items():
        sums = defaultdict(float)
        for r in rows:
            sums[r[axis]] += r.weight
        for value, goal in share.items():
            assert sums[value] == pytest.approx(goal * total, rel=1e-6)
    ratio = {(r.source, r.lang, r.topic): r.weight / r.tokens for r in rows if r.tokens}
    assert ratio["a", "en", "code"] * ratio["b", "de", "code"] == pytest.approx(ratio["a", "de", "code"] * ratio["b", "en", "code"])
    chances = {tuple(r[a] for a in AXES): r.probability for r in probabilities(cells(spark), tables).collect()}
    assert max(chances.values()) == 1
    assert all(chances[c] == pytest.approx(min(1, KEEP * v), abs=1e-8) for c, v in ratio.items())
    assert chances["a", "fr", "prose"] == 0


def test_unknown_values_and_missing_targets(spark):
    tables, _ = targets(spark)
    tables["lang"] = spark.createDataFrame([("en", 1.0), ("it", 5.0)], "lang string, share double")
    rows = rake(cells(spark), tables).collect()
    assert all(r.weight == 0 for r in rows if r.lang != "en")
    assert sum(r.weight for r in rows) == pytest.approx(sum(r.tokens for r in rows if r.lang == "en"))


def documents(spark, n=3000):
    rows = [(i, ["x " * 10, "License " + "y " * 200, "a@b " + "z " * 150, None][i % 4], ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 5}", "k")
            for i in range(n)]
    return spark.createDataFrame([*rows, (None, "w", "en", "hot", "k"), rows[1]], "doc_id long, text string, lang string, source string, kept string")


def test_sample_meets_its_probabilities(spark):
    docs = documents(spark)
    found = mixture(docs).toPandas()
    assert len(found) == docs.count()
    assert found.probability.between(0, 1).all()
    assert found.kept.sum() == pytest.approx(found.probability.sum(), rel=0.1)
    twice = found[found.doc_id == 1]
    assert len(twice) == 2 and twice.kept.nunique() == 1
    kept = sample_to_targets(docs)
    assert kept.columns == docs.columns and kept.count() == found.kept.sum()


def test_topics_counts_and_empty_table(spark):
    from pyspark.sql import functions as F

    texts = [("one two", "brief", 2), (None, "brief", 0), ("", "brief", 0), ("w " * 100, "prose", 100), ("license " * 2, "legal", 2), ("f();", "code", 1)]
    df = spark.createDataFrame(texts, "text string, topic string, n int")
    for r in df.select("topic", "n", topic_of(F.col("text"), token_count(F.col("text"))).alias("t"), token_count(F.col("text")).alias("k")).collect():
        assert (r.t, r.k) == (r.topic, r.n)
    assert mixture(documents(spark).limit(0)).count() == 0


def test_one_stray_row_moves_nothing_else(spark):
    docs = documents(spark)
    stray = spark.createDataFrame([(9999, "three new words", "xx", "never seen", "k")], docs.schema)
    before, after = (mixture(d).filter("doc_id <> 9999").toPandas() for d in (docs, docs.unionByName(stray)))
    assert abs(before.kept.mean() - after.kept.mean()) < 0.01
    assert mixture(docs.unionByName(stray)).filter("doc_id = 9999").first().probability == 1


def test_marginals_reached(spark):
    """Where no cell has too few tokens, the expected marginals are the targets."""
    tables, shares = targets(spark)
    rows = reached(probabilities(cells(spark), tables, keep=0.1)).collect()
    for r in rows:
        if r.value != "fr":
            assert r.expected == pytest.approx(shares[r.axis][r.value], abs=1e-6)
    flat = reached(probabilities(cells_of(documents(spark)))).collect()
    assert {r.axis for r in flat} == set(AXES) and all(0 <= r.expected <= 1 for r in flat)


def test_many_cells_and_clashing_names(spark, monkeypatch):
    docs = documents(spark)
    one = {(r.source, r.lang, r.topic): r.probability for r in mixture(docs).collect()}
    monkeypatch.setattr(raking, "MOST_BROADCAST_CELLS", 1)
    many = {(r.source, r.lang, r.topic): r.probability for r in mixture(docs).collect()}
    assert many == pytest.approx(one, abs=1e-6)
    monkeypatch.undo()
    from pyspark.sql import functions as F

    odd = docs.withColumns({c: F.lit("mine") for c in ("_source", "_lang", "_Topic", "_tokens", "_probability", "_kept", "_cell_lang")})
    kept = sample_to_targets(odd)
    assert kept.columns == odd.columns and kept.count() == sample_to_targets(docs).count()
    assert {r._tokens for r in kept.select("_tokens").distinct().collect()} == {"mine"}
    given = mixture(docs, topic=F.col("kept"))
    assert {r.topic for r in given.select("topic").distinct().collect()} == {"k"}
