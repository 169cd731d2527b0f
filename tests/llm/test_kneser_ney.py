import random

import pytest
from brute import held_out, kneser_ney

from docproof.llm import kneser_ney as model
from docproof.llm.kneser_ney import score_held_out


def documents(n=80):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(n)]
    texts += ["The THE the", "", None, " \n ", "unheard words only", "w1 " * 5000]
    return dict(enumerate(texts))


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1.0) for i, t in texts.items()], "doc_id long, text string, score double")


def check(spark, texts):
    learnt = [t for i, t in texts.items() if not held_out(i)]
    expected, probability, vocabulary = kneser_ney(learnt, texts.values())
    found = {r.doc_id: r for r in score_held_out(table(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, (tokens, known, total, base, score) in zip(texts, expected):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i), tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    for context in (None, b"w1", b"not a context"):
        assert sum(probability(context, w) for w in vocabulary) == pytest.approx(1)


def test_scores_equal_a_model_of_dictionaries(spark):
    check(spark, documents())


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(model, "TOKENS_PER_SHARD", 50)
    monkeypatch.setattr(model, "BLOCK_BITS", 3)
    monkeypatch.setattr(model, "GATHERED", 64)
    monkeypatch.setattr(model, "TEXT_BYTES", 100)
    check(spark, documents(40))


def test_held_out_texts_are_likelier_than_under_the_baseline(spark, sf_dir):
    rows = score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


def test_no_training_text_and_empty_table(spark):
    alone = next(i for i in range(100) if held_out(i))
    row = score_held_out(table(spark, {alone: "a b"})).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert score_held_out(table(spark, {1: "a"}).limit(0)).count() == 0
