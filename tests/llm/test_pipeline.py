import numpy as np
import public_tokenizers
from brute import shingles, text_groups
from tokenizers import Tokenizer

import corpus_pipeline
from docproof.llm.cotraining import classify
from docproof.llm.queries import ORACLE, QUERIES
from docproof.llm.raking import mixture


def test_every_stage_against_its_operator_or_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "mixture", "tokens"]
    good = corpus_pipeline.stored(stages["quality"](spark, docs, sf_dir), "test")
    rejected = {r.doc_id for r in classify(docs, labels).filter("not kept").collect()}
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - rejected
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    fine = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(rejected & bad) > 0.9 * len(bad) and len(rejected & fine) < 0.02 * len(fine)

    one_each = corpus_pipeline.stored(stages["near_duplicates"](spark, good, sf_dir), "test")
    least, _ = text_groups({r.doc_id: r.text for r in good.collect()}, 5)
    assert sorted(r.doc_id for r in one_each.collect()) == sorted(set(least.values()))

    mixed = corpus_pipeline.stored(stages["mixture"](spark, one_each, sf_dir), "test")
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in mixture(one_each).filter("kept").collect()}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in stages["tokens"](spark, mixed, sf_dir).collect():
        assert r.text == texts[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids


def test_run_keeps_no_two_near_copies(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    sets = [shingles(r.text, 5) for r in rows]
    assert rows and not any(10 * len(a & b) >= 8 * len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :] if a and b)


def test_queries_are_one_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
