import random

import numpy as np
import pytest
from brute import text_groups

from docproof.llm import minhash, textscan
from docproof.llm.minhash import keep_one_per_group, near_duplicates


def variants(seed=1):
    """Originals with copies at every distance, a chain of near copies, and a large family."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for share in (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.2):
            texts.append(" ".join(word() if rng.random() < share else w for w in base))
    chain = [word() for _ in range(120)]
    for _ in range(15):
        texts.append(" ".join(chain))
        for _ in range(4):
            chain[rng.randrange(len(chain))] = word()
    family = [word() for _ in range(60)]
    for _ in range(40):
        texts.append(" ".join(word() if rng.random() < 0.05 else w for w in family))
    texts += ["One", "ONE", "one\ttwo", "one two", "", " \n ", None, "x " * 500, "X " * 500]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def table(spark, texts):
    rows = [(i, t, "extra", 0) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, component_id int")


@pytest.mark.parametrize("words", [2, 5])
def test_groups_equal_all_pairs(spark, words):
    texts = variants()
    least, sizes = text_groups(texts, words)
    found = {r.doc_id: r for r in near_duplicates(table(spark, texts), words, 80).collect()}
    assert {i: r.n_shingles for i, r in found.items()} == sizes
    assert {i: r.component_id for i, r in found.items()} == least
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_one_of_each_group_stays_with_all_columns(spark):
    texts = {3: "a b c d e f g", 1: "a b c d e f g", 2: "another text of a few words here"}
    docs = table(spark, texts).unionByName(spark.createDataFrame([(None, "a b c d e f g", "x", 1)], "doc_id long, text string, kept string, component_id int"))
    rows = keep_one_per_group(docs)
    assert rows.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows.collect()) == [(False, 1), (False, 2)]


def test_null_ids_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (5, None)], "doc_id long, text string")
    rows = sorted(near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows] == [
        (5, 0, 5, True), (7, 1, 7, True), (7, 1, 7, True), (None, 1, None, True)
    ]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        k = int(1000 * 2 * share / (1 + share))
        other = np.concatenate([base[:k], rng.integers(0, 2**63, 1000 - k, dtype=np.uint64)])
        bits = minhash._low_bits(minhash.signatures([np.sort(base), np.sort(other)])).view(np.uint64)
        x = bits[0] ^ bits[1]
        differ = int(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
        alike = (1 - differ / 192 - 0.25) / 0.75
        assert abs(alike - share) < minhash.MARGIN


def test_words_and_shingles_of_long_and_odd_texts():
    texts = ["A\x0bb\x1cc d É e", "", "   ", "one", "w " * 400_000 + "end", "x" * 3_000_000]
    data = [t.encode() for t in texts]
    hashes, offsets = textscan.word_hashes(data)
    assert np.diff(offsets).tolist() == [len(t.lower().split()) for t in data]
    assert len({*hashes.tolist()}) == len({w for t in data for w in t.lower().split()})
    assert [len(s) for s in textscan.shingle_sets(data, 2)] == [3, 0, 0, 1, 2, 1]
    again, _ = textscan.word_hashes(data[4:5])
    assert (again == hashes[offsets[4] : offsets[5]]).all()


def test_one_row_stays_of_each_group_whatever_the_ids(spark):
    from docproof.llm.minhash import keep_one_per_group

    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (None, text + " more"), (2, text), (1, other), (3, other), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _row string")
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, text), (1, other), (4, ""), (4, ""), (0, "")])
