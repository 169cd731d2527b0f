import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docproof.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", None, " ", "a", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "ß é ñ ҉ ԰ ՠ ⁇ 你好 👩‍👩‍👧  \u0085\xa0 x", "'S 's It's 12³ Ⅻ",
       "a" * 5000, " " * 5000, "ab " * 4000, "\n\n\t " * 700, "!" * 3000, "é" * 2500, "word " * 9000, "\x00\x1f", "͸ \U0001F9FF"]


def texts(n=400, seed=2):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "ga mma", "12", "don't", "über", "naïve", "\n", "…", "x", "<|endoftext|>"]
    return ODD + [" ".join(rng.choices(words, k=rng.choice([1, 3, 40, 300, 900]))) for _ in range(n)]


def expected(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_tokens_equal_the_library():
    tool = P.tokens(PATH)
    every = [chr(c) for c in range(0x530) if not 0xD800 <= c < 0xE000]
    more = ["".join(random.Random(i).choices(every, k=200)) for i in range(300)] + [f"a{c} {c}b{c}{c}1 {c}" for c in every]
    for text in [t for t in texts() if t is not None] + more:
        assert tool.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text[:60]


def test_cut():
    assert P.cut(1, 4) == [(0, 1)] and P.cut(4, 4) == [(0, 4)]
    assert P.cut(5, 4) == [(0, 1), (1, 4)] and P.cut(11, 4) == [(0, 3), (3, 4), (7, 4)] and P.cut(8, 4) == [(0, 4), (4, 4)]


def test_best_fit():
    bins, offsets, fills = P.best_fit([6, 3, 5, 4, 2], 10)
    assert fills == [10, 10] and bins[0] == bins[3] and offsets[0] == 0
    assert P.best_fit([], 10) == ([], [], [])
    rng = random.Random(1)
    lengths = [rng.randrange(1, 60) for _ in range(3000)]
    bins, offsets, fills = P.best_fit(lengths, 100)
    for b, fill in enumerate(fills):
        own = sorted((o, n) for o, n, x in zip(offsets, lengths, bins) if x == b)
        assert fill <= 100 and own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:]))
    assert len(fills) <= 1.01 * sum(lengths) / 100 + 1


def check(pieces, docs, most):
    wanted = {}
    for doc, text in docs:
        ids = expected(text)
        wanted.setdefault(doc, []).append([(i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(P.cut(len(ids), most))])
    flat = sorted((str(doc), *p) for doc, several in wanted.items() for own in several for p in own)
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == flat
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= most
    return len(sequences), sum(p.length for p in pieces)


@pytest.mark.parametrize(("parts", "fan", "chunk"), [(1, 16, 1 << 18), (23, 16, 1 << 18), (40, 3, 7)])
def test_packing(spark, monkeypatch, parts, fan, chunk):
    monkeypatch.setattr(P, "FAN", fan)
    monkeypatch.setattr(P, "CHUNK", chunk)
    docs = [*enumerate(texts()), (3, "a"), (3, "other"), (None, "null id"), (None, "null id")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, bin string, part int").repartition(parts)
    n, total = check(P.placed(table, PATH, most=256).collect(), docs, 256)
    assert n <= total / 256 * (1.03 if chunk > 7 else 1.2) + 1


def test_open_bins_meet_up_the_tree(spark):
    """One short document in each of many partitions ends in one sequence."""
    docs = [(i, "alpha beta") for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id int, text string").repartition(300, "doc_id")
    n, total = check(P.placed(table, PATH).collect(), docs, 2048)
    assert n == 1 and total < 2048


def test_sequences_and_empty(spark):
    docs = [(str(i), t) for i, t in enumerate(texts(30))]
    table = spark.createDataFrame(docs, "doc_id string, text string").repartition(5)
    found = P.sequences(table, PATH).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in found)
    assert sum(r.n_tokens for r in found) == sum(len(expected(t)) for _, t in docs)
    assert P.placed(table.limit(0), PATH).collect() == []
