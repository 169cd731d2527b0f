import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docproof.llm import bpe
from docproof.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  a  b\n \tc  ", "plain words, and more words.", "a<|endoftext|>b <|endoftext|><|endoftext|>",
    "ԱԲ ⃏ 漢字 \U0001f600 don't I'LL 1234 ꟎\U00010940", " " * 50 + "x", "\n\n \n a", "a  b\x85 c\x1c d \x1d",
    "q" * 5000, "ab " * 2000, "Grüße aus Köln | ciónbo ***", "it's we'll they'd 'S", "tab\there\r\nthere",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n=400):
    rng = random.Random(8)
    letters = "abcDE 12.,!?'\n\t  éßñ漢́ ​😀<|>ſ"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(library):
    own = bpe.encoder(PATH)
    for text in [t or "" for t in TEXTS] + random_texts():
        expected = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == expected, text
        assert bpe.decode_ids(packed, bpe.token_strings(own.vocabulary.path)) == library.decode(expected, skip_special_tokens=False)


def test_every_early_code_point_is_split_as_the_library_splits_it(library):
    """Below the limit the pattern is used, above it the library itself."""
    find = bpe.Splitter(bpe.Vocabulary(PATH)).find
    for code in range(0x530):
        text = f"a{chr(code)}1{chr(code)}!{chr(code)} b{chr(code)}{chr(code)} c"
        assert find(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_stale_entries_and_ties():
    ranks, merged = {1 << 32 | 1: 0, 9 << 32 | 1: 1 << 32, 9 << 32 | 9: 2 << 32}, [9, 8, 7]
    assert bpe.merge([1] * 3, ranks, merged) == [8]
    assert bpe.merge([1] * 4, ranks, merged) == [7]
    assert bpe.merge([1] * 5, ranks, merged) == [9, 8]
    assert bpe.merge([1], ranks, merged) == [1]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "PRE_TOKENS", 2)
    own = bpe.Encoder(bpe.Vocabulary(PATH))
    for text in random_texts(150) * 2:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 2 and len(own.known.older) <= 2


def test_bytes_that_are_no_text_become_replacements():
    strings = bpe.token_strings(PATH)
    lone = next(i for i, s in enumerate(strings) if s == b"\xff")
    assert bpe.decode_ids(np.array([lone], "<u4").tobytes(), strings) == "�"


def test_tables_of_ids_texts_and_counts(spark, library):
    rows = [*enumerate(TEXTS), (None, "null id"), (4, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    expected = sorted((i is None, i or 0, len(ids := library.encode(t or "", add_special_tokens=False).ids),
                       hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                      for i, t in rows)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH).collect())
    assert found == expected
    counts = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts(docs, PATH).collect())
    sizes = sorted((i is None, i or 0, len(library.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in rows)
    assert [c[:4] for c in counts] == sizes
    assert all(c[4] == (c[2] > 512) for c in counts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, PATH).count() == 0
    assert token_counts(docs, PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_one_pass_gives_what_two_give(spark):
    rows = [(i, t) for i, t in enumerate([*random_texts(40), None, "", "<|endoftext|> x"])] + [(None, "a"), (1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two = bpe.decode(bpe.encode(docs, PATH), PATH)
    one = bpe.encode_and_decode(docs, PATH)
    assert one.schema == two.schema
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
