"""Byte-level BPE from a public tokenizer file: encoding by a queue of merge ranks, decoding by strings.

A text is cut at special tokens, then into pre-tokens. A pre-token is a doubly linked list of
symbols; a priority queue holds the rank and place of every pair that can merge. The lowest rank
merges first, the leftmost of equal ranks before the others, and queue entries whose pair has
changed meanwhile are skipped. Decoding concatenates the vocabulary's strings.
"""

import json
import re
import unicodedata
from array import array
from functools import cache, cached_property
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docproof.llm.support import release, ship_package
from docproof.llm.textscan import as_bytes, by_size

# How byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Below this code point the regex module and the tokenizers library agree on letters, numbers and
# white space (a test compares them); texts with other characters are split by the library.
_NEWER = re.compile("[԰-\U0010ffff]")
# A blank that more white space or the end follows; without one, every blank starts a pre-token.
_LOOSE_BLANK = re.compile(r" (?:\s|\Z)")
# Pre-tokens that an encoder remembers, at least; at most twice as many.
PRE_TOKENS = 3 << 16
_PLACE = (1 << 32) - 1


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def _plain_pattern() -> re.Pattern:
    """The same split for texts of characters below U+0530, with the classes spelled out: many times faster."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x530)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    letters, numbers, space = kinds["L"], kinds["N"], r"\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        unusual = [
            model["type"] != "BPE", model.get("byte_fallback"), model.get("dropout"), model.get("ignore_merges"),
            model.get("end_of_word_suffix"), model.get("continuing_subword_prefix"), spec["normalizer"],
            split.get("type") != "ByteLevel", split.get("add_prefix_space"), not split.get("use_regex", True),
            any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]),
        ]
        if any(unusual):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.path = path
        ids, of_byte = model["vocab"], byte_alphabet()
        self.byte_ids = [ids[of_byte[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[left] << 32 | ids[right], rank << 32)
            self.merged.append(ids[left + right])


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge one pre-token's symbols until no pair has a rank; ``ranks`` are shifted by 32 bits.

    A queue entry is a pair's rank with its place in the low bits.
    """
    get, n = ranks.get, len(symbols)
    queue = [rank | at for at, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := get(a << 32 | b)) is not None]
    if not queue:
        return symbols
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = heappop(queue)
        at = entry & _PLACE
        here, right = symbols[at], after[at]
        if here < 0 or right >= n or get(here << 32 | symbols[right]) != entry - at:
            continue  # one of the two has merged with another neighbour meanwhile
        symbols[at] = here = merged[entry >> 32]
        symbols[right] = -1
        after[at] = end = after[right]
        if end < n:
            before[end] = at
            if (rank := get(here << 32 | symbols[end])) is not None:
                heappush(queue, rank | at)
        left = before[at]
        if left >= 0 and (rank := get(symbols[left] << 32 | here)) is not None:
            heappush(queue, rank | left)
    return [s for s in symbols if s >= 0]


class Splitter:
    """Cuts texts into special tokens and pre-tokens, as the vocabulary's library does."""

    def __init__(self, vocabulary: Vocabulary):
        self.find = _plain_pattern().findall
        self.special = vocabulary.special
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.path = vocabulary.path

    @cached_property
    def library(self):
        """The library's own splitter; loaded only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def segments(self, text: str) -> list[tuple[int | None, str]]:
        """(id of a special token or None, its text or the text between) in order."""
        if self.specials is None:
            return [(None, text)]
        return [(self.special.get(s), s) for s in self.specials.split(text) if s]

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not text.isascii() and _NEWER.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.find(text)

    def chunks(self, text: str) -> list[str]:
        """Pieces that hold whole pre-tokens; most pieces of ordinary text recur, so caches hit."""
        if _LOOSE_BLANK.search(text) or (not text.isascii() and _NEWER.search(text)):
            return self.pre_tokens(text)
        first, *rest = text.split(" ")
        return [first, *[" " + chunk for chunk in rest]] if first else [" " + chunk for chunk in rest]


class Recent(dict):
    """Remembers what was used lately, in two halves; when the newer is full, the older is forgotten."""

    def __init__(self, half: int):
        super().__init__()
        self.half, self.older = half, {}

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Token ids of whole texts; remembers a bounded number of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.splitter = vocabulary, Splitter(vocabulary)
        self.known = Recent(PRE_TOKENS)

    def forget(self) -> None:
        """Give back the memory of what was remembered; a worker process outlives its task."""
        self.known = Recent(PRE_TOKENS)

    def encode_token(self, token: str) -> bytes:
        if (packed := self.known.older.get(token)) is None:
            own = self.vocabulary
            packed = array("I", merge([own.byte_ids[b] for b in token.encode()], own.ranks, own.merged)).tobytes()
        return self.known.keep(token, packed) if len(token) < 64 else packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, get, encode_token = [], self.known.get, self.encode_token
        for special, segment in self.splitter.segments(text):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
                continue
            out.extend([get(t) or encode_token(t) for t in self.splitter.pre_tokens(segment)])
        return b"".join(out)


def decode_ids(ids: bytes, strings: list[bytes]) -> str:
    """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
    return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    return Encoder(Vocabulary(path))


@cache
def token_strings(path: str) -> list[bytes]:
    """The bytes of every token id; all that decoding needs of a file that ``encode`` accepts."""
    with open(path, encoding="utf-8") as source:
        spec = json.load(source)
    to_byte = {c: b for b, c in byte_alphabet().items()}
    strings = {i: bytes(to_byte[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    strings |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [strings.get(i, b"") for i in range(max(strings) + 1)]


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): every row's whole text as packed little-endian 32-bit token ids.

    ``vocabulary`` is the path of a byte-level BPE file that every worker can open. Strings of
    special tokens in a text become these tokens; no tokens are added. Null and empty texts have no
    ids. Rows are independent: repeated rows and null ids come back as they are, and other columns
    are ignored. A very long pre-token takes time n log n.
    """
    import pyarrow as pa

    ship_package(docs.sparkSession)

    def run(batches):
        tool = encoder(vocabulary)
        for part in (part for batch in batches for part in by_size(batch, 1)):
            packed = [tool.encode(t.decode("utf-8", "replace")) for t in as_bytes(part.column(1))]
            counts = pa.array([len(p) // 4 for p in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "ids"])
        tool.forget()
        release()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) from the result of ``encode``; special tokens are kept as text."""
    import pyarrow as pa

    ship_package(tokens.sparkSession)

    def run(batches):
        strings = token_strings(vocabulary)
        for part in (part for batch in batches for part in by_size(batch, 2)):
            texts = [decode_ids(ids or b"", strings) for ids in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    rows = tokens.select("doc_id", "n_tokens", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, text string")


def encode_and_decode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``decode`` gives of what ``encode`` gives, in one pass by one Python worker per task."""
    import pyarrow as pa

    ship_package(docs.sparkSession)

    def run(batches):
        tool, strings = encoder(vocabulary), token_strings(vocabulary)
        for part in (part for batch in batches for part in by_size(batch, 1)):
            packed = [tool.encode(given.decode("utf-8", "replace")) for given in as_bytes(part.column(1))]
            counts = pa.array([len(p) // 4 for p in packed], pa.int64())
            texts = pa.array([decode_ids(p, strings) for p in packed], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), counts, pa.array(packed, pa.binary()), texts], names=["doc_id", "n_tokens", "ids", "text"]
            )
        tool.forget()
        release()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, text string")


def digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts, in one pass over them."""
    import pyarrow as pa

    ship_package(docs.sparkSession)

    def run(batches):
        tool, strings = encoder(vocabulary), token_strings(vocabulary)
        for part in (part for batch in batches for part in by_size(batch, 1)):
            counts, of_ids, of_texts = [], [], []
            for given in as_bytes(part.column(1)):
                packed = tool.encode(given.decode("utf-8", "replace"))
                counts.append(len(packed) // 4)
                of_ids.append(sha256(packed).hexdigest())
                of_texts.append(sha256(decode_ids(packed, strings).encode()).hexdigest())
            columns = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tool.forget()
        release()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
