"""Language-model scoring: interpolated modified Kneser-Ney bigrams in memory-mapped sorted arrays.

Three passes over Spark count the model. Words: tasks count hashes of words, shards of the hash
range merge them; a word's number is its place in hash order. Pairs: tasks count pairs of word
numbers, shards of the pair range merge them; a frequent first word is cut over several shards.
Contexts: per block of word numbers the totals, discounts and numbers of left neighbours are added
up. Every shard and block is written as arrays into the shared folder, and the workers that score
map the files. Nothing but sizes and counts of counts reaches the driver.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docproof.llm.hash_table import shard_bits, shard_of
from docproof.llm.support import map_array, new_folder, ship_package, stored, write_array
from docproof.llm.textscan import as_bytes, by_size, mix, word_hashes

# The end of a text, which is also what stands before its first word.
END = mix(np.array([0xE0D], np.uint64))[0]
GATHERED = 1 << 22
TEXT_BYTES = 1 << 21
TOKENS_PER_SHARD = 1 << 22
BLOCK_BITS = 18
SMOOTHING = 0.1


def token_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed by its end, and where the texts begin."""
    hashes, offsets = word_hashes(texts)
    tokens = np.insert(hashes, offsets[1:], END)
    return tokens, offsets[:-1] + np.arange(len(texts))


def _groups(texts: list[bytes]):
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > TEXT_BYTES or i == len(texts) - 1:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _smallest(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest unsigned type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _pack(values: np.ndarray) -> bytes:
    small = _smallest(values)
    return small.dtype.itemsize.to_bytes(1, "little") + small.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _counted(batches, keys_of):
    """Distinct keys and counts of a task's texts, handed on whenever enough have gathered."""
    parts, size = [], 0
    for batch in (part for batch in batches for part in by_size(batch, 0, 1 << 23)):
        for _, texts in _groups(as_bytes(batch.column(0))):
            keys, counts = np.unique(keys_of(texts), return_counts=True)
            parts.append((keys, counts))
            size += len(keys)
            if size > GATHERED:
                merged = _summed(*map(np.concatenate, zip(*parts, strict=True)))
                parts, size = [merged], len(merged[0])
                if size > GATHERED // 2:
                    yield merged
                    parts, size = [], 0
    if parts:
        yield _summed(*map(np.concatenate, zip(*parts, strict=True)))


def _runs(values: np.ndarray):
    """(begin, end) of every run of equal values."""
    bounds = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


@dataclass
class Words:
    """The vocabulary's arrays: hashes in order, how often each occurs, and how many tokens come before."""

    folder: str
    bits: int
    sizes: dict[int, int]
    tokens: dict[int, int]
    mapped: dict = field(default_factory=dict)

    def __post_init__(self):
        self.first, self.before, n, t = {}, {}, 0, 0
        for shard in sorted(self.sizes):
            self.first[shard], self.before[shard] = n, t
            n, t = n + self.sizes[shard], t + self.tokens[shard]
        self.distinct, self.total = n, t

    def __getstate__(self):
        return self.__dict__ | {"mapped": {}}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (-1 if unknown), counts and tokens before, of sorted distinct hashes."""
        number, count, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        if not len(hashes):
            return number, count, before
        shards = shard_of(hashes, self.bits)
        for begin, end in _runs(shards):
            shard = int(shards[begin])
            if shard not in self.sizes:
                continue
            if shard not in self.mapped:
                self.mapped[shard] = [map_array(self.folder, f"{n}-{shard}") for n in ("word", "count", "before")]
            known, counts, earlier = self.mapped[shard]
            at = np.searchsorted(known, hashes[begin:end])
            at[at == len(known)] = 0
            hit = known[at] == hashes[begin:end]
            number[begin:end] = np.where(hit, at + self.first[shard], -1)
            count[begin:end] = np.where(hit, counts[at], 0)
            before[begin:end] = np.where(hit, earlier[at] + self.before[shard], 0)
        return number, count, before


def _count_words(texts: DataFrame, n_tokens: int) -> Words:
    import pandas as pd
    import pyarrow as pa

    folder, bits = new_folder(texts.sparkSession, "words"), shard_bits(n_tokens, 2 * TOKENS_PER_SHARD)

    def gather(batches):
        for keys, counts in _counted(batches, lambda texts: token_stream(texts)[0]):
            shards = shard_of(keys, bits)
            rows = [(int(shards[a]), keys[a:b].tobytes(), _pack(counts[a:b])) for a, b in _runs(shards)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts"])

    def merge(frame):
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in frame["keys"]])
        keys, counts = _summed(keys, np.concatenate([_unpack(c) for c in frame["counts"]]))
        shard = int(frame["shard"].iloc[0])
        write_array(folder, f"word-{shard}", keys)
        write_array(folder, f"count-{shard}", _smallest(counts))
        write_array(folder, f"before-{shard}", np.cumsum(counts) - counts)
        return pd.DataFrame({"shard": [shard], "words": [len(keys)], "tokens": [int(counts.sum())]})

    parts = texts.mapInArrow(gather, "shard int, keys binary, counts binary")
    sizes = parts.groupBy("shard").applyInPandas(merge, "shard int, words long, tokens long").collect()
    return Words(folder, bits, {r.shard: r.words for r in sizes}, {r.shard: r.tokens for r in sizes})


@dataclass
class Pairs:
    """The arrays of counted pairs; a shard is a range of pairs that holds about equally many tokens."""

    folder: str
    shards: int
    words: Words
    mapped: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"mapped": {}}

    def shard(self, second: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Shard of a pair from its second number and its first word's count and tokens before."""
        place = before + count * (second / max(1, self.words.distinct))
        return np.minimum(place * (self.shards / max(1, self.words.total)), self.shards - 1).astype(np.int64)

    def find(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs, 0 where a pair was not seen."""
        out = np.zeros(len(keys), np.int64)
        if not len(keys):
            return out
        for begin, end in _runs(shards):
            shard = int(shards[begin])
            if shard not in self.mapped:
                try:
                    self.mapped[shard] = [map_array(self.folder, f"{n}-{shard}") for n in ("pair", "count")]
                except FileNotFoundError:  # no pair of the training texts lies in this range
                    self.mapped[shard] = None
            if self.mapped[shard] is None:
                continue
            known, counts = self.mapped[shard]
            at = np.searchsorted(known, keys[begin:end])
            at[at == len(known)] = 0
            out[begin:end] = np.where(known[at] == keys[begin:end], counts[at], 0)
        return out


def _number_pairs(tokens: np.ndarray, words: Words):
    """Per token: place of its word among the distinct ones; and what the vocabulary knows of these."""
    distinct, place = np.unique(tokens, return_inverse=True)
    return distinct, place, words.find(distinct)


def _count_pairs(texts: DataFrame, words: Words) -> tuple[Pairs, DataFrame]:
    """The pair arrays, and rows (kind, block, numbers, values...) with what contexts add up to."""
    import pandas as pd
    import pyarrow as pa

    pairs = Pairs(new_folder(texts.sparkSession, "pairs"), max(1, -(-words.total // TOKENS_PER_SHARD)), words)

    def keys_of(texts):
        tokens, _ = token_stream(texts)
        _, place, (number, _, _) = _number_pairs(tokens, words)
        numbers = number[place].astype(np.uint64)
        before = np.concatenate((number[place[-1:]].astype(np.uint64), numbers[:-1]))  # the end closes every text
        return before << np.uint64(32) | numbers

    def gather(batches):
        kinds = [pa.int32(), *[pa.binary()] * 4]
        for keys, counts in _counted(batches, keys_of):
            first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            shards = np.empty(len(keys), np.int64)
            count, before = words_by_number(words, first)
            shards = pairs.shard(second, count, before)
            rows = []
            for a, b in _runs(shards):
                heads, lengths = np.unique(first[a:b], return_counts=True)
                rows.append((int(shards[a]), _pack(heads), _pack(lengths), _pack(second[a:b]), _pack(counts[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["shard", "heads", "lengths", "seconds", "counts"],
            )

    def merge(frame):
        keys = [
            np.repeat(_unpack(h), _unpack(n)).astype(np.uint64) << np.uint64(32) | _unpack(s).astype(np.uint64)
            for h, n, s in zip(frame["heads"], frame["lengths"], frame["seconds"], strict=True)
        ]
        keys, counts = _summed(np.concatenate(keys), np.concatenate([_unpack(c) for c in frame["counts"]]))
        shard = int(frame["shard"].iloc[0])
        write_array(pairs.folder, f"pair-{shard}", keys)
        write_array(pairs.folder, f"count-{shard}", _smallest(counts))
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        totals = [np.add.reduceat(v, heads) for v in (counts, counts == 1, counts == 2, counts > 2)]
        left, lefts = np.unique(second, return_counts=True)
        rows = []
        for kind, numbers, values in (("context", first[heads], totals), ("left", left, [lefts])):
            for a, b in _runs(numbers >> BLOCK_BITS):
                blobs = [_pack(v[a:b].astype(np.int64)) for v in values]
                rows.append((kind, int(numbers[a] >> BLOCK_BITS), _pack(numbers[a:b]), *blobs, *[b""] * (4 - len(blobs)), 0))
        rows.extend(("size", k, b"", b"", b"", b"", b"", int((counts == k).sum())) for k in (1, 2, 3, 4))
        return pd.DataFrame(rows, columns=["kind", "block", "numbers", "v0", "v1", "v2", "v3", "n"])

    parts = texts.mapInArrow(gather, "shard int, heads binary, lengths binary, seconds binary, counts binary")
    schema = "kind string, block long, numbers binary, v0 binary, v1 binary, v2 binary, v3 binary, n long"
    return pairs, stored(parts.groupBy("shard").applyInPandas(merge, schema), "contexts")


def words_by_number(words: Words, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and tokens before, of sorted word numbers."""
    count, before = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
    for shard, first in words.first.items():
        begin, end = np.searchsorted(numbers, [first, first + words.sizes[shard]])
        if begin == end:
            continue
        if shard not in words.mapped:
            words.mapped[shard] = [map_array(words.folder, f"{n}-{shard}") for n in ("word", "count", "before")]
        _, counts, earlier = words.mapped[shard]
        count[begin:end] = counts[numbers[begin:end] - first]
        before[begin:end] = earlier[numbers[begin:end] - first] + words.before[shard]
    return count, before


def discounts(sizes: dict[int, int]) -> np.ndarray:
    """What modified Kneser-Ney takes from counts 0, 1, 2 and above, given how many counts are 1 to 4."""
    n = [sizes.get(k, 0) for k in range(5)]
    share = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
    taken = [k - (k + 1) * share * n[k + 1] / n[k] if n[k] else share for k in (1, 2, 3)]
    return np.array([0.0, *[min(max(t, 0.05 * k), 0.95 * k) for k, t in enumerate(taken, 1)]])


def taken(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return discount[np.minimum(counts, 3)]


@dataclass
class Model:
    """What scoring needs: word and pair arrays, and per word its context sums and left neighbours."""

    words: Words
    pairs: Pairs
    folder: str
    discount: np.ndarray
    left_discount: np.ndarray
    left_total: int
    left_bonus: float
    block_bits: int
    mapped: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"mapped": {}}

    def contexts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total, discounted mass and left neighbours of word numbers; zeros for -1."""
        out = [np.zeros(len(numbers)) for _ in range(3)]
        known = np.flatnonzero(numbers >= 0)
        blocks = numbers[known] >> self.block_bits
        order = np.argsort(blocks, kind="stable")
        known, blocks = known[order], blocks[order]
        for a, b in _runs(blocks) if len(blocks) else ():
            block = int(blocks[a])
            if block not in self.mapped:
                self.mapped[block] = [map_array(self.folder, f"{n}-{block}") for n in ("total", "bonus", "left")]
            at = numbers[known[a:b]] - (block << self.block_bits)
            for values, array in zip(out, self.mapped[block], strict=True):
                values[known[a:b]] = array[at]
        return tuple(out)

    def score(self, texts: list[bytes]):
        """Per text: tokens, known tokens, unigram baseline and model log10 probability."""
        tokens, begins = token_stream(texts)
        distinct, place, (number, count, before) = _number_pairs(tokens, self.words)
        n, v = self.words.total, self.words.distinct
        base = np.log10((count + SMOOTHING) / (n + SMOOTHING * (v + 1)))
        total, bonus, left = self.contexts(number)
        unigram = np.maximum(left - taken(left.astype(np.int64), self.left_discount), 0) + self.left_bonus / (v + 1)
        unigram = unigram / self.left_total if self.left_total else np.full(len(distinct), 1 / (v + 1))
        context = np.concatenate((place[-1:], place[:-1]))
        probability = unigram[place]
        seen = np.flatnonzero(total[context] > 0)
        if len(seen):
            c, w = context[seen], place[seen]
            both = (number[w] >= 0) & (number[c] >= 0)
            keys = np.where(both, number[c] << 32 | np.maximum(number[w], 0), 0).astype(np.uint64)
            wanted, back = np.unique(keys[both], return_inverse=True)
            one = np.zeros(len(wanted), np.int64)
            one[back] = c[both]
            shards = self.pairs.shard((wanted & np.uint64(0xFFFFFFFF)).astype(np.int64), count[one], before[one])
            counts = np.zeros(len(seen), np.int64)
            counts[both] = self.pairs.find(wanted, shards)[back]
            own = np.maximum(counts - taken(counts, self.discount), 0)
            probability[seen] = (own + bonus[c] * probability[seen]) / total[c]
        sums = [np.add.reduceat(x, begins) for x in (np.ones(len(tokens), np.int64), (count[place] > 0).astype(np.int64), base[place], np.log10(probability))]
        return sums


def train(docs: DataFrame, text: str = "text") -> Model:
    """A model of all rows' whole texts; null texts are empty."""
    import pandas as pd

    ship_package(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = _count_words(texts, n_bytes // 5)
    pairs, rows = _count_pairs(texts, words)
    sizes = {r.block: r.n for r in rows.filter("kind = 'size'").groupBy("block").agg(F.sum("n").alias("n")).collect()}
    discount = discounts(sizes)
    folder = new_folder(docs.sparkSession, "contexts")
    width = 1 << BLOCK_BITS

    def merge(frame):
        block = int(frame["block"].iloc[0])
        sums = np.zeros((5, width), np.int64)
        for row in frame.itertuples():
            at = _unpack(row.numbers) - (block << BLOCK_BITS)
            if row.kind == "left":
                sums[4, at] += _unpack(row.v0)
            else:
                for k, blob in enumerate((row.v0, row.v1, row.v2, row.v3)):
                    sums[k, at] += _unpack(blob)
        write_array(folder, f"total-{block}", _smallest(sums[0]))
        write_array(folder, f"bonus-{block}", discount[1] * sums[1] + discount[2] * sums[2] + discount[3] * sums[3])
        write_array(folder, f"left-{block}", _smallest(sums[4]))
        left = sums[4]
        return pd.DataFrame([[int((left == k).sum()) for k in (1, 2, 3, 4)] + [int((left > 2).sum()), int(left.sum())]],
                            columns=["n1", "n2", "n3", "n4", "many", "total"])

    dealt = rows.filter("kind <> 'size'").groupBy("block").applyInPandas(merge, "n1 long, n2 long, n3 long, n4 long, many long, total long")
    left = dealt.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in dealt.columns]).first()
    left_discount = discounts({1: left.n1, 2: left.n2, 3: left.n3, 4: left.n4})
    bonus = left_discount[1] * left.n1 + left_discount[2] * left.n2 + left_discount[3] * left.many
    return Model(words, pairs, folder, discount, left_discount, left.total, bonus, BLOCK_BITS)


def score_texts(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in (part for batch in batches for part in by_size(batch, 1, 1 << 23)):
            for begin, texts in _groups(as_bytes(batch.column(1))):
                n, known, base, score = model.score(texts)
                ids = batch.column(0).slice(begin, len(texts))
                total = np.full(len(texts), model.words.total)
                columns = [pa.array(c) for c in (n, known, total, base, score)]
                yield pa.RecordBatch.from_arrays(
                    [ids, *columns], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def is_held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: one in ten by the checksum of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents.

    The model learns from the documents that are not held out and scores all. Tokens are lower-cased
    (A-Z) words between white space and one end per text. ``base_score`` is the smoothed unigram
    baseline, ``score`` the model's log10 probability; perplexity is 10 ** (-score / n_tokens).
    Null and empty texts are one end token. Null ids count as the empty text for the split.
    Repeated rows count as often as they occur, in training and in the result. With no training
    text both scores are 0; an empty table gives an empty result. Other columns are ignored.
    """
    model = train(docs.filter(~is_held_out(F.col(doc_id))), text)
    return score_texts(docs, model, doc_id, text).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
