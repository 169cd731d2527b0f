"""Best-fit packing of token sequences, partition by partition and then up a tree.

Every document's tokens become pieces of at most one sequence's length. Each partition packs its own
pieces best-fit, longest first (very many pieces in several goes). Bins that are nearly full are done. The others go up as items of
their fill: the open bins of ``FAN`` neighbouring partitions are packed best-fit again, bin into bin,
and so on until one group is left. After best-fit no two bins of a group fit together unless one of
them is at most half full, and at most one is; so a group passes on that bin and only as many of the
emptiest others (``HOSTS``) as bins of other groups could ever need.
"""

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docproof.llm.bpe import PATTERN, Vocabulary, byte_alphabet
from docproof.llm.support import ship_package, stored
from docproof.llm.textscan import by_size

FAN, HOSTS = 16, 256
# Pieces that a task packs at once; larger partitions are packed in several goes.
CHUNK = 1 << 18
# A bin with fewer free places than this is done.
NEARLY_FULL = 8
# Runs so long that the fast encoder takes more than linear time, and characters on which Unicode tables differ.
_SLOW = re.compile(r"\S{2000}|\s{2000}|[԰-\U0010ffff]")


class Tokens:
    """Ids of whole texts as the tokenizer file's own library gives them.

    Ordinary texts go through a faster library with the same merges; texts with very long runs, or
    with characters whose class may differ between Unicode versions, through the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Vocabulary(path)  # refuses files that are no plain byte-level BPE
        if any(b < a for a, b in zip(vocabulary.merged, vocabulary.merged[1:])):
            raise ValueError(f"{path} does not number its tokens in the order of their merges")
        with open(path, encoding="utf-8") as source:
            strings = json.load(source)["model"]["vocab"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(to_byte[c] for c in s): i for s, i in strings.items() if i not in vocabulary.special.values()}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.special)
        self.own = Tokenizer.from_file(path)
        self.own.no_padding()
        self.own.no_truncation()

    def ids(self, text: str) -> np.ndarray:
        if _SLOW.search(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


@cache
def tokens(path: str) -> Tokens:
    """One per worker process, kept between tasks."""
    return Tokens(path)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of ``most``, but for the first."""
    first = n if n <= most else (n - 1) % most + 1
    return [(0, first), *[(at, most) for at in range(first, n, most)]]


def best_fit(lengths: list[int], most: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset per item, and fill per bin; longest items first, each into the fullest bin it fits."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    free: list[int] = []  # free places that some open bin has, in order
    of_free: dict[int, list[int]] = {}
    for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        need = lengths[item]
        at = bisect_left(free, need)
        if at < len(free):
            left = free[at]
            own = of_free[left]
            chosen = own.pop()
            if not own:
                del of_free[left]
                del free[at]
        else:
            left, chosen = most, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += need
        left -= need
        if left:
            if left not in of_free:
                of_free[left] = []
                insort(free, left)
            of_free[left].append(chosen)
    return bins, offsets, fills


PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, part long, bin long, place long, fill long"


def _pack_partition(path: str, most: int, end: int, with_ids: bool, kind):
    """Tokenize a partition's documents, cut them into pieces, and pack these best-fit."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "place", "fill"] + ["ids"] * with_ids

    def packed(docs, found, blobs, part, first):
        bins, places, fills = best_fit([f[2] for f in found], most)
        numbers = (part << 32) + first + np.array(bins, np.int64)
        columns = [np.array(c, np.int64) for c in zip(*found, strict=True)]
        columns += [np.full(len(found), part), numbers, np.array(places, np.int64), np.array(fills, np.int64)[bins]]
        arrays = [pa.array(docs, kind), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])]
        return len(fills), pa.RecordBatch.from_arrays([*arrays, *[pa.array(blobs, pa.binary())] * with_ids], names=names)

    def run(batches):
        tool, part, made = tokens(path), TaskContext.get().partitionId(), 0
        docs, found, blobs = [], [], []
        for batch in (b for batch in batches for b in by_size(batch, 1)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tool.ids(text or ""), np.uint32(end)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), most)):
                    own = ids[start : start + length].tobytes()
                    found.append((piece, start, length, zlib.crc32(own)))
                    docs.append(doc)
                    if with_ids:
                        blobs.append(own)
            if len(found) >= CHUNK:
                bins, out = packed(docs, found, blobs, part, made)
                made, docs, found, blobs = made + bins, [], [], []
                yield out
        if found:
            yield packed(docs, found, blobs, part, made)[1]

    return run


LEVEL = "bin long, into long, shift long, part long, fill long"


def _pack_group(most: int):
    """Pack one group's open bins (bin, fill, group), as items, into each other; a host keeps its number."""
    import pyarrow as pa

    def run(key, table):
        bins, fills_in = table.column("bin").to_numpy(), table.column("fill").to_numpy()
        order = np.lexsort((bins, -fills_in))
        bins, fills_in = bins[order], fills_in[order]
        chosen, shifts, fills = best_fit(fills_in.tolist(), most)
        hosts = np.zeros(len(fills), np.int64)
        for item, (bin_no, shift) in enumerate(zip(chosen, shifts, strict=True)):
            if shift == 0:
                hosts[bin_no] = bins[item]
        columns = [bins, hosts[chosen], np.array(shifts, np.int64), np.full(len(bins), key[0].as_py()), np.array(fills, np.int64)[chosen]]
        return pa.table(columns, names=[c.split()[0] for c in LEVEL.split(", ")])

    return run


def _open_bins(bins: DataFrame, most: int) -> DataFrame:
    """Of bins (bin, fill, part) those that go up: up to half full, and each part's emptiest others."""
    emptiest = F.row_number().over(Window.partitionBy("part").orderBy("fill", "bin"))
    return bins.filter(F.col("fill") <= most - NEARLY_FULL).withColumn("_n", emptiest).filter(f"_n <= {HOSTS} or 2 * fill <= {most}").drop("_n")


def placed(
    docs: DataFrame, path: str, most: int = 2048, end: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): where each piece of each document lies.

    A document is its whole text's ids by the byte-level BPE file ``path`` (strings of special
    tokens in a text become these tokens) and the id ``end``. Only documents of more than ``most``
    tokens are cut, into pieces of ``most``; the first piece takes the rest. Pieces that share a
    sequence_id lie one after the other from offset 0, at most ``most`` tokens in all.

    Null and empty texts are the id ``end`` alone. Repeated rows and null ids are documents of their
    own; other columns are ignored; an empty table gives an empty result. The packing depends on
    how the table is split into partitions, the pieces do not.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    columns = PIECES.format(kind.simpleString()) + ", ids binary" * with_ids
    pieces = stored(rows.mapInArrow(_pack_partition(path, most, end, with_ids, to_arrow_type(kind)), columns), "pieces")
    bins = pieces.filter("place = 0").select("bin", "fill", "part")
    moves = []
    highest = bins.agg(F.max("part")).first()[0] or 0
    while highest > 0:
        items = _open_bins(bins, most).withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        level = stored(items.groupBy("part").applyInArrow(_pack_group(most), LEVEL), "level")
        moves.append(level.select("bin", "into", "shift"))
        bins = level.filter("shift = 0").select("bin", "fill", "part")
        highest //= FAN
    # Where an open bin of the first level ends up: its host's place, level by level.
    end_of = None
    for level in reversed(moves):
        if end_of is None:
            end_of = level
            continue
        higher = end_of.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
        end_of = level.join(higher, "into", "left").select(
            "bin", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")
        )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if end_of is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"), *["ids"] * with_ids)
    moved = pieces.join(end_of.filter("shift > 0"), "bin", "left")
    return moved.select(
        *columns, F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"), *["ids"] * with_ids,
    )


def sequences(docs: DataFrame, path: str, most: int = 2048, **options) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces, ids): the packed sequences themselves, ids as little-endian 32-bit integers."""
    pieces = placed(docs, path, most, with_ids=True, **options)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), ordered.alias("p")).select(
        "sequence_id", "n_tokens", "n_pieces", F.expr("aggregate(p, X'', (whole, x) -> concat(whole, x.ids))").alias("ids")
    )
