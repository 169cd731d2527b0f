"""Token counts without ids: pieces once per distinct pre-token, summed by per-document frequencies.

Spark collects the distinct pre-tokens of the corpus and counts the pieces of each once. The counts
go into sorted hash arrays in the shared folder, and the second pass over the documents looks up
its pre-tokens there, batch by batch: the join that this is moves no text and no document-level
rows. Pre-tokens are known by 64-bit hashes.
"""

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docproof.llm.bpe import encoder, merge
from docproof.llm.hash_table import Table, write_table
from docproof.llm.support import ship_package, stored
from docproof.llm.textscan import as_bytes, by_size, string_hashes

# Distinct pre-tokens that a task gathers before it hands them on.
GATHERED = 1 << 18


def _distinct(vocabulary: str):
    import pyarrow as pa

    def run(batches):
        splitter, chunks, found = encoder(vocabulary).splitter, set(), set()

        def flush():
            for chunk in chunks:
                found.update(splitter.pre_tokens(chunk))
            chunks.clear()
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["piece"])
            found.clear()
            return out

        for batch in (part for batch in batches for part in by_size(batch, 0)):
            for text in as_bytes(batch.column(0)):
                for special, segment in splitter.segments(text.decode("utf-8", "replace")):
                    if special is None:
                        chunks.update(splitter.chunks(segment))
                if len(chunks) > GATHERED:
                    yield flush()
        yield flush()

    return run


def _count_pieces(vocabulary: str):
    import pyarrow as pa

    def run(batches):
        own = encoder(vocabulary).vocabulary
        for batch in batches:
            pieces = as_bytes(batch.column(0))
            counts = [len(merge([own.byte_ids[b] for b in p], own.ranks, own.merged)) for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [pa.array(string_hashes(pieces).view(np.int64)), pa.array(counts, pa.int64())], names=["key", "value"]
            )

    return run


def _sum_counts(vocabulary: str, table: Table):
    import pyarrow as pa

    def chunk_counts(splitter, chunks):
        """Pieces of each chunk, by one lookup of all its pre-tokens."""
        parts = [splitter.pre_tokens(c) for c in chunks]
        keys = string_hashes([p.encode() for own in parts for p in own])
        distinct, place = np.unique(keys, return_inverse=True)
        found = table.get(distinct)
        if not found.all():
            raise ValueError(f"{np.count_nonzero(found == 0)} pre-tokens were never counted")
        values = np.concatenate(([0], np.cumsum(found[place])))
        ends = np.cumsum([0, *[len(own) for own in parts]])
        return dict(zip(chunks, (values[ends[1:]] - values[ends[:-1]]).tolist(), strict=True))

    def counted(splitter, texts):
        special, frequencies = [], []
        for text in texts:
            plain, n = Counter(), 0
            for mark, segment in splitter.segments(text.decode("utf-8", "replace")):
                if mark is None:
                    plain.update(splitter.chunks(segment))
                else:
                    n += 1
            special.append(n)
            frequencies.append(plain)
        known = chunk_counts(splitter, list(set().union(*frequencies)))
        return [n + sum([known[c] * k for c, k in own.items()]) for n, own in zip(special, frequencies, strict=True)]

    def run(batches):
        splitter = encoder(vocabulary).splitter
        for batch in (part for batch in batches for part in by_size(batch, 1, 1 << 23)):
            texts = as_bytes(batch.column(1))
            counts = counted(splitter, texts)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text, without making token ids.

    ``vocabulary`` is the path of a byte-level BPE file that every worker can open. A special
    token's string in a text counts as one token. Null and empty texts have 0 bytes and 0 tokens.
    Repeated rows and null ids come back as they are; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.select("text").mapInArrow(_distinct(vocabulary), "piece string").distinct()
    counts = stored(pieces.mapInArrow(_count_pieces(vocabulary), "key long, value long"), "pieces")
    n = counts.count()
    folder, bits = write_table(counts, n, "piece-counts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    summed = rows.mapInArrow(_sum_counts(vocabulary, Table(folder, bits, n == 0)), f"doc_id {kind}, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
