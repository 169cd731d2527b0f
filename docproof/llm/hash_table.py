"""Sorted hash arrays in the shared folder: Spark deals rows into shards, tasks write them, workers map them.

A shard holds the keys whose highest bits are its number, sorted, and the values beside them.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docproof.llm.support import map_array, new_folder, write_array

ROWS_PER_SHARD = 1 << 20


def shard_bits(rows: int, per_shard: int = ROWS_PER_SHARD) -> int:
    """How many of a key's highest bits number its shard, so that shards stay of one size."""
    return max(0, int(rows // per_shard).bit_length())


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def write_table(rows: DataFrame, n_rows: int, purpose: str) -> tuple[str, int]:
    """Write (key long, value long) with distinct keys as sorted arrays; returns folder and shard bits."""
    import pandas as pd

    folder, bits = new_folder(rows.sparkSession, purpose), shard_bits(n_rows)

    def write(frame):
        keys = frame["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        shard = int(frame["shard"].iloc[0])
        write_array(folder, f"key-{shard}", keys[order])
        write_array(folder, f"value-{shard}", frame["value"].to_numpy(np.int64)[order].astype(np.uint32))
        return pd.DataFrame({"shard": [shard], "rows": [len(frame)]})

    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0)
    dealt = rows.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(write, "shard int, rows long")
    dealt.agg(F.sum("rows")).collect()
    return folder, bits


class Table:
    """Lookups in the arrays that ``write_table`` wrote; shards are mapped when first needed."""

    def __init__(self, folder: str, bits: int, empty: bool = False):
        self.folder, self.bits, self.empty, self.mapped = folder, bits, empty, {}

    def _shard(self, shard: int):
        if shard not in self.mapped:
            self.mapped[shard] = [map_array(self.folder, f"{name}-{shard}") for name in ("key", "value")]
        return self.mapped[shard]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of sorted distinct keys, 0 where a key is missing."""
        out = np.zeros(len(keys), np.int64)
        if self.empty or not len(keys):
            return out
        shards = shard_of(keys, self.bits)
        bounds = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            try:
                known, values = self._shard(int(shards[begin]))
            except FileNotFoundError:  # no key of the table falls into this shard
                continue
            at = np.searchsorted(known, keys[begin:end])
            at[at == len(known)] = 0
            out[begin:end] = np.where(known[at] == keys[begin:end], values[at], 0)
        return out
