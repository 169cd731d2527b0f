"""Shards by jump consistent hashing, in SQL expressions only.

The hash walks through the shard counts at which a key would move and stops before the count given,
so a shard that is appended takes rows only into itself, and only its fair share of them.
"""

from pyspark.sql import DataFrame, Window, functions as F

from docproof.llm.support import stored

# The 16-bit parts of the generator's multiplier 2862933555777941757, highest first.
M3, M2, M1, M0 = 0x27BB, 0x2EE6, 0x87B0, 0xB0FD
_LOW = (1 << 32) - 1


def _times(half: str, high: int, low: int) -> str:
    """half * (high * 2**16 + low), without what the high part's product has beyond 2**16."""
    return f"({half} * {low} + shiftleft(({half} * {high}) & 65535, 16))"


def jump_sql(key: str, shards: int) -> str:
    """struct with ``shard`` among ``shards`` and ``grown_shard`` among one more, for a bigint key.

    The generator's 64-bit state is kept as two 32-bit halves, because SQL has no wrapping product.
    """
    low_product = f"({_times('s.lo', M1, M0)} + 1)"
    carry = f"(shiftright({low_product}, 32) + shiftright(s.lo * {M1}, 16))"
    high = f"(({carry} + {_times('s.hi', M1, M0)} + {_times('s.lo', M3, M2)}) & {_LOW}L)"
    jump = f"cast(floor((s.next + 1) * (2147483648D / cast(shiftright({high}, 1) + 1 as double))) as bigint)"
    start = (
        f"named_struct('hi', shiftrightunsigned({key}, 32), 'lo', {key} & {_LOW}L, "
        "'shard', 0L, 'grown_shard', 0L, 'next', 0L)"
    )
    step = (
        f"named_struct('hi', {high}, 'lo', {low_product} & {_LOW}L, "
        f"'shard', if(s.next < {shards}, s.next, s.shard), 'grown_shard', s.next, 'next', {jump})"
    )
    return f"aggregate(sequence(0, {shards}), {start}, (s, i) -> if(s.next > {shards}, s, {step}))"


def shards(
    docs: DataFrame, n_shards: int, parts: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): the rows' places in ``n_shards`` shards.

    The law is ``key``: doc_id and shard count alone decide, so rows that repeat a doc_id share a
    shard. ``grown_shard`` is the place with one more shard: the same one, or the new one. Slots
    number a shard's rows from 0 by doc_id; rows with the same doc_id follow each other by checksum
    and size. A null doc_id counts as key 0 and comes first. Null texts have no bytes and the
    checksum of the empty text. Other columns are ignored; an empty table gives an empty result.

    Slots need no shard in one task: rows are range-partitioned by shard and doc_id, numbered
    within their part, and shifted by the row counts of the shard's earlier parts.
    """
    n_parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    placed = (
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.octet_length(content) + 8).cast("long").alias("size"),
            F.crc32(content).alias("text_crc32"),
            F.expr(jump_sql(f"coalesce(cast(`{doc_id}` as bigint), 0L)", n_shards)).alias("_path"),
        )
        .select("doc_id", "size", "text_crc32", F.col("_path.shard").cast("int").alias("shard"),
                F.col("_path.grown_shard").cast("int").alias("grown_shard"))
    )
    order = ["doc_id", "text_crc32", "size"]
    dealt = placed.repartitionByRange(n_parts, "shard", *order, F.rand(1)).withColumn("_part", F.spark_partition_id())
    rows = stored(dealt, "shards")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*[F.asc_nulls_first(c) for c in order])) - 1
    return (
        rows.withColumn("_at", within)
        .join(starts, ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("_start") + F.col("_at")).alias("slot"), "grown_shard")
    )
