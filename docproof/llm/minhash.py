"""Near duplicates by b-bit MinHash: band candidates, bit-count estimates, exact confirmation.

Every document gets ``BANDS * ROWS`` minima over its shingle set. Bands of minima give candidate
buckets; the lowest ``BITS`` bits of every minimum are packed into longs, and counting equal fields
estimates the similarity, corrected for fields that agree by chance. What the estimate does not
rule out is confirmed on the full sets.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docproof.llm.components import components
from docproof.llm.support import free_name, join_hot, ship_package, stored
from docproof.llm.textscan import as_bytes, by_size, mix, shingle_sets

# A pair at exactly 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 6e-5.
BANDS, ROWS, BITS = 32, 6, 2
FIELDS_PER_LONG = 64 // BITS
# The estimate's standard deviation at 0.8 is 0.034; pairs this far below are ruled out.
MARGIN = 0.15
BLOCK = 512
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def _low_bits(minima: np.ndarray) -> np.ndarray:
    """The lowest bits of mixed minima, packed: one row of longs per document."""
    low = (mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(len(minima), -1, FIELDS_PER_LONG)
    shifts = (np.arange(FIELDS_PER_LONG) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(low << shifts, axis=2).astype(np.int64)


def _bands(minima: np.ndarray) -> np.ndarray:
    """One key per band, different for different bands."""
    rows = minima.astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + rows[:, :, r])
    return keys.view(np.int64) if keys.flags.c_contiguous else keys.astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all hash functions over each of some non-empty sets."""
    joined = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    minima = np.empty((len(sets), len(_A)), np.uint32)
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        minima[:, i] = np.minimum.reduceat(joined * a + b, starts)
    return minima


def _signer(words: int):
    import pyarrow as pa

    def table(ids, sets, known):
        counts = np.array([len(s) for s in sets], np.int64)
        full = [s for s in sets if len(s)]
        first, second = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        bands, bits = np.empty((0, BANDS), np.int64), np.empty((0, 2 * BANDS * ROWS // 64), np.int64)
        if full:
            joined, starts = np.concatenate(full), np.cumsum([0, *[len(s) for s in full[:-1]]])
            first[counts > 0] = np.add.reduceat(mix(joined), starts).view(np.int64)
            second[counts > 0] = np.add.reduceat(mix(joined ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts).view(np.int64)
            minima = signatures(full)
            bands, bits = _bands(minima), _low_bits(minima)
        width = np.where(counts > 0, 1, 0)

        def arrays(values):
            ends = np.concatenate(([0], np.cumsum(width * values.shape[1]))).astype(np.int32)
            return pa.ListArray.from_arrays(ends, np.ascontiguousarray(values).reshape(-1))

        columns = [ids, counts, first, second, arrays(bands), arrays(bits)]
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=known
        )

    names = [part.split()[0] for part in SIGNED.split(", ")]

    def sign(batches):
        for part in (part for batch in batches for part in by_size(batch, 1)):
            yield table(part.column(0), shingle_sets(as_bytes(part.column(1)), words), names)

    return sign


def estimate(left: Column | str, right: Column | str) -> Column:
    """Similarity from two packed signatures, corrected for chance agreement of low bits."""
    pairs = F.zip_with(left, right, lambda x, y: x.bitwiseXOR(y))
    odd = F.lit(0x5555555555555555)
    differ = F.aggregate(
        pairs, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    )
    chance = 1 / 2**BITS
    return (1 - differ / F.lit(BANDS * ROWS) - chance) / (1 - chance)


def _confirmer(words: int, percent: int):
    import pyarrow as pa

    def confirm(batches):
        for part in (part for batch in batches for part in by_size(batch, 3)):
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = dict(zip(a, as_bytes(part.column(2)), strict=True)) | dict(zip(b, as_bytes(part.column(3)), strict=True))
            sets = dict(zip(texts, shingle_sets(list(texts.values()), words), strict=True))
            linked = []
            for x, y in zip(a, b, strict=True):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                linked.append(100 * common >= percent * (len(sets[x]) + len(sets[y]) - common))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(linked, pa.bool_())), part.column(1).filter(pa.array(linked, pa.bool_()))], names=["a", "b"]
            )

    return confirm


def _with_end(pairs: DataFrame, side: str, table: DataFrame, value: str) -> DataFrame:
    """Add one end's value to pairs; the adaptive skew join splits an end with very many pairs."""
    ends = table.select(F.col("id").alias(side), F.col(value).alias(f"{value}_{side}"))
    return pairs.join(ends, side)


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    both = _with_end(_with_end(pairs, "a", texts, "text"), "b", texts, "text")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(words, percent), "a long, b long")


class _Block:
    """Rows of one bucket block: those of the bucket's largest component so far, and all others."""

    def __init__(self, rows, words: int, percent: int):
        once = {row: at for at, row in enumerate(zip(rows["id"].to_pylist(), rows["rare"].to_pylist(), strict=True))}
        rows = rows.take([*once.values()]).combine_chunks()
        self.key = rows["key"][0].as_py()
        self.ids, self.components = (rows[c].to_numpy().copy() for c in ("id", "component"))
        self.rare = np.array([rare for _, rare in once], bool)
        self.bands, self.bits = (rows[c].combine_chunks().flatten().to_numpy().reshape(len(once), -1) for c in ("bands", "bits"))
        self.bits = self.bits.view(np.uint64)
        self.texts, self.words, self.percent, self.sets = rows["text"].combine_chunks(), words, percent, {}

    def set_of(self, i: int) -> np.ndarray:
        if self.ids[i] not in self.sets:
            self.sets[self.ids[i]] = shingle_sets([self.texts[int(i)].as_py() or b""], self.words)[0]
        return self.sets[self.ids[i]]

    def similar(self, i: int, j: int) -> bool:
        x, y = self.set_of(i), self.set_of(j)
        if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= self.percent * (len(x) + len(y) - common)

    def links(self, lowest: float):
        """Confirmed links that connect components; pairs that share an earlier bucket are left to it."""
        field = np.uint64(0x5555555555555555)
        others = np.flatnonzero(~self.rare)
        for i in np.flatnonzero(self.rare):
            apart = others[self.components[others] != self.components[i]]
            x = self.bits[apart] ^ self.bits[i]
            differ = np.bitwise_count((x | (x >> np.uint64(1))) & field).sum(axis=1, dtype=np.int64)
            alike = (1 - differ / (BANDS * ROWS) - 2.0**-BITS) / (1 - 2.0**-BITS)
            found = apart[alike >= lowest][np.argsort(-alike[alike >= lowest], kind="stable")]
            first = (self.bands[found] == self.bands[i]).argmax(axis=1)
            for j in found[self.bands[i][first] == self.key]:
                if self.components[j] != self.components[i] and self.similar(i, j):
                    self.components[self.components == self.components[i]] = self.components[j]
                    yield int(self.ids[i]), int(self.ids[j])


def _linker(words: int, percent: int, lowest: float):
    """Links of all blocks of a partition whose rows come block by block."""
    import pyarrow as pa

    def batch_of(parts):
        pairs = list(_Block(pa.Table.from_batches(parts), words, percent).links(lowest))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        waiting, block = [], None
        for part in (part for batch in batches for part in by_size(batch, 8)):
            places = np.stack([part[c].to_numpy() for c in ("key", "block", "chunk")], axis=1)
            starts = np.flatnonzero(np.any(places[1:] != places[:-1], axis=1)) + 1
            for at, end in zip([0, *starts], [*starts, len(places)], strict=True):
                if end > at:
                    if waiting and tuple(places[at]) != block:
                        yield batch_of(waiting)
                        waiting = []
                    block = tuple(places[at])
                    waiting.append(part.slice(at, end - at))
        if waiting:
            yield batch_of(waiting)

    return run


def _cross_links(shared: DataFrame, payload: DataFrame, comps: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between rows of one bucket that are in different components so far.

    Rows outside a bucket's largest component are compared with all rows of the bucket, in blocks;
    rows inside it need no comparison with each other, because they are connected already. Only
    links that connect something are written out.
    """
    rows = _with_component(shared, comps)
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = (
        sizes.groupBy("key")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("total"),
             F.max("n").alias("most"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select(
            "key", "main",
            F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("chunks"),
        )
    )
    mixed = stored(join_hot(rows, buckets, ["key"], "id"), "mixed")
    every = mixed.select(
        "key", "id", "component", F.lit(False).alias("rare"),
        F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
    )
    rare = mixed.filter(F.col("component") != F.col("main")).select(
        "key", "id", "component", F.lit(True).alias("rare"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"),
    )
    block = ["key", "block", "chunk"]
    dealt = every.unionByName(rare).join(payload, "id").repartition(*block).sortWithinPartitions(*block)
    columns = [*block, "id", "component", "rare", "bits", "bands", F.col("text").cast("binary").alias("text")]
    return dealt.select(*columns).mapInArrow(_linker(words, percent, percent / 100 - MARGIN), "a long, b long")


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (id, ...) with ``component``: the id itself where nothing is linked."""
    return rows.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _joined_up(comps: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) after further links: only the components that these connect are searched anew."""
    one = _with_component(more.select(F.col("a").alias("id"), "b"), comps).select(F.col("component").alias("a"), "b")
    two = _with_component(one.select(F.col("b").alias("id"), "a"), comps).select("a", F.col("component").alias("b"))
    merged = stored(components(two, "a", "b"), "merged")
    grown = comps.join(merged.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left")
    alone = merged.join(comps.select("id"), "id", "left_anti")
    return grown.select("id", F.coalesce("whole", "component").alias("component")).unionByName(alone)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of near copies of whole texts.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct
    ``words``-word shingles; component_id is the smallest doc_id reachable over links, and kept is
    true for that document. Equal sets are one node. The search:

    1. in each band bucket all rows are paired with the smallest; what the bit counts do not rule
       out is confirmed, and the links give first components;
    2. in buckets that still hold different components, each row outside the largest meets all
       rows whose estimate allows a link, block by block, and links are confirmed on the spot. So no
       bucket is cut, and pairs are never written out, only links that connect something.

    Null, empty and blank texts have no shingles and link with nothing. A null doc_id links with
    nothing and gets a null component_id and kept = true. Rows that repeat a doc_id are one
    document; if their texts differ, the links of the greatest text count. An empty table gives an empty result. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    marks = stored(rows.mapInArrow(_signer(words), SIGNED), "signatures")
    nodes = stored(
        marks.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")),
        "nodes",
    )
    buckets = nodes.select("id", F.explode("bands").alias("key"))
    least = buckets.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    shared = stored(join_hot(buckets, least, ["key"], "id"), "buckets").select("key", "id", "least")
    needed = nodes.join(shared.select("id").distinct(), "id", "left_semi").select("id", "bits", "bands")
    found = rows.join(needed, "id").groupBy("id")
    payload = stored(found.agg(F.max("text").alias("text"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "payload")
    pairs = shared.filter("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    alike = _with_end(_with_end(pairs, "a", payload, "bits"), "b", payload, "bits").filter(
        estimate("bits_a", "bits_b") >= percent / 100 - MARGIN
    )
    links = stored(_linked(alike.select("a", "b"), payload, words, percent), "links")
    comps = components(links, "a", "b")
    more = stored(_cross_links(shared.select("key", "id"), payload, comps, words, percent), "links")
    if not more.isEmpty():
        comps = _joined_up(comps, more)
    groups = _with_component(nodes.select("id", "set_a", "set_b"), comps).select("set_a", "set_b", "component")
    placed = join_hot(
        marks.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_a", "set_b"), groups, ["set_a", "set_b"], "doc_id", "left"
    )
    blank = marks.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    result = placed.select("doc_id", "n_shingles", "component").unionByName(blank)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents, exactly one row of each group of near copies; columns as they are.

    Every row is a node of its own, whatever its doc_id: of a group stays the row with the smallest
    doc_id, and of several such rows one. Null ids come last. Rows without words stay.
    """
    own, doc_id = free_name(docs, "_row"), F.col("doc_id")
    rows = stored(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.withColumn("doc_id", F.col(own)), words, percent).filter("n_shingles > 0")
    groups = stored(groups.select(F.col("doc_id").alias(own), "component_id"), "groups")
    members = groups.join(groups.filter(F.col(own) != F.col("component_id")).select("component_id").distinct(), "component_id", "left_semi")
    order = F.struct(doc_id.isNull().alias("unknown"), doc_id.alias("doc_id"), F.col(own).alias("row"))
    numbered = members.join(rows.select(own, "doc_id"), own)
    best = numbered.groupBy("component_id").agg(F.min(order)["row"].alias("stays"))
    gone = join_hot(numbered.select(own, "component_id"), best, ["component_id"], own).filter(F.col(own) != F.col("stays")).select(own)
    return rows.join(gone, own, "left_anti").select(*docs.columns)
