"""Hard negatives by Kronecker-packed integer products.

Scores are inner products of whole-numbered vectors. The components of several candidates, lifted
to be non-negative, lie side by side in fields of one 64-bit integer, so that one multiplication per
anchor component serves them all. A field is as wide as the largest sum it can hold, hence the
fields never run into each other and every score is read off exactly.

Rows are dealt into blocks sorted by label. Anchors first meet the blocks that hold their label, for
their positives, and then every block, for the negatives in reach of each positive.
"""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docproof.llm.integers import longs, narrow, whole, widen
from docproof.llm.support import in_groups, join_hot, keep_blocks, kept_block, ship_package, stored
from docproof.llm.vectors import is_finite_vector

ITEMS, ANCHORS = 4096, 512
# Blocks of rows that a task holds at a time.
GROUP = 16
# Bits of a word that hold fields; the sign bit stays free.
WORD = 63
# Stands for a positive that an anchor with fewer of them does not have.
NOBODY = -(1 << 63)


def packed_scores(items: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """All inner products of two blocks of 64-bit integer vectors, exact; anchors x items."""
    n = len(items)
    if not n or not len(anchors):
        return np.zeros((len(anchors), n), np.int64)
    low = int(items.min(initial=0))
    top = int(items.max(initial=0)) - low
    weights = np.abs(anchors.astype(np.float64)).sum(axis=1).max()
    width = max(1, int(1.001 * weights * top + 1).bit_length())
    if width > WORD or top >= 1 << 62:
        raise ValueError("products are beyond 64 bits")
    fields = WORD // width
    words = -(-n // fields)
    lifted = np.zeros((fields * words, items.shape[1]), np.int64)
    lifted[:n] = items - low
    shifts = [width * f for f in range(fields)]
    packed = np.zeros((words, items.shape[1]), np.int64)
    for f, shift in enumerate(shifts):
        packed |= lifted[f * words : (f + 1) * words] << shift
    # What the negative components could take from a field is added to each field beforehand.
    debt = top * np.maximum(-anchors, 0).sum(axis=1)
    sums = anchors @ packed.T + (debt * sum(1 << shift for shift in shifts))[:, None]
    mask = (1 << width) - 1
    read = np.hstack([(sums >> shift) & mask for shift in shifts])[:, :n]
    return read + (low * anchors.sum(axis=1) - debt)[:, None]


def _best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, ties to the smaller id."""
    places = np.arange(len(values))
    if len(values) > k:
        places = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    return places[np.lexsort((ids[places], -values[places]))][:k]


def _padded(lists, width: int) -> np.ndarray:
    """An Arrow column of lists of at most ``width`` longs as rows that end in ``NOBODY``."""
    out = np.full((len(lists), width), NOBODY, np.int64)
    lengths = lists.value_lengths().fill_null(0).to_numpy()
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _blocks(size: int, scale: float, lists: dict[str, int]):
    """Pack rows (vec_id, label, v, then ``lists`` by name and width) of a partition into blocks of one vector length."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["part", "block", "dims", "ids", "labels", "rows", *lists]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * (3 + len(lists))]

    def pack(batches):
        waiting, part, made = {}, TaskContext.get().partitionId(), 0

        def out(dims):
            ids, labels, rows, *others = (np.concatenate(c) for c in waiting.pop(dims))
            values = [part, part << 32 | made, dims, ids.tobytes(), labels.tobytes(), narrow(rows), *[o.tobytes() for o in others]]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                lengths = piece.column(2).value_lengths().to_numpy()
                for dims in map(int, np.unique(lengths)):
                    chosen = np.flatnonzero(lengths == dims)
                    ids, labels, rows, *others = (c.take(pa.array(chosen)) for c in piece.columns)
                    own = [ids.to_numpy(), labels.to_numpy(), whole(rows, scale)]
                    own += [_padded(o, width) for o, width in zip(others, lists.values(), strict=True)]
                    held = waiting.setdefault(dims, [[] for _ in own])
                    for column, values in zip(held, own, strict=True):
                        column.append(values)
                    if sum(map(len, held[0])) >= size:
                        yield out(dims)
                        made += 1
        for dims in list(waiting):
            yield out(dims)
            made += 1

    return pack


def _labels(batches):
    """The distinct labels of each block."""
    import pyarrow as pa

    for batch in batches:
        for part, block, dims, labels in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = np.unique(longs(labels))
            same = [pa.array(np.full(len(own), v), kind) for v, kind in ((part, pa.int32()), (block, pa.int64()), (dims, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(own)], names=["part", "block", "dims", "label"])


def _found(rows: list[tuple], names: list[str]):
    """Pieces of equally long arrays as one record batch of longs."""
    import pyarrow as pa

    columns = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in zip(*rows, strict=True)] or [
        np.empty(0, np.int64) for _ in names
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _first(found: list[tuple], k: int):
    """Of rows (group columns, id, score) the k highest scores of each group, ties to the smaller id."""
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    if not columns or not len(columns[0]):
        return columns and [tuple(columns)]
    *groups, ids, values = columns
    order = np.lexsort((ids, -values, *reversed(groups)))
    columns = [c[order] for c in columns]
    changes = np.any([g[1:] != g[:-1] for g in columns[: len(groups)]], axis=0)
    starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return [tuple(c[rank < k] for c in columns)]


def _positives(k: int, folder: str):
    """The k best rows of the same label, of each anchor in the blocks that it meets."""

    def meet(anchor, row, k):
        ids, labels = longs(row["ids"]), longs(row["labels"])
        a_ids, a_labels = longs(anchor["ids"]), longs(anchor["labels"])
        items, anchors = widen(row["rows"], len(ids)), widen(anchor["rows"], len(a_ids))
        for label in np.unique(a_labels):
            mine, own = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
            scores = packed_scores(items[own], anchors[mine])
            for i, line in zip(mine, scores, strict=True):
                others = ids[own] != a_ids[i]
                places = _best(line[others], ids[own][others], k)
                yield np.full(len(places), a_ids[i]), ids[own][others][places], line[others][places]

    def run(batches):
        for rows in in_groups(batches, GROUP):
            for block in sorted({block for row in rows for block in row["a_blocks"]}):
                anchor = kept_block(folder, block, COLUMNS)
                found = [piece for row in rows if block in row["a_blocks"] for piece in meet(anchor, row, k)]
                yield _found(_first(found, k), ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int, folder: str, names: dict[int, list[int]]):
    """The k best rows of other labels in reach of each positive, of each anchor in the blocks of a task."""

    def meet(anchor, row):
        ids, labels = longs(row["ids"]), longs(row["labels"])
        a_ids, a_labels = longs(anchor["ids"]), longs(anchor["labels"])
        p_ids, p_scores = (longs(anchor[c]).reshape(len(a_ids), -1) for c in ("p_ids", "p_scores"))
        scores = packed_scores(widen(row["rows"], len(ids)), widen(anchor["rows"], len(a_ids)))
        for i, line in enumerate(scores):
            others = np.flatnonzero(labels != a_labels[i])
            values = line[others]
            for at in np.flatnonzero(p_ids[i] != NOBODY):
                positive = int(p_scores[i, at])
                reach = (values >= -(-low * positive // 100)) & (values <= high * positive // 100)
                places = others[reach][_best(values[reach], ids[others[reach]], k)]
                n = len(places)
                yield np.full(n, a_ids[i]), np.full(n, p_ids[i, at]), np.full(n, positive), ids[places], line[places]

    def run(batches):
        for rows in in_groups(batches, GROUP):
            for dims in sorted({row["dims"] for row in rows} & names.keys()):
                for block in names[dims]:
                    anchor = kept_block(folder, block, [*COLUMNS, *LISTS])
                    found = [piece for row in rows if row["dims"] == dims for piece in meet(anchor, row)]
                    yield _found(_first(found, k), ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


BLOCK = "part int, block long, dims int, ids binary, labels binary, rows binary"
COLUMNS = ["ids", "labels", "rows"]
LISTS = ["p_ids", "p_scores"]


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, label, v, others) in order of labels, in parts of about ``size``."""
    n_parts = max(1, rows.count() // size)
    ordered = rows.repartitionByRange(n_parts, "label", "vec_id").sortWithinPartitions("label", "vec_id")
    return ordered.select("vec_id", "label", "v", *[c for c in rows.columns if c not in ("vec_id", "label", "v")])


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor's positives.

    Components x become floor(scale * x), a score is an integer inner product. An anchor, picked by a
    condition on the id column ``vec_id``, has as positives the ``positives`` best other rows of its
    label. For each of them come the ``negatives`` best rows of other labels whose score is between
    ``low`` and ``high`` per cent of the positive's; there are fewer rows where fewer qualify, and
    none for positives of a negative score. Ties go to the smaller id.

    Rows with a null id, label or vector, an empty vector, or null or non-finite components take no
    part, and vectors of different lengths never meet. Rows that repeat an id count once, with the
    smallest (label, vector). An empty table gives an empty result, other columns are ignored.
    Products beyond 64 bits raise an error.

    Blocks are range-partitioned by label and id, so a label of any size is spread over tasks. A task holds
    a few blocks of rows and one of anchors, which it reads from the shared folder, so anchors are neither
    shuffled nor broadcast for each block they meet.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    good = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite_vector(F.col("v")))
    once = good.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")
    rows = stored(once, "vectors")
    anchors = rows.filter(is_anchor)
    items = stored(_dealt(rows, ITEMS).mapInArrow(_blocks(ITEMS, scale, {}), BLOCK), "items")
    blocks = stored(_dealt(anchors, ANCHORS).mapInArrow(_blocks(ANCHORS, scale, {}), BLOCK), "anchors")

    # Blocks in order of labels: an anchor block meets the few blocks that hold one of its labels.
    held, asked = (
        df.select("part", "block", "dims", "labels").mapInArrow(_labels, "part int, block long, dims int, label long") for df in (items, blocks)
    )
    asked = asked.select(F.col("block").alias("a_block"), "dims", "label")
    pairs = join_hot(asked, held.drop("part"), ["label", "dims"], "a_block").select("a_block", "block").distinct()
    met = pairs.groupBy("block").agg(F.sort_array(F.collect_list("a_block")).alias("a_blocks"))
    near = items.join(met, "block").select("a_blocks", *COLUMNS)
    folder, _ = keep_blocks(blocks, COLUMNS, "anchor-blocks")
    found = near.mapInArrow(_positives(positives, folder), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives)
    lists = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    lists = lists.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores"))

    widths = dict.fromkeys(LISTS, positives)
    ready = _dealt(anchors.join(lists, "vec_id"), ANCHORS).mapInArrow(_blocks(ANCHORS, scale, widths), f"{BLOCK}, p_ids binary, p_scores binary")
    folder, names = keep_blocks(stored(ready, "positives"), [*COLUMNS, *LISTS], "positive-blocks")
    far = items.select("dims", *COLUMNS).mapInArrow(
        _negatives(negatives, low, high, folder, names),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
