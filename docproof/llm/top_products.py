"""Exact top-k by integer inner products: norm order, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt into blocks by descending length, and each block is met by each block of queries.
A rotation fitted by SVD on a bounded sample puts most of a product into its first coordinates, so
the first ``HEAD`` rotated coordinates and the lengths of the rests bound every score from above.
A vector is multiplied out only if its bound reaches the query's k-th best score among the longest
vectors. Scores are whole numbers.
"""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docproof.llm.support import in_groups, keep_blocks, kept_block, ship_package, stored
from docproof.llm.vectors import is_finite_vector, matrix, unpack

# Rows that the rotation is fitted on, taken by the order of a hash of their ids.
SAMPLE = 4096
ITEMS, QUERIES, HEAD = 4096, 1024, 24
# Blocks of vectors that a task holds at a time.
GROUP = 16
Q_COLUMNS = ["q_ids", "q_rows", "floors"]
# Doubles hold whole products exactly below this.
EXACT = 2.0**52


def scores(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """All inner products of whole-numbered vectors, exact; queries x items."""
    reach = np.abs(items).max(initial=0) * np.abs(queries).max(initial=0) * items.shape[1]
    if reach < EXACT:
        return (queries @ items.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in queries], object) @ np.array([[int(v) for v in row] for row in items], object).T
    return exact.astype(np.int64)


def _best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, ties to the smaller id."""
    if len(values) > k:
        cut = np.partition(values, len(values) - k)[len(values) - k]
        places = np.flatnonzero(values >= cut)
    else:
        places = np.arange(len(values))
    return places[np.lexsort((ids[places], -values[places]))][:k]


def _blocks(size: int):
    """Pack rows into blocks of vectors of one length, in the order they come."""
    import pyarrow as pa

    def pack(batches):
        waiting = {}

        def out(dims):
            ids, rows = waiting.pop(dims)
            data = np.concatenate(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
                names=["dims", "ids", "rows"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids, lists = part.column(0).to_numpy(), part.column(1)
                lengths = lists.value_lengths().to_numpy()
                for dims in np.unique(lengths):
                    chosen = np.flatnonzero(lengths == dims)
                    held = waiting.setdefault(int(dims), ([], []))
                    held[0].append(ids[chosen])
                    held[1].append(np.floor(256.0 * matrix(lists.take(pa.array(chosen)))))
                    if sum(map(len, held[0])) >= size:
                        yield out(int(dims))
        for dims in list(waiting):
            yield out(dims)

    return pack


def fit_rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose first columns carry most of the sample's inner products."""
    if not len(sample):
        return np.eye(sample.shape[1])
    return np.linalg.svd(sample, full_matrices=True)[2].T


def _search(k: int, rotations: dict[int, np.ndarray], folder: str, names: dict[int, list[str]]):
    import pyarrow as pa

    def bounds(rows, rotation):
        turned = rows @ rotation
        head, rest = turned[:, :HEAD], np.linalg.norm(turned[:, HEAD:], axis=1)
        return head, rest, np.linalg.norm(rows, axis=1)

    def turned(row, rotation):
        """A block of items, longest first, with what bounds their products."""
        ids = np.frombuffer(row["ids"], np.int64)
        items = unpack(row["rows"], len(ids))
        head, rest, norm = bounds(items, rotation)
        order = np.argsort(-norm, kind="stable")
        return [values[order] for values in (ids, items, head, rest, norm)]

    def search(block, item_blocks, rotation):
        """The k best of a few item blocks for each query of a block; each one raises the floors for the next."""
        q_ids, floors = np.frombuffer(block["q_ids"], np.int64), np.frombuffer(block["floors"], np.float64).copy()
        queries = unpack(block["q_rows"], len(q_ids))
        q_head, q_rest, q_norm = bounds(queries, rotation)
        best = {}
        for ids, items, head, rest, norm in item_blocks:
            slack = 1e-9 * (1 + q_norm * norm.max(initial=0)) + 0.5
            # Lengths are sorted, so everything after the first too short vector is too short as well.
            ends = np.searchsorted(-norm, -(floors - slack) / np.maximum(q_norm, 1e-300), side="right")
            ends = np.where((floors > 0) & (q_norm > 0), ends, len(ids))
            upto = int(ends.max(initial=0))
            upper = q_head @ head[:upto].T + np.outer(q_rest, rest[:upto]) + slack[:, None]
            possible = (upper >= floors[:, None]) & (np.arange(upto) < ends[:, None])
            wanted = np.flatnonzero(possible.any(axis=0))
            if not len(wanted):
                continue
            exact, wanted_ids = scores(items[wanted], queries), ids[wanted]
            for i in np.flatnonzero((exact >= floors[:, None]).any(axis=1)):
                keep = np.flatnonzero((exact[i] >= floors[i]) & (wanted_ids != q_ids[i]))
                had_ids, had_scores = best.get(i, (wanted_ids[:0], exact[i][:0]))
                all_ids = np.concatenate([had_ids, wanted_ids[keep]])
                all_scores = np.concatenate([had_scores, exact[i][keep]])
                places = _best(all_scores, all_ids, k)
                best[i] = all_ids[places], all_scores[places]
                if len(places) == k:
                    floors[i] = max(floors[i], float(all_scores[places[-1]]))
        found = [(np.full(len(ids), q_ids[i]), ids, values) for i, (ids, values) in best.items()]
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    def run(batches):
        for rows in in_groups(batches, GROUP):
            for dims in sorted({row["dims"] for row in rows} & names.keys()):
                rotation = rotations.get(dims, np.eye(dims))
                item_blocks = [turned(row, rotation) for row in rows if row["dims"] == dims]
                for name in names[dims]:
                    yield search(kept_block(folder, name, Q_COLUMNS), item_blocks, rotation)

    return run


def _with_floors(k: int):
    """Add to each query block its k-th best score among the longest vectors."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                floors = np.full(len(q_ids), -np.inf)
                if row["ids"]:
                    ids = np.frombuffer(row["ids"], np.int64)
                    found = scores(unpack(row["rows"], len(ids)), unpack(row["q_rows"], len(q_ids)))
                    for i, one in enumerate(q_ids):
                        others = found[i][ids != one]
                        if len(others) >= k:
                            floors[i] = np.partition(others, len(others) - k)[len(others) - k]
                values = [row["dims"], row["q_ids"], row["q_rows"], floors.tobytes()]
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["dims", "q_ids", "q_rows", "floors"]
                )

    return run


def top_products(
    vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest products with all other vectors.

    Components x become floor(256 * x). ``is_query`` is a condition on the id column ``vec_id`` that
    picks the queries. Ties go to the smaller id; a query gets fewer rows if there are fewer other
    vectors. Null ids, and vectors that are null, empty or hold null or non-finite components, take
    no part; vectors of different lengths never meet. Rows that repeat an id count once, with
    the smallest vector. An empty table gives an empty result; other columns are ignored.
    Products beyond 64 bits raise an error.

    All queries meet all blocks of vectors; a task holds a few blocks of vectors and one of queries, which
    it reads from the shared folder, so queries are neither shuffled nor broadcast for each block they meet.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    good = (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & is_finite_vector(F.col("v")))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
        .withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256).cast("double"), 2)))
    )
    rows = stored(good, "vectors")
    n_parts = max(1, rows.count() // ITEMS)
    # Stored first: the driver merges the rows of every task of a sorted limit that it collects.
    sample = stored(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v"), "sample").toPandas()["v"]
    rotations = {}
    for dims in {len(v) for v in sample}:
        rotations[dims] = fit_rotation(np.floor(256.0 * np.stack([np.asarray(v, np.float64) for v in sample if len(v) == dims])))
    columns = "dims int, ids binary, rows binary"
    order = [F.desc("norm"), F.asc("vec_id")]
    dealt = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("vec_id", "v")
    items = stored(dealt.mapInArrow(_blocks(ITEMS), columns), "items")
    longest = rows.orderBy(*order).limit(ITEMS).coalesce(1).select("vec_id", "v").mapInArrow(_blocks(ITEMS), columns)
    queries = rows.filter(is_query).select("vec_id", "v").mapInArrow(_blocks(QUERIES), columns)
    queries = queries.select("dims", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    seeded = queries.join(stored(longest, "longest"), "dims", "left").select("dims", "q_ids", "q_rows", "ids", "rows")
    blocks = stored(seeded.mapInArrow(_with_floors(k), "dims int, q_ids binary, q_rows binary, floors binary"), "queries")
    folder, names = keep_blocks(blocks.withColumn("block", F.sha2("q_ids", 256)), Q_COLUMNS, "query-blocks")
    found = items.mapInArrow(_search(k, rotations, folder, names), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
