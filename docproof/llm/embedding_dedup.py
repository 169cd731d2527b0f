"""Embedding near duplicates by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves. Each half has its own codebook, and the product
of both codebooks is a grid of cells. A vector visits cells in multi-sequence order, by the sum of
its halves' squared distances to the cell's codewords, until the sum exceeds the nearest cell's by
a margin. The margin is calibrated on the sample: partners at exactly the threshold lie within it
with the target recall. What a cell brings together is verified in double precision.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docproof.llm.components import components
from docproof.llm.support import join_hot, ship_package, stored
from docproof.llm.vectors import is_finite_vector, matrix

# Rows that codebooks and margin are fitted on, taken by the order of a hash of their ids.
SAMPLE = 20_000
TARGET_RECALL = 0.9995
BLOCK = 2048
MOST_WORDS = 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _distances(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ words.T + (words**2).sum(1), 0)


def codebook(rows: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Codewords by k-means from rows spread over the sample."""
    words = rows[np.linspace(0, len(rows) - 1, min(size, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(rows, words).argmin(axis=1)
        for i in range(len(words)):
            own = rows[near == i]
            if len(own):
                words[i] = own.mean(axis=0)
    return words


@dataclass
class MultiIndex:
    """Codebooks of both halves, and how far beyond the nearest cell a vector looks."""

    first: np.ndarray
    second: np.ndarray
    margin: float = 0.0

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _distances(rows[:, :cut], self.first), _distances(rows[:, cut:], self.second)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.halves(rows)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def excess(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How much farther than its nearest cell a given cell is from each vector."""
        a, b = self.halves(rows)
        i, j = np.divmod(cells, len(self.second))
        at = np.arange(len(rows))
        return a[at, i] + b[at, j] - a.min(axis=1) - b.min(axis=1)

    def visits(self, rows: np.ndarray) -> list[np.ndarray]:
        """Per vector the cells in multi-sequence order up to the margin."""
        a, b = self.halves(rows)
        out = []
        for x, y in zip(a, b, strict=True):
            left, right = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
            x, y = x[left] - x[left[0]], y[right] - y[right[0]]
            left, x = left[x <= self.margin], x[x <= self.margin]
            reach = np.searchsorted(y, self.margin - x, side="right")
            cells = np.concatenate([i * len(self.second) + right[:n] for i, n in zip(left, reach, strict=True)])
            sums = np.concatenate([v + y[:n] for v, n in zip(x, reach, strict=True)])
            out.append(cells[np.argsort(sums, kind="stable")])
        return out


def fit(sample: np.ndarray, n_rows: int, threshold: float, recall: float = TARGET_RECALL) -> MultiIndex:
    """Index for vectors of one length; the grid grows with the number of rows."""
    rows, cut = _unit(sample), sample.shape[1] // 2
    size = int(min(MOST_WORDS, max(1, np.sqrt(n_rows / 1024))))
    index = MultiIndex(codebook(rows[:, :cut], size), codebook(rows[:, cut:], size))
    noise = np.random.default_rng(3).normal(size=rows.shape)
    noise -= (noise * rows).sum(1, keepdims=True) * rows
    lengths = np.linalg.norm(noise, axis=1, keepdims=True)
    noise = np.divide(noise, lengths, out=np.zeros_like(noise), where=lengths > 0)
    partners = threshold * rows + np.sqrt(max(0.0, 1 - threshold**2)) * noise
    far = index.excess(rows, index.cells(partners))
    index.margin = float(np.quantile(far, recall)) + 1e-12
    return index


def _place(indexes: dict[int, MultiIndex]):
    """Rows (id, label, dims, v, copies) to rows (label, dims, cell, resident, id, own, copies, v) of all cells visited."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                for start in range(0, part.num_rows, 2048):
                    piece = part.slice(start, 2048)
                    rows = _unit(matrix(piece.column(3)))
                    index = indexes.get(int(dims))
                    own = index.cells(rows) if index else np.zeros(len(rows), np.int64)
                    seen = index.visits(rows) if index else [own[i : i + 1] for i in range(len(rows))]
                    times = np.array([len(s) for s in seen])
                    take = np.repeat(np.arange(len(rows)), times)
                    cells = np.concatenate(seen)
                    flat = pa.array(rows[take].reshape(-1))
                    vectors = pa.ListArray.from_arrays(np.arange(len(take) + 1, dtype=np.int32) * int(dims), flat)
                    columns = [
                        piece.column(1).take(pa.array(take)), pa.array(np.full(len(take), dims, np.int32)), pa.array(cells),
                        pa.array(cells == own[take]), piece.column(0).take(pa.array(take)), pa.array(own[take]),
                        piece.column(4).take(pa.array(take)), vectors,
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns, names=["label", "dims", "cell", "resident", "id", "own", "copies", "v"]
                    )

    return run


def _least(n: int, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest id that it reaches over the links left-right."""
    least = ids.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, left, before[right])
        np.minimum.at(least, right, least[left])
        if (before == least).all():
            return least


def _verify(threshold: float, indexes: dict[int, MultiIndex]):
    """Links in one block of a cell: how many each vector has, and the smallest id it reaches there."""
    import pandas as pd

    def compare(frame):
        here = frame[frame.resident & frame.home]
        guests = frame[frame.guest]
        out = pd.DataFrame({"id": [], "n": [], "least": []}).astype("int64")
        if not len(here) or not len(guests):
            return out
        index, cell = indexes.get(int(frame["dims"].iloc[0])), int(frame["cell"].iloc[0])
        rows, seekers = np.stack(here.v.to_numpy()), np.stack(guests.v.to_numpy())
        ids, others = here.id.to_numpy(), guests.id.to_numpy()
        own = guests.own.to_numpy()
        inside = own == cell
        # Found from both sides: the side with the larger cell counts the pair.
        both = np.zeros((len(guests), len(here)), bool)
        if index is not None:
            for other in np.unique(own[own > cell]):
                back = index.excess(rows, np.full(len(rows), other)) <= index.margin
                both[own == other] = back
        left, right = [], []
        for start in range(0, len(seekers), 256):
            part = slice(start, start + 256)
            linked = seekers[part] @ rows.T >= threshold
            linked &= ~both[part]
            linked &= ~(inside[part, None] & (others[part, None] >= ids))
            g, h = np.nonzero(linked)
            left.append(g + start)
            right.append(h)
        left, right = np.concatenate(left), np.concatenate(right)
        if not len(left):
            return out
        nodes, place = np.unique(np.concatenate((others, ids)), return_inverse=True)
        a, b = place[left], place[len(others) + right]
        n = np.zeros(len(nodes), np.int64)
        np.add.at(n, a, here.copies.to_numpy()[right])
        np.add.at(n, b, guests.copies.to_numpy()[left])
        least = _least(len(nodes), a, b, nodes)
        found = np.flatnonzero(n)
        return pd.DataFrame({"id": nodes[found], "n": n[found], "least": least[found]})

    return compare


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors link if their labels are equal and not null and their cosine is at least ``threshold``.
    n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable,
    kept is true for that vector. Vectors that are null, empty, zero or hold null or non-finite
    components, vectors of different lengths, and null labels link with nothing. Equal vectors of a
    label are one node. Rows that repeat a vec_id are one vector, the smallest of them, and come
    back once; a null vec_id comes back with no links, a null component and kept = true. An empty
    table gives an empty result; other columns are ignored.

    Cells are compared in blocks of residents and visitors, so neither a large cell nor a large group
    of near copies meets in one task, and links are counted where they are found, not written out.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    given = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label")
    )
    ids = given.filter("id is not null").groupBy("id").agg(F.min(F.struct("v", "label")).alias("row")).select("id", "row.v", "row.label")
    good = is_finite_vector(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull()
    marks = stored(
        ids.withColumn("good", F.coalesce(good, F.lit(False))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}),
        "vectors",
    )
    nodes = stored(
        marks.filter("good").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")),
        "nodes",
    )
    sizes = {r.dims: r.n for r in nodes.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    indexes = {}
    for dims, n in sizes.items():
        rows = [np.asarray(v, np.float64) for v in sample if len(v) == dims]
        if dims > 1 and rows:
            indexes[dims] = fit(np.stack(rows), n, threshold)
    placed = nodes.select("id", "label", F.size("v").alias("dims"), "v", "copies").mapInArrow(
        _place(indexes), "label string, dims int, cell long, resident boolean, id long, own long, copies long, v array<double>"
    )
    visits = stored(placed, "visits")
    key = ["label", "dims", "cell"]
    counts = (
        visits.groupBy(*key)
        .agg(F.count_if("resident").alias("homes"), F.count(F.lit(1)).alias("seen"))
        .filter("homes > 0 and seen > 1")
        .select(*key, F.ceil(F.col("homes") / BLOCK).cast("int").alias("home_blocks"), F.ceil(F.col("seen") / BLOCK).cast("int").alias("seen_blocks"))
    )
    sized = join_hot(visits, counts, key, "id")
    home = F.pmod(F.xxhash64("id"), F.col("home_blocks")).cast("int")
    guest = F.pmod(F.xxhash64("id", F.lit(1)), F.col("seen_blocks")).cast("int")
    columns = [*key, "resident", "id", "own", "copies", "v"]
    homes = sized.filter("resident").select(
        *columns, home.alias("home_block"), F.explode(F.sequence(F.lit(0), F.col("seen_blocks") - 1)).alias("seen_block"),
        F.lit(True).alias("home"), F.lit(False).alias("guest"),
    )
    guests = sized.select(
        *columns, F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("home_block"), guest.alias("seen_block"),
        F.lit(False).alias("home"), F.lit(True).alias("guest"),
    )
    found = homes.unionByName(guests).groupBy(*key, "home_block", "seen_block").applyInPandas(
        _verify(threshold, indexes), "id long, n long, least long"
    )
    links = stored(found, "links")
    comps = components(links, "id", "least")
    totals = links.groupBy("id").agg(F.sum("n").alias("n"))
    grouped = (
        nodes.select("label", "h1", "h2", "id", "copies").join(totals, "id", "left").join(comps, "id", "left")
        .select("label", "h1", "h2", F.coalesce("component", "id").alias("component"),
                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    linked = join_hot(marks.filter("good").select("id", "label", "h1", "h2"), grouped, ["label", "h1", "h2"], "id")
    alone = marks.filter("not good").select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    nameless = given.filter("id is null").select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    rows = linked.select("id", "component", "n_links").unionByName(alone).unionByName(nameless)
    return rows.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
