"""Quality classifier by co-training of two views.

The text view sees words: hashed word frequencies, repetition, variety. The metadata view sees what
describes the document from outside: source, language, length, line layout and the mix of character
classes. Each view learns from labelled documents. Over rounds both score every unlabelled document,
and each gives the other its most confident guesses of each class and each group of sources, so that
rare sources teach as well. Both are then calibrated on labelled documents held out
of their training in turn, and a calibrated combination of their log odds scores all documents.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docproof.llm.support import free_name, release, ship_package
from docproof.llm.textscan import as_bytes, by_size, string_hashes, word_hashes

# Labelled documents that the models are fitted on, taken by the order of a hash.
LABELLED = 8_000
WORD_BUCKETS, NAME_BUCKETS = 512, 32
# A view gives this many guesses of a class and a group of sources (by hash) in a round, out of all unlabelled documents.
ROUNDS, SOURCE_GROUPS, GUESSES, CONFIDENT = 3, 32, 8, 0.98
BLOCK_ROWS = 1024
FOLDS, MOST_ODDS = 3, 8.0
RIDGE = 1e-3
TEXT_STATISTICS, LAYOUT_STATISTICS = 5, 14


def text_view(texts: list[bytes]) -> np.ndarray:
    """Per text hashed word frequencies and statistics of its word sequence."""
    hashes, offsets = word_hashes(texts)
    out = np.zeros((len(texts), WORD_BUCKETS + TEXT_STATISTICS), np.float32)
    buckets = (hashes >> np.uint64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        n = b - a
        if n:
            own = hashes[a:b]
            out[i, :WORD_BUCKETS] = np.sqrt(np.bincount(buckets[a:b], minlength=WORD_BUCKETS) / n)
            again = np.count_nonzero(own[1:] == own[:-1]) / max(1, n - 1)
            variety = len(np.unique(own)) / n
            out[i, WORD_BUCKETS:] = (again, again > 0.05, variety, np.log1p(n) / 10, variety * np.log1p(n) / 10)
    return out


_KIND = np.full(256, 5, np.int8)  # lower, upper, digit, white space, ASCII symbol, everything else
_KIND[list(range(97, 123))] = 0
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4


def metadata_view(texts: list[bytes], langs: list, sources: list, sizes: list) -> np.ndarray:
    """Per document its hashed source and language, length, line layout and character classes."""
    out = np.zeros((len(texts), 2 * NAME_BUCKETS + LAYOUT_STATISTICS), np.float32)
    for at, names in ((0, langs), (NAME_BUCKETS, sources)):
        keys = string_hashes([(n or "").encode() for n in names])
        out[np.arange(len(texts)), at + (keys % np.uint64(NAME_BUCKETS)).astype(np.int64)] = 1
    for i, (text, size) in enumerate(zip(texts, sizes, strict=True)):
        raw = np.frombuffer(text, np.uint8)
        n = max(1, len(raw))
        kinds = _KIND[raw]
        shares = np.bincount(kinds, minlength=6) / n
        symbols = kinds == 4
        doubled = np.count_nonzero(symbols[1:] & (raw[1:] == raw[:-1])) / n
        after_letter = np.count_nonzero(symbols[1:] & (kinds[:-1] < 2)) / n
        lines = text.count(b"\n") + 1
        letters = max(1e-9, shares[0] + shares[1])
        out[i, 2 * NAME_BUCKETS :] = (
            *shares[:5], shares[1] / letters, doubled * 10, doubled > 0.01, after_letter * 10,
            text.count(b" | ") * 10 / n, np.log1p(max(0, size or 0)) / 10, np.log1p(len(raw)) / 10,
            np.log1p(lines) / 10, np.log1p(n / lines) / 10,
        )
    return out


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


@dataclass
class Logistic:
    """Ridge logistic regression over standardized features, classes weighted alike."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, target: np.ndarray, steps: int = 8) -> "Logistic":
        """Newton steps whose sums go over blocks of rows, so that no second copy of the rows is made."""
        n, width = len(rows), rows.shape[1]
        blocks = [slice(at, at + BLOCK_ROWS) for at in range(0, n, BLOCK_ROWS)]
        centre = rows.mean(axis=0, dtype=np.float64)
        scale = np.sqrt(sum(((rows[b] - centre) ** 2).sum(axis=0) for b in blocks) / n) + 1e-3
        share = target.mean()
        importance = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
        weights = np.zeros(width + 1)
        penalty = np.full(width + 1, RIDGE * n)
        penalty[-1] = 1e-9
        for _ in range(steps):
            slope, curve = penalty * weights, np.diag(penalty)
            for b in blocks:
                x = np.hstack([(rows[b] - centre) / scale, np.ones((len(rows[b]), 1))])
                p = _probability(x @ weights)
                slope += x.T @ (importance[b] * (p - target[b]))
                curve += (x * (importance[b] * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x
            weights = weights - np.linalg.solve(curve, slope)
        return cls(centre, scale, weights)

    def odds(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.centre) / self.scale) @ self.weights[:-1] + self.weights[-1]


def calibration(odds: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Slopes (for each column of ``odds``) and offset that turn odds into log odds of being good (Platt)."""
    good, n = target.sum(), len(target)
    goal = np.where(target > 0.5, (good + 1) / (good + 2), 1 / (n - good + 2))
    x = np.column_stack([odds, np.ones(n)])
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = _probability(x @ weights)
        curve = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        weights = weights - np.linalg.solve(curve, x.T @ (p - goal) + 1e-3 * weights)
    weights[:-1] = np.maximum(weights[:-1], 0)
    return weights


def _line(weights: np.ndarray, odds: np.ndarray) -> np.ndarray:
    return np.column_stack([odds]) @ weights[:-1] + weights[-1]


def _joint(text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
    """What the combination looks at: both calibrated views, bounded, and the lower of the two."""
    a, b = np.clip(text, -MOST_ODDS, MOST_ODDS), np.clip(metadata, -MOST_ODDS, MOST_ODDS)
    return np.column_stack([a, b, np.minimum(a, b)])


@dataclass
class QualityModel:
    """Both views, their calibrations and the share of good documents; no views where labels tell nothing."""

    text: Logistic | None
    metadata: Logistic | None
    text_line: np.ndarray | None
    metadata_line: np.ndarray | None
    joint_line: np.ndarray | None
    prior: float

    def scores(self, texts: list[bytes], langs: list, sources: list, sizes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: of the text view, the metadata view, and both."""
        if self.text is None:
            good = np.full(len(texts), self.prior)
            return good, good, good
        a = _line(self.text_line, self.text.odds(text_view(texts)))
        b = _line(self.metadata_line, self.metadata.odds(metadata_view(texts, langs, sources, sizes)))
        return _probability(a), _probability(b), _probability(_line(self.joint_line, _joint(a, b)))


@dataclass
class Examples:
    """Labelled rows of both views, and the guesses that each view was given by the other."""

    views: list[np.ndarray]
    target: np.ndarray
    guessed: list[np.ndarray]
    guesses: list[np.ndarray]

    def tell_nothing(self) -> bool:
        return len(self.target) < 10 or min(self.target.sum(), len(self.target) - self.target.sum()) < FOLDS

    def learn(self, view: int, rows: np.ndarray, classes: np.ndarray) -> None:
        self.guessed[view] = np.vstack([self.guessed[view], rows])
        self.guesses[view] = np.concatenate([self.guesses[view], classes])

    def fitted(self, chosen: np.ndarray | None = None) -> list[Logistic]:
        """A model of each view from the chosen labelled rows and the guesses."""
        own = slice(None) if chosen is None else chosen
        return [
            Logistic.fit(np.vstack([v[own], x]), np.concatenate([self.target[own], y]))
            for v, x, y in zip(self.views, self.guessed, self.guesses, strict=True)
        ]


def calibrated(examples: Examples) -> QualityModel:
    """Both views from all examples, calibrated on labelled rows that are held out in turn."""
    target = examples.target
    if examples.tell_nothing():
        return QualityModel(None, None, None, None, None, float(target.mean()) if len(target) else 1.0)
    odds = np.zeros((2, len(target)))
    folds = np.empty(len(target), int)
    for value in (0, 1):
        own = np.flatnonzero((target > 0.5) == value)
        folds[own] = np.arange(len(own)) % FOLDS
    for fold in range(FOLDS):
        for view, model in enumerate(examples.fitted(folds != fold)):
            odds[view, folds == fold] = model.odds(examples.views[view][folds == fold])
    lines = [calibration(o, target) for o in odds]
    joint = calibration(_joint(*[_line(w, o) for w, o in zip(lines, odds, strict=True)]), target)
    return QualityModel(*examples.fitted(), *lines, joint, float(target.mean()))


def _features():
    import pyarrow as pa

    def run(batches):
        for part in (part for batch in batches for part in by_size(batch, 1)):
            texts = as_bytes(part.column(1))
            others = [part.column(c).to_pylist() for c in (2, 3, 4)]
            blobs = [[r.tobytes() for r in v] for v in (text_view(texts), metadata_view(texts, *others))]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(b, pa.binary()) for b in blobs]], names=["doc_id", "a", "b"])
        release()

    return run


def _confident(models: list[Logistic]):
    """(doc_id, source_group, view, good, odds) for each view that is confident of a document."""
    import pyarrow as pa

    least = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    def run(batches):
        for part in (part for batch in batches for part in by_size(batch, 1)):
            texts = as_bytes(part.column(1))
            others = [part.column(c).to_pylist() for c in (2, 3, 4)]
            for view, rows in enumerate((text_view(texts), metadata_view(texts, *others))):
                odds = models[view].odds(rows)
                sure = np.flatnonzero(np.abs(odds) >= least)
                chosen = part.take(pa.array(sure))
                yield pa.RecordBatch.from_arrays(
                    [chosen.column(0), chosen.column(5), pa.array(np.full(len(sure), view, np.int32)), pa.array(odds[sure] > 0), pa.array(odds[sure])],
                    names=["doc_id", "source_group", "view", "good", "odds"],
                )
        release()

    return run


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"),
        F.pmod(F.xxhash64(F.col("source").cast("string")), F.lit(SOURCE_GROUPS)).cast("int").alias("source_group"),
    )


def _views_of(docs: DataFrame, ids: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """doc_ids in order and the features of a bounded number of documents; of repeated ids one row."""
    # At most LABELLED numbers, or as many as guesses of one round.
    picked = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    rows = _columns(docs).join(picked, "doc_id").mapInArrow(_features(), "doc_id long, a binary, b binary").toArrow()
    found, first = np.unique(rows.column("doc_id").to_numpy(), return_index=True)
    widths = WORD_BUCKETS + TEXT_STATISTICS, 2 * NAME_BUCKETS + LAYOUT_STATISTICS
    views = [
        np.frombuffer(b"".join(rows.column(c).take(first).to_pylist()), np.float32).reshape(-1, width)
        for c, width in zip(("a", "b"), widths, strict=True)
    ]
    return found, views


def _exchange(docs: DataFrame, marks: DataFrame, models: list[Logistic], taken: list[int]) -> dict[int, tuple[int, bool]]:
    """doc_id to (view that guesses, class) of the most confident guesses of this round."""
    spark = docs.sparkSession
    sure = _columns(docs).mapInArrow(_confident(models), "doc_id long, source_group int, view int, good boolean, odds double")
    used = F.broadcast(spark.createDataFrame([(i,) for i in taken], "doc_id long"))
    free = sure.filter("doc_id is not null").join(used, "doc_id", "left_anti").join(marks.select("doc_id"), "doc_id", "left_anti")
    # Equal odds are copies of one text: one of them is enough.
    free = free.groupBy("view", "source_group", "good", "odds").agg(F.min("doc_id").alias("doc_id"))
    order = Window.partitionBy("view", "source_group", "good").orderBy(F.desc(F.abs("odds")), F.xxhash64("doc_id"), "doc_id")
    best = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= GUESSES)
    # At most 2 * 2 * SOURCE_GROUPS * GUESSES rows; a document that both views pick goes by the text.
    return {r["doc_id"]: (r["view"], r["good"]) for r in sorted(best.collect(), key=lambda r: (-r["view"], r["doc_id"]))}


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from the documents' labels (doc_id, quality 0 or 1).

    At most ``LABELLED`` labelled documents are used, the first by a hash of doc_id. Guesses come from
    all documents without a label. Labels without document and null labels are ignored; of several
    labels for a document the lowest counts. With fewer than ten labelled documents, or fewer than
    ``FOLDS`` of a class, every document gets the share of good labels, or 1 if there are none.
    """
    ship_package(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    marks = labels.filter("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    marks = marks.groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("good"))
    chosen = known.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()
    target = {r.doc_id: r.good for r in chosen}
    found, views = _views_of(docs, list(target))
    nobody = [v[:0] for v in views]
    examples = Examples(views, np.array([target[i] for i in found.tolist()]), nobody, [np.empty(0)] * 2)
    if examples.tell_nothing():
        return calibrated(examples)
    taken: list[int] = []
    for _ in range(ROUNDS):
        guesses = _exchange(docs, marks, examples.fitted(), taken)
        if not guesses:
            break
        taken += guesses
        found, views = _views_of(docs, list(guesses))
        for view in (0, 1):
            own = np.array([guesses[i][0] == view for i in found.tolist()], bool)
            classes = np.array([float(guesses[i][1]) for i in found[own].tolist()])
            examples.learn(1 - view, views[1 - view][own], classes)
    return calibrated(examples)


def score_quality(docs: DataFrame, model: QualityModel, column: str) -> DataFrame:
    """Documents with one more column: struct(text, metadata, both) of calibrated probabilities."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    names = ["text", "metadata", "both"]

    @F.arrow_udf("text double, metadata double, both double")
    def quality(text: pa.Array, lang: pa.Array, source: pa.Array, size: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, lang, source, size], names=["text", "lang", "source", "size"])
        found = [np.empty((3, 0))]
        for part in by_size(batch, 0):
            found.append(np.stack(model.scores(as_bytes(part.column(0)), *[part.column(c).to_pylist() for c in (1, 2, 3)])))
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in np.concatenate(found, axis=1)], names=names)

    columns = [F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")]
    return docs.withColumn(column, quality(*columns))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, metadata_score, quality, kept) of every document.

    ``kept`` means that the combined probability of good quality is at least ``threshold``. Null
    texts count as empty, null languages and sources as values of their own, null n_chars as 0.
    Repeated rows and null ids come back as they are, an empty table gives an empty result, other
    columns are ignored.
    """
    own = free_name(docs, "_quality")
    scored = score_quality(docs, fit_quality(docs, labels), own)
    return scored.select(
        "doc_id", F.col(own)["text"].alias("text_score"), F.col(own)["metadata"].alias("metadata_score"),
        F.col(own)["both"].alias("quality"), (F.col(own)["both"] >= threshold).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents of good quality, with their own columns."""
    own = free_name(docs, "_quality")
    scored = score_quality(docs, fit_quality(docs, labels), own)
    return scored.filter(F.col(own)["both"] >= threshold).select(*docs.columns)
