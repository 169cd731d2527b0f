import numpy as np

from docproof.llm import cotraining
from docproof.llm.cotraining import classify, keep_good


def test_held_out_accuracy(spark):
    """Labels of every third labelled document are hidden from training."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    hidden = labels.filter("doc_id % 3 = 0").select("doc_id", labels.quality.alias("truth"))
    found = classify(docs, labels.filter("doc_id % 3 <> 0")).join(hidden, "doc_id").toPandas()
    good = found.truth == 1
    assert len(found) > 1000
    assert found.kept[good].mean() > 0.99
    assert found.kept[~good].mean() < 0.03
    assert ((found.metadata_score > 0.5) == good).mean() > 0.9
    assert ((found.text_score > 0.5) == good).mean() > 0.8


def test_views_of_odd_texts():
    texts = [b"", b" ", b"one", "é".encode() * 10, b"word " * 200_000]
    for view in (cotraining.text_view(texts), cotraining.metadata_view(texts, [None] * 5, ["a"] * 5, [None, -3, 10**12, 0, 1])):
        assert np.isfinite(view).all() and len(view) == 5


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def test_nulls_few_labels_and_empty_tables(spark):
    docs = rows(spark, [(1, None, None, None, None, "a"), (None, "text", "en", "s", 4, "b"), (1, None, None, None, None, "a"), (2, "more", "en", "s", 4, "")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    found = classify(docs, labels).collect()
    assert len(found) == 4 and {round(r.quality, 6) for r in found} == {0.5}
    assert [r.kept for r in classify(docs, labels.limit(0)).collect()] == [True] * 4
    assert classify(docs.limit(0), labels).count() == 0
    assert keep_good(docs, labels).columns == docs.columns and keep_good(docs, labels).count() == 4


def test_newton_steps_over_blocks_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 7)).astype(np.float32)
    target = (rows[:, 0] + rng.normal(size=500) > 0.3).astype(float)
    x = np.hstack([(rows - rows.mean(axis=0)) / (rows.std(axis=0) + 1e-3), np.ones((500, 1))])
    importance = np.where(target > 0.5, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    penalty = np.array([cotraining.RIDGE * 500] * 7 + [1e-9])
    weights = np.zeros(8)
    for _ in range(8):
        p = 1 / (1 + np.exp(-x @ weights))
        curve = (x * (importance * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        weights = weights - np.linalg.solve(curve, x.T @ (importance * (p - target)) + penalty * weights)
    monkeypatch.setattr(cotraining, "BLOCK_ROWS", 64)
    assert np.allclose(cotraining.Logistic.fit(rows, target).weights, weights, atol=1e-4)


def test_guesses_come_from_every_group_of_sources(spark):
    """The most confident of each view, class and group, as a plain loop over all unlabelled rows picks them."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'good' if rng.random() < i % 7 / 6 else 'bad'}{rng.integers(9)}" for _ in range(30)) for i in range(900)]
    rows_ = [(i, t, "en" if i % 7 > 3 else "xx", "hot" if i % 5 else f"s{i % 40}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows_, *rows_[:50]], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, float(i % 7 > 3)) for i in range(0, 900, 3)], "doc_id long, good double")
    raw = [r[1].encode() for r in rows_]
    views = [cotraining.text_view(raw), cotraining.metadata_view(raw, *[[r[c] for r in rows_] for c in (2, 3, 4)])]
    labelled = np.arange(0, 900, 3)
    models = [cotraining.Logistic.fit(v[labelled], (labelled % 7 > 3).astype(float)) for v in views]
    taken = [1, 2, 4]
    got = cotraining._exchange(docs, marks, models, taken)
    groups = {r.doc_id: r.source_group for r in cotraining._columns(docs).select("doc_id", "source_group").collect()}
    best = {}
    for view, (v, model) in enumerate(zip(views, models)):
        for i, odds in enumerate(model.odds(v)):
            if i % 3 and i not in taken and abs(odds) >= np.log(cotraining.CONFIDENT / (1 - cotraining.CONFIDENT)):
                best.setdefault((view, groups[i], bool(odds > 0)), {}).setdefault(round(abs(odds), 6), []).append(i)
    least = {k: sorted(own)[-cotraining.GUESSES :][0] for k, own in best.items()}
    for i, (view, good) in got.items():
        odds = models[view].odds(views[view][i : i + 1])[0]
        assert bool(odds > 0) == good and round(abs(odds), 6) >= least[view, groups[i], good] - 1e-6
    picked = {(groups[i], good) for i, (_, good) in got.items()}
    assert picked == {(g, good) for _, g, good in best} and len(picked) > 10


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "text " * i, "en", "s", i, "mine") for i in range(1, 9)],
                                 "doc_id long, text string, lang string, source string, n_chars long, _QUALITY string")
    kept = keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == docs.columns and {r._QUALITY for r in kept.collect()} == {"mine"}
