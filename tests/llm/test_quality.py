import math
import zlib

import numpy as np

from strandline.llm import quality

from .helpers import LONG, ODD, documents


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    assert sum(found[i].predicted == truth[i] for i in held) / len(held) > 0.97
    kept = [found[i].predicted for i in held if truth[i] == 1]
    assert sum(kept) / len(kept) > 0.985
    order = sorted(held, key=lambda i: found[i].score)
    bad = sum(1 - truth[i] for i in held)
    below = wins = 0
    for i in order:
        below += truth[i] == 0
        wins += below * (truth[i] == 1)
    assert wins / (bad * (len(held) - bad)) > 0.97


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("quality", (1 - labels.quality).cast("int"))
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    mixed = labels.filter(~held).unionByName(turned.filter(held).select(labels.columns))
    assert quality.fit(docs, mixed) == quality.fit(docs, labels)


def test_odd_rows_and_tables_without_labels(spark):
    docs = documents(spark, clash=("quality", "x", "held_out", "score"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    found = quality.score(docs, model).collect()
    assert len(found) == len(ODD) and all(r.score == 0.5 and r.predicted == 1 for r in found)
    some = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 1), (2, None, 0), (3, 0, 0), (3, 1, 0), (77, 1, 0), (7, 1, 0), (4, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score(docs, quality.fit(docs, some)).collect()
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) and r.predicted == int(r.score >= 0.5) for r in found)
    left = quality.keep_good(docs, quality.fit(docs, some))
    assert left.columns == docs.columns and left.count() == sum(r.predicted for r in found)
    assert quality.score(documents(spark, []), model).collect() == []


def test_features_are_finite_and_of_one_length():
    for t in (None, "", " ", "\n\n", "!", "É", LONG, "a" * 100_000, "| | |", "\x00"):
        x = quality.features(t)
        assert len(x) == quality.FEATURES and all(map(math.isfinite, x))


def newton(diff, ridge):
    """The same minimum from the matrix of all differences and its Hessian."""
    w = np.zeros(diff.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(diff @ w))
        w = w + np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w)), diff.T @ p / len(diff) - ridge * w)
    return w


def test_weights_are_the_minimum_of_the_pairs_loss():
    pick = np.random.default_rng(3)
    z = pick.normal(size=(80, 6))
    z[:, 5] = z[:, 4]
    better, worse = pick.integers(0, 40, 300), pick.integers(40, 80, 300)
    z[:40, 0] += 0.7
    for ridge in (1e-3, 0.1):
        assert np.allclose(quality.rank(z, better, worse, ridge, steps=60), newton(z[better] - z[worse], ridge), atol=1e-6)


def plain_model(docs, labels):
    """The fit by the rule, from rows of (doc_id, text) and (doc_id, quality)."""
    truth = {}
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            truth[i] = min(q, truth.get(i, q))
    own = sorted((i, t) for i, t in docs if i in truth)
    x = np.stack([quality.features(t).astype("<f4") for _, t in own]).astype(float)
    y = np.array([truth[i] for i, _ in own])
    spread = np.maximum(x.std(axis=0), 1e-3)
    s = quality.SURFACE
    spread[s:] = np.maximum(spread[s:], spread[s:].mean()) / quality.GRAMS
    z = (x - x.mean(axis=0)) / spread
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    assert len(good) >= len(bad) > 0
    a = np.repeat(good, quality.PARTNERS)
    w = newton(z[a] - z[np.random.default_rng(7).choice(bad, size=len(a))], 1e-3)
    ranked = sorted(zip(z @ w, y))
    right = [sum(1 - q for _, q in ranked[:k]) + sum(q for _, q in ranked[k:]) for k in range(len(ranked) + 1)]
    k = right.index(max(right))
    cut = (ranked[k - 1][0] + ranked[k][0]) / 2
    return lambda t: 1 / (1 + math.exp(-(float(((quality.features(t) - x.mean(axis=0)) / spread) @ w) - cut)))


def test_the_querys_scores_are_those_of_the_plain_model(spark, sf):
    from strandline.llm import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    score = plain_model(docs, labels)
    found = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    assert len(found) == len(docs)
    for i, t in docs:
        assert abs(found[i].score - score(t)) < 1e-4 and found[i].predicted == int(found[i].score >= 0.5)


def test_without_the_share_of_other_signs_labels_are_told_apart_too():
    import pandas as pd

    sf = "/root/testdata/sf0.1"
    rows = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    x = np.stack([quality.features(t) for t in rows.text])
    x[:, 0] = 0
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id])
    spread = np.maximum(x[~held].std(axis=0), 1e-3)
    spread[quality.SURFACE :] = np.maximum(spread[quality.SURFACE :], spread[quality.SURFACE :].mean()) / quality.GRAMS
    z, y = (x - x[~held].mean(axis=0)) / spread, rows.quality.to_numpy()
    good, bad = np.flatnonzero(~held & (y == 1)), np.flatnonzero(~held & (y == 0))
    a = np.repeat(good, quality.PARTNERS)
    s = z @ quality.rank(z, a, np.random.default_rng(7).choice(bad, size=len(a)), 1e-3)
    cut = np.quantile(s[~held], len(bad) / (len(good) + len(bad)))
    assert np.mean((s[held] >= cut) == y[held]) > 0.99


def test_repeated_ids_in_documents_bound_the_sample(spark):
    docs = [(1, "a good text of words"), (1, "another text"), (1, "another text"), (2, "!!! ### !!!"), (5, "more words here"), (8, "$$$ %%%")]
    d = documents(spark, [(i, t, "en", "a", 1) for i, t in docs])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    assert quality.fit(d.repartition(5), labels) == model
    found = quality.score(d, model).collect()
    assert len(found) == len(docs)
    assert quality.fit(d.dropDuplicates(["doc_id", "text"]), labels) == model
