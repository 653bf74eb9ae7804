import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from loam.llm import queries, ranker

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op10_pairwise_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    held = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in rows]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1 for x in rows.values())
    out = [(x.predicted, q) for x, q in held if x.held_out]
    assert sum(p == q for p, q in out) / len(out) > 0.9
    good = [x.score for x, q in held if x.held_out and q]
    bad = [x.score for x, q in held if x.held_out and not q]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, "", "x"), (2, None, "y"), (3, "Some words.", "z"), (3, "Some words.", "z"), (None, "t", "t")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert ranker.train(docs, labels) is None
    assert [r.score for r in ranker.score_documents(docs, None).collect()] == [0.5] * 4
    both = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    many = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "fine words here").otherwise("BAD!! !!").alias("text"))
    model = ranker.train(many, both)
    scores = {r.doc_id: r.score for r in ranker.score_documents(many, model).collect()}
    assert all((s >= 0.3) == (d % 2 == 1) for d, s in scores.items())
    assert len(ranker.score_documents(docs, model).collect()) == 4
    assert ranker.score_documents(docs.limit(0), model).count() == 0


def labelled(n, seed=3, dims=6):
    """Rows of features (the last one: how much they count) and labels that two of them tell."""
    r = np.random.default_rng(seed)
    x = np.c_[r.normal(size=(n, dims)), r.uniform(0.5, 1, n)]
    return x, (x[:, 0] - 0.5 * x[:, 1] + 0.3 * r.normal(size=n) > 0).astype(int)


def plain_loss(strength, label):
    """The mean logistic loss of all pairs of a preferred and another row."""
    pairs = [(g, b) for g, y in zip(strength, label) if y for b, z in zip(strength, label) if not z]
    return sum(math.log1p(math.exp(min(50, b - g))) for g, b in pairs) / len(pairs)


def test_weights_minimise_the_loss_of_pairs():
    x, label = labelled(60)
    model = ranker.fit(x, label, share0=0.4)
    z = [[(row[k] - model.centre[k]) * model.scale[k] * row[-1] for k in range(x.shape[1] - 1)] for row in x]
    good, bad = [v for v, y in zip(z, label) if y], [v for v, y in zip(z, label) if not y]
    weights = [0.0] * len(z[0])
    for _ in range(300):  # plain descent over all pairs, with the model's penalty
        gradient = [1e-3 * w for w in weights]
        for g in good:
            for b in bad:
                d = [p - q for p, q in zip(g, b)]
                miss = 1 / (1 + math.exp(min(50, sum(w * v for w, v in zip(weights, d)))))
                for k, v in enumerate(d):
                    gradient[k] -= miss * v / (len(good) * len(bad))
        weights = [w - 1.0 * g for w, g in zip(weights, gradient)]
    best = plain_loss([sum(w * v for w, v in zip(weights, row)) for row in z], label)
    assert plain_loss(model.strength(x).tolist(), label) <= best + 0.03


def test_threshold_and_scores_by_hand():
    x, label = labelled(40, seed=5)
    for share0 in (0.2, 0.5, 0.7):
        model = ranker.fit(x, label, share0)
        strength = sorted(zip(model.strength(x).tolist(), label))
        n0, n1, below = int((label == 0).sum()), int((label == 1).sum()), 0.0
        at = 0
        for at, (_, y) in enumerate(strength):  # each label weighs as it does among all labels
            below += (1 - share0) / n1 if y else share0 / n0
            if below >= share0 - 1e-12:
                break
        at = min(at, len(strength) - 2)
        assert math.isclose(model.threshold, (strength[at][0] + strength[at + 1][0]) / 2)
        for row, score in zip(x, model.score(x)):
            s = sum(w * (row[k] - model.centre[k]) * model.scale[k] * row[-1] for k, w in enumerate(model.weights))
            assert math.isclose(score, 1 / (1 + math.exp(-(model.steepness * (s - model.threshold) + math.log(0.3 / 0.7)))), rel_tol=1e-9)
    assert ranker.fit(x, np.ones(40, int), 0.5) is None


def test_repeats_of_an_id_count_once(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "BAD!! !!").otherwise(F.concat(F.lit("fine words here "), "id")).alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"))
    once = ranker.train(docs, labels)
    again = ranker.train(docs.union(docs).union(docs.where("doc_id % 2 = 0")), labels)
    assert np.array_equal(once.weights, again.weights) and once.threshold == again.threshold


def test_every_labelled_document_counts(spark, monkeypatch):
    """9,000 and more documents of a label, over several blocks: as one fit of them all."""
    docs = spark.range(12000).select(F.col("id").alias("doc_id"), F.when(F.hash("id") % 4 == 0, F.concat(F.lit("BAD!! "), F.hash("id"))).otherwise(F.concat(F.lit("some fine words here "), "id")).alias("text"))
    labels = docs.select("doc_id", ((F.hash("doc_id") % 4 != 0) & (F.xxhash64("doc_id") % 10 != 0)).cast("int").alias("quality"))
    model = ranker.train(docs, labels)
    rows = docs.join(labels, "doc_id").where(ranker.training_row(F.col("doc_id"))).orderBy("doc_id").collect()
    x, y = np.stack([ranker.features(r.text) for r in rows]), np.array([r.quality for r in rows])
    assert (y == 1).sum() > 6000 and np.allclose(model.centre, x[:, :-1].mean(axis=0), atol=1e-12)
    whole = ranker.fit(x, y, (y == 0).mean())
    assert np.allclose(model.weights, whole.weights, atol=1e-5) and abs(model.threshold - whole.threshold) < 1e-4
    strength = np.sort(model.strength(x))
    at = (y == 0).sum() - 1
    assert abs(model.threshold - strength[at : at + 2].mean()) < 1e-12
    monkeypatch.setattr(ranker, "BLOCK", 100)  # so many blocks that groups are joined first
    again = ranker.train(docs, labels)
    assert np.allclose(again.weights, model.weights, atol=1e-5)
