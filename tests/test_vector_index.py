"""The inverted-file index against the exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import retrieval, vector_index
from loam.plans import registry

SF = "/root/testdata/sf0.001"


def corpus(spark, n=400, dims=8, groups=6, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims)) * 4
    rows = [(k, (centres[k % groups] + r.normal(size=dims)).tolist()) for k in range(n)]
    rows += [(n + 1, None), (n + 2, []), (n + 3, [1.0, 2.0])] + [(n + 10 + k, rows[0][1]) for k in range(5)]  # copies tie
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def asked(frame):
    return frame.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.raw_score, 5)) for r in df.collect())


@pytest.mark.parametrize("kind", ["dot_product", "cosine", "euclidean"])
def test_all_probes_are_the_exact_search(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 30)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 5)
    frame = corpus(spark)
    q = asked(frame).where("size(embedding) = 8")
    index = vector_index.build(frame, 6, kind)
    assert index.rows.count() == 405 and index.rows.select("vec_id").distinct().count() == 405
    assert index.sizes.agg(F.sum("n")).first()[0] == 405 and index.sizes.agg(F.max("blocks")).first()[0] > 1
    assert rows(vector_index.search(index, q, 9, 6)) == rows(retrieval.top_k(frame, q, 9, kind))


def test_few_probes_suffice_for_clustered_vectors(spark):
    frame = corpus(spark, 900)
    q = asked(frame).where("size(embedding) = 8")
    index = vector_index.build(frame, 12, "euclidean")
    exact = retrieval.top_k(frame, q, 10, "euclidean")
    probes = vector_index.probes_needed(index, q, exact, 0.95)
    got = vector_index.recall(vector_index.search(index, q, 10, probes), exact).first()
    assert probes < 8 and got.recall >= 0.95 and got.expected == 10 * got.queries


def test_odd_tables(spark):
    frame = corpus(spark, 40)
    none = frame.limit(0)
    index = vector_index.build(none)
    assert vector_index.search(index, asked(frame), 5, 3).count() == 0
    index = vector_index.build(frame, 4)
    assert vector_index.search(index, asked(none), 5, 3).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.0] * 8)], "query_id long, embedding array<double>")
    assert {r.query_id for r in vector_index.search(index, odd, 5, 4).collect()} == {3}
    text_ids = frame.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    found = vector_index.search(vector_index.build(text_ids, 4), asked(frame), 5, 4)
    assert rows(found) == rows(retrieval.top_k(text_ids, asked(frame).where("size(embedding) = 8"), 5))


def test_registered_index_reaches_its_recall(spark):
    got = registry.QUERIES["ivf_recall"](spark, SF).first()
    assert got.recall >= 0.9


def test_exact_search_in_slices(spark, monkeypatch):
    frame = corpus(spark, 300)
    q = asked(frame).where("size(embedding) = 8")
    whole = rows(retrieval.top_k(frame, q, 6))
    monkeypatch.setattr(retrieval, "SLICE", 7)
    assert rows(retrieval.top_k(frame, q, 6)) == whole
    data = {r.vec_id: r.embedding for r in frame.collect() if r.embedding is not None and len(r.embedding) == 8}
    one = random.Random(0).choice([x for x in data if x % 7 == 0])
    want = sorted((-float(np.dot(data[one], v)), k) for k, v in data.items())[:6]
    assert [(s, k) for _, _, k, s in [x for x in whole if x[0] == one]] == [(round(s, 5), k) for s, k in want]
