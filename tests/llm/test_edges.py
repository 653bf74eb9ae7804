"""Odd rows through every stage and operator: nulls, empty and very long texts, ties,
repeated rows, empty tables, and columns whose names clash with internal ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import bpe, decontaminate, maxent, merkle, near_sets, ranker, sharding, simhash, substring, token_store
from loam.llm.common import new_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash map<string,int>, row string, _hash string, node int, start string, range int, place int, uid string, spans int"
LONG = "x" * 200_000 + " " * 300_000 + "word " * 60_000


def rows():
    texts = [(1, ""), (2, None), (3, "a b c " * 60), (3, "a b c " * 60), (3, "another text of one id"), (4, "x"), (5, LONG), (6, "tie tie"), (7, "tie tie"), (None, "no id here"), (None, None)]
    return [(d, t, "en", "s", 1, {"k": 1}, "r", "h", 0, "s", 0, 0, "u", 0) for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:4]], ids=[n for n, _ in corpus_pipeline.STAGES[1:4]])
def test_stages_keep_columns_and_rows_without_an_id(spark, docs, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    found = out.select("doc_id", "text", "text_hash").collect()
    assert sorted(str(r.text) for r in found if r.doc_id is None) == ["None", "no id here"]
    assert {3, 4, 5, 6} <= {r.doc_id for r in found} and all(r.text_hash == {"k": 1} for r in found)
    assert any(r.text == "another text of one id" for r in found)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_last_stage_has_all_rows(spark, docs):
    out = corpus_pipeline.encoded(spark, docs, SF)
    assert out.count() == len(rows()) and out.where("doc_id is null").count() == 2


def test_operators(spark, docs, tokenizer):
    named = len([1 for r in rows() if r[0] is not None])
    assert substring.remove_repeats(docs).count() == named
    assert bpe.encode_documents(docs, tokenizer).count() == named
    assert simhash.near_duplicates(docs).count() == named
    assert merkle.with_next(docs).count() == named
    assert sharding.shard_documents(docs).count() == named
    assert maxent.score_documents(docs).count() == named
    items = spark.createDataFrame([(1, "a b c a b c a b c a b c a b c"), (2, None), (None, "x")], "item_id long, text string")
    assert decontaminate.contamination(docs, items).count() == named
    assert {r.doc_id for r in decontaminate.contamination(docs, items).where("contaminated").collect()} == {3}
    assert ranker.score_documents(docs, None).count() == named
    path = new_path(spark, "edges")
    token_store.write_token_store(docs, path, tokenizer)
    assert token_store.read_digests(spark, path).count() == named
    groups = near_sets.similar_groups(docs)
    assert groups.count() == named and {r.group_id for r in groups.where(F.col("doc_id").isin(6, 7)).collect()} == {6}
    assert {r.group_id for r in groups.where(F.col("doc_id").isin(1, 2)).collect()} == {1}
