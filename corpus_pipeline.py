"""The corpus pipeline: from raw documents to token ids.

Quality classifier, SimHash near-dedup, substring dedup, benchmark
decontamination, BPE encoding. Each stage reads what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, decontaminate, near_sets, ranker, substring
from loam.llm.common import materialize, small_batches, table

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return ranker.keep_good(docs, ranker.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id."""
    small_batches(spark)
    return near_sets.one_of_each_group(docs, words=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id holds are cut out.

    Rows without an id stay as they are.
    """
    small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring.remove_repeats(docs, window=50, keep=tuple(others))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    columns |= {c: F.col(f"row.`{c}`") for c in others}
    return cut.select(*(columns[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256; rows without an id too."""
    small_batches(spark)
    return bpe.encode_with_digest(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: No SQL states a trained classifier or a byte-pair encoding; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Rows without an id pass the stages that compare
    documents unchanged; the others judge them like any."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
