"""The answer job: a table of questions in, a table of answer records out.

Models are ports (functions on a batch). Each is asked once a question that needs it: the
embedder for every question, the primary model where the gates passed, the fallback where the
gates failed, nothing was found, or the primary found nothing in its context. What a model
said is written before anything reads it, so a lost executor costs no second call beyond
its running tasks'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.text import strip_ws
from loam.operators import retrieval, vector_index
from loam.operators.retrieval import RetrievalConfig
from loam.plans import models
from loam.sources import tables


@dataclass(frozen=True)
class Corpus:
    """``chunks``: chunk_id, doc_id, source, text, chunk_type, block_type, embedding. With an index
    (over chunk_id) its ``probes`` closest cells are searched, else all rows."""

    chunks: DataFrame
    index: vector_index.VectorIndex | None = None
    probes: int = 8

    def closest(self, queries: DataFrame, cfg: RetrievalConfig) -> DataFrame:
        if self.index is not None:
            return vector_index.search(self.index, queries, cfg.fanout, self.probes)
        return retrieval.top_k(self.chunks, queries, cfg.fanout, cfg.distance, "chunk_id")


def answer_questions(questions: DataFrame, corpus: Corpus, embedder: models.Embedder, primary: models.Generator, fallback: models.Generator, cfg: RetrievalConfig = RetrievalConfig(), system: str = "Answer from the context.") -> DataFrame:
    """query_id, question, answer, mode, sources_used, decision_explain, used_chunks: one row for
    each question (query_id, question). A question without a vector, or that finds nothing, has
    a fallback answer and null explanations; blank answers of both models are ''."""
    asked = tables.written(models.embed_queries(questions.select("query_id", "question"), embedder), "answer-queries")
    short = asked.select("query_id", retrieval.is_short(F.col("question"), cfg).alias("short"))
    found = corpus.closest(asked, cfg).withColumn("sim", retrieval.similarity(F.col("raw_score"), cfg)).join(short, "query_id")
    scored = tables.written(found, "answer-scored")
    decided = retrieval.decide(scored, cfg)
    kept = retrieval.adaptive_filter(scored, decided, cfg).join(corpus.chunks.drop("embedding"), "chunk_id")
    kept = kept.where(~retrieval.excluded(F.col("chunk_type"), F.col("block_type"), cfg))
    candidates = tables.written(kept.select("query_id", "chunk_id", "doc_id", "source", "text", "sim", "raw_score", "pos"), "answer-candidates")
    chosen = tables.written(retrieval.select_and_pack(candidates, cfg), "answer-chosen")
    gated = tables.written(retrieval.gates(decided, chosen, cfg), "answer-gates")
    used = chosen.join(candidates.select("query_id", "chunk_id", "source", "text", "sim"), ["query_id", "chunk_id"])

    passed = gated.where("gate_failed is null and decision_mode <> 'fallback'").select("query_id")
    ready = questions.select("query_id", "question").join(passed, "query_id", "left_semi")
    first = models.generated(retrieval.prompts(used, ready, system), primary).select("query_id", F.col("answer").alias("primary"))
    first = tables.written(first, "answer-primary")
    usable = first.where((strip_ws(F.col("primary")) != "") & retrieval.no_context_rule(F.col("primary")).isNull()).select("query_id")
    rest = questions.select("query_id", F.coalesce("question", F.lit("")).alias("prompt")).join(usable, "query_id", "left_anti")
    second = tables.written(models.generated(rest, fallback).select("query_id", F.col("answer").alias("fallback")), "answer-fallback")
    replies = questions.select("query_id").join(first, "query_id", "left").join(second, "query_id", "left")
    records = retrieval.answers(gated, questions.select("query_id", "question"), replies, used)
    # questions that found nothing have no row among the gates
    none = questions.select("query_id", "question").join(gated.select("query_id"), "query_id", "left_anti").join(second, "query_id", "left")
    none = none.select("query_id", "question", F.coalesce("fallback", F.lit("")).alias("answer"), F.lit("fallback").alias("mode"), F.lit("none").alias("sources_used"))
    out = tables.written(records.unionByName(none, allowMissingColumns=True), "answers")
    tables.dropped(asked, scored, candidates, chosen, gated, first, second)
    return out
