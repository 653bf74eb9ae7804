"""Batch retrieval: exact top-k, likeness, decisions, diversity and packing.

A batch of questions is a DataFrame (query_id, question, embedding); the corpus a
DataFrame of chunks with embeddings. All per-question work is keyed by query_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loam.functions.scalars import overlaid
from loam.functions.text import alphabetic_tokens, strip_ws


@dataclass(frozen=True)
class RetrievalConfig:
    # fixed values: the service's defaults
    top_k: int = 25
    distance: str = "dot_product"
    score_kind: str = "similarity"
    score_mode: str = "normalized"
    docs_normalized: bool = True
    low: float = 0.25
    high: float = 0.55
    raw_dot_low: float = -0.50
    raw_dot_high: float = -0.20
    raw_cosine_low: float = 0.25
    raw_cosine_high: float = 0.55
    short_tokens: int = 3
    short_low: float = 0.20
    short_high: float = 0.45
    max_bytes: int = 8000
    max_chunks: int = 6
    gate_similarity: float = 0.5
    gate_chunks: int = 1
    gate_bytes: int = 100
    excluded_types: tuple[str, ...] = ("figure",)
    mmr_lambda: float = 0.30
    per_doc_cap: int = 6
    max_keep: int = 12

    @property
    def fanout(self) -> int:
        return max(self.top_k, 4 * self.top_k)


#: Queries that travel to the corpus at once: 4096 of 1,000 dimensions are 32 MB.
QUERY_BLOCK = 4096
#: Rows of the corpus that a task multiplies with a block at a time.
SLICE = 512


def distance(a: Column, b: Column, kind: str = "dot_product") -> Column:
    """Distances, smaller is closer, as an expression; ``top_k`` has the fast path."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    if "dot" in kind:
        return -dot(a, b)
    if "cos" in kind:
        return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def top_k(corpus: DataFrame, queries: DataFrame, k: int, kind: str = "dot_product", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, the corpus row's id, raw_score, rank: each query's k closest rows.

    Queries go to the corpus in blocks of a fixed number, so what is broadcast is
    bounded; each task of the corpus scan multiplies matrices and keeps its own k
    closest rows a query; only these are shuffled, by query. Rows or queries
    without a vector, or of another dimension than the first query, are left out.
    Ties: the smaller id.
    """
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = q.count()
    blocks = -(-n // QUERY_BLOCK)
    if blocks <= 1:
        parts = [q]
    else:  # the count is known: a hash spreads the queries over blocks of about half the bound
        parts = [q.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)) == b) for b in range(2 * blocks)]
    kept = [_closest(corpus, part, k, kind, id_col, vector) for part in parts]
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    w = Window.partitionBy("query_id").orderBy("raw_score", id_col)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _closest(corpus: DataFrame, queries: DataFrame, k: int, kind: str, id_col: str, vector: str) -> DataFrame:
    held = queries.collect()  # one block, of bounded size
    ids = [r["query_id"] for r in held]
    dims = len(held[0]["embedding"]) if held else 0
    use = [i for i, r in enumerate(held) if len(r["embedding"]) == dims]
    matrix = np.array([held[i]["embedding"] for i in use], np.float64).reshape(len(use), dims)
    ids = [ids[i] for i in use]
    shipped = corpus.sparkSession.sparkContext.broadcast((ids, matrix))
    id_type = corpus.schema[id_col].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, {id_col} {id_type}, raw_score double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shipped.value
        best_d = np.full((len(ids), 0), np.inf)
        best_i = np.empty((len(ids), 0), object)
        qn = np.linalg.norm(queries, axis=1)
        for batch in batches:
            # some hundred rows at a time: what a slice needs is bounded, whatever the batch
            for at in range(0, batch.num_rows if len(ids) else 0, SLICE):
                part = batch.slice(at, SLICE)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dims)
                dot = queries @ x.T
                if "dot" in kind:
                    d = -dot
                elif "cos" in kind:
                    d = 1 - dot / np.maximum(np.outer(qn, np.linalg.norm(x, axis=1)), 1e-300)
                else:
                    d = np.sqrt(np.maximum(qn[:, None] ** 2 + (x**2).sum(axis=1)[None] - 2 * dot, 0))
                names = np.array(part.column(0).to_pylist(), object)
                best_d = np.concatenate([best_d, d], axis=1)
                best_i = np.concatenate([best_i, np.broadcast_to(names, d.shape)], axis=1)
                if best_d.shape[1] > k:
                    order = np.argsort(best_d, axis=1, kind="stable")
                    cut = np.take_along_axis(best_d, order[:, k - 1 : k], 1)
                    # ties at the k-th distance: the smaller ids
                    for q in np.flatnonzero((best_d <= cut).sum(axis=1) > k):
                        near = np.flatnonzero(best_d[q] <= cut[q])
                        order[q, : len(near)] = sorted(near, key=lambda i: (best_d[q, i], best_i[q, i]))
                    order = order[:, :k]
                    best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
        rows = [(ids[q], i, d) for q in range(len(ids)) for i, d in zip(best_i[q], best_d[q]) if np.isfinite(d)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    src = corpus.where(F.size(vector) == dims).select(id_col, vector)
    return src.mapInArrow(run, schema)


def similarity(raw: Column, cfg: RetrievalConfig = RetrievalConfig()) -> Column:
    """Raw scores as likeness from 0 to 1."""
    if "dot" in cfg.distance and cfg.docs_normalized:
        value = (1.0 - raw) / 2.0
    elif "cos" in cfg.distance and cfg.score_kind == "similarity":
        value = (raw + 1.0) / 2.0
    elif "cos" in cfg.distance:
        value = 1.0 - F.least(F.greatest(raw / 2.0, F.lit(0.0)), F.lit(1.0))
    else:
        value = 1.0 / (1.0 + F.abs(raw))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def is_short(question: Column, cfg: RetrievalConfig = RetrievalConfig()) -> Column:
    return F.size(alphabetic_tokens(question)) <= cfg.short_tokens


def decide(scored: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """One row a query of candidates (query_id, short, raw_score, sim): the counts,
    extremes, 90th percentile, adaptive threshold, thresholds and mode."""
    per = scored.groupBy("query_id").agg(F.count("*").alias("candidates"), F.max("sim").alias("sim_max"), F.min("sim").alias("sim_min"), F.min("raw_score").alias("raw_min"), F.max("raw_score").alias("raw_max"), F.percentile("sim", 0.9).alias("p90"), F.bool_or("short").alias("short"))
    adaptive = F.greatest(F.lit(cfg.gate_similarity), F.col("p90") - 0.03)
    per = per.withColumn("t_adapt", F.when(F.col("short"), F.least(F.lit(1.0), adaptive + 0.03)).otherwise(adaptive))
    if cfg.score_mode == "raw":
        # a raw score is a distance: the best is the least, thresholds hold for its negation
        cos = "cos" in cfg.distance
        score, low, high = -F.col("raw_min"), cfg.raw_cosine_low if cos else -cfg.raw_dot_high, cfg.raw_cosine_high if cos else -cfg.raw_dot_low
    else:
        score, low, high = F.col("sim_max"), cfg.low, cfg.high
    low = F.when(F.col("short"), F.lit(cfg.short_low)).otherwise(F.lit(low))
    high = F.when(F.col("short"), F.lit(cfg.short_high)).otherwise(F.lit(high))
    per = per.withColumn("threshold_low", low).withColumn("threshold_high", high)
    mode = F.when(score >= F.col("threshold_high"), "rag").when(score >= F.col("threshold_low"), "hybrid").otherwise("fallback")
    return per.withColumn("decision_mode", mode)


def excluded(chunk_type: Column, block_type: Column, cfg: RetrievalConfig = RetrievalConfig()) -> Column:
    return F.coalesce(F.lower(chunk_type).isin(*cfg.excluded_types), F.lit(False)) | F.coalesce(block_type == "image", F.lit(False))


def adaptive_filter(scored: DataFrame, decided: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Candidates at or over the adaptive threshold; where fewer than a floor pass,
    the floor's number of best ones. Carries ``pos``, the place by likeness."""
    floor = max(6, cfg.max_chunks)
    by_sim = Window.partitionBy("query_id").orderBy(F.desc("sim"), "rank")
    joined = scored.join(decided.select("query_id", "t_adapt"), "query_id")
    joined = joined.withColumn("pos", F.row_number().over(by_sim)).withColumn("passing", F.count_if(F.col("sim") >= F.col("t_adapt")).over(Window.partitionBy("query_id")))
    return joined.where(((F.col("passing") >= floor) & (F.col("sim") >= F.col("t_adapt"))) | ((F.col("passing") < floor) & (F.col("pos") <= floor))).drop("passing")


SELECTED = "query_id {q}, chunk_id {c}, mmr_rank int, mmr_score double, in_context boolean, context_rank int, context_bytes int"


def select_and_pack(candidates: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Greedy choice of likely and diverse chunks, then packing by bytes.

    ``candidates``: query_id, chunk_id, doc_id, text, sim, pos, at most a fan-out a
    query, so a group is small. The first choice is the likeliest; each further one
    has the best of likeness less overlap of words with those chosen, with at most
    ``per_doc_cap`` of a document (null: one group). By likeness, chunks enter the
    context while their bytes fit; one that does not fit is passed over.
    """
    q, c = (candidates.schema[x].dataType.simpleString() for x in ("query_id", "chunk_id"))
    src = candidates.select("query_id", "chunk_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "sim", "pos", F.array_distinct(alphabetic_tokens(F.coalesce("text", F.lit("")))).alias("tokens"), F.octet_length(strip_ws(F.coalesce("text", F.lit("")))).alias("bytes"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable").reset_index(drop=True)
        sets = [frozenset(t) for t in group["tokens"]]
        sim, doc = group["sim"].to_numpy(), group["doc_id"].tolist()
        worst = np.zeros(len(group))
        free = np.ones(len(group), bool)
        used: dict[str, int] = {}
        order: list[tuple[int, float]] = []
        while len(order) < cfg.max_keep:
            open_ = free & np.array([used.get(d, 0) < cfg.per_doc_cap for d in doc])
            if not open_.any():
                break
            score = sim if not order else cfg.mmr_lambda * sim - (1 - cfg.mmr_lambda) * worst
            pick = int(np.argmax(np.where(open_, score, -np.inf)))
            order.append((pick, float(score[pick])))
            free[pick] = False
            used[doc[pick]] = used.get(doc[pick], 0) + 1
            mine = sets[pick]
            if mine:
                worst = np.maximum(worst, [len(mine & s) / len(mine | s) if s else 0.0 for s in sets])
        packed: dict[int, tuple[int, int]] = {}
        total = 0
        for pick in sorted((p for p, _ in order), key=lambda p: (-sim[p], [x for x, _ in order].index(p))):
            size = int(group["bytes"][pick])
            extra = 2 if packed else 0
            if size and total + extra + size <= cfg.max_bytes:
                total += extra + size
                packed[pick] = (len(packed) + 1, size + extra)
                if len(packed) >= cfg.max_chunks:
                    break
        rows = [(group["query_id"][p], group["chunk_id"][p], r, s, p in packed, packed[p][0] if p in packed else None, packed[p][1] if p in packed else 0) for r, (p, s) in enumerate(order, 1)]
        out = pd.DataFrame(rows, columns=["query_id", "chunk_id", "mmr_rank", "mmr_score", "in_context", "context_rank", "context_bytes"])
        return out.astype({"context_rank": "Int32"})

    return src.groupBy("query_id").applyInPandas(run, SELECTED.format(q=q, c=c))


def with_excluded(selected: DataFrame, excluded: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """query_id, chunk_id, place, figure: the chosen chunks in their order, then the
    excluded candidates (query_id, chunk_id, sim, pos) by likeness, ``max_keep`` in all."""
    chosen = selected.select("query_id", "chunk_id", F.lit(False).alias("figure"), F.col("mmr_rank").alias("first"), F.lit(0.0).alias("second"))
    others = excluded.select("query_id", "chunk_id", F.lit(True).alias("figure"), F.col("pos").alias("first"), (-F.col("sim")).alias("second"))
    w = Window.partitionBy("query_id").orderBy("figure", "second", "first")
    both = chosen.unionByName(others).withColumn("place", F.row_number().over(w))
    return both.where(F.col("place") <= cfg.max_keep).select("query_id", "chunk_id", "place", "figure")


def merged_metadata(row: Column, doc: Column, row_id: Column) -> Column:
    """A chunk's metadata (a map, or JSON text) with its document's over it; ``source`` falls
    back to ``doc_id``, ``chunk_id`` to the row's id."""
    both = overlaid(row, doc)
    filled = F.map_filter(
        F.create_map(F.lit("source"), F.coalesce(F.nullif(F.try_element_at(both, F.lit("source")), F.lit("")), F.try_element_at(both, F.lit("doc_id"))), F.lit("chunk_id"), F.coalesce(F.nullif(F.try_element_at(both, F.lit("chunk_id")), F.lit("")), row_id.cast("string"))),
        lambda _, v: v.isNotNull(),
    )
    return overlaid(both, filled)


def with_alias(queries: DataFrame, aliases: dict[str, str], domain: str = "domain") -> DataFrame:
    """Adds ``alias``, the view that a query's domain names; an unknown domain is an error."""
    named = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    found = F.try_element_at(named, F.col(domain))
    return queries.withColumn("alias", F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown domain: "), F.coalesce(F.col(domain), F.lit("null"))))).otherwise(found))


def gates(decided: DataFrame, selected: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Adds kept_n, context_n, context_bytes and gate_failed (null: passed)."""
    per = selected.groupBy("query_id").agg(F.count("*").alias("kept_n"), F.count_if("in_context").alias("context_n"), F.sum("context_bytes").alias("context_bytes"))
    out = decided.join(per, "query_id", "left").fillna(0, ["kept_n", "context_n", "context_bytes"])
    gate = F.when(F.col("sim_max") < cfg.gate_similarity, "min_similarity_gate").when(F.col("context_n") < cfg.gate_chunks, "min_chunks_gate").when(F.col("context_bytes") < cfg.gate_bytes, "min_total_chars_gate")
    return out.withColumn("gate_failed", gate)


def legacy_pack(candidates: DataFrame, max_bytes: int, min_chars: int = 0) -> DataFrame:
    """Packing that stops at the first chunk beyond the budget, one chunk a dedupe
    key: a running sum. ``candidates``: query_id, key, rank, text."""
    first = Window.partitionBy("query_id", "key").orderBy("rank")
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = candidates.where(F.char_length("text") >= min_chars).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return kept.withColumn("running_bytes", F.sum(F.octet_length("text").cast("long")).over(running)).where(F.col("running_bytes") <= max_bytes)


# The exact token and the phrases that tell an answer without context.
NO_CONTEXT_TOKEN = "NO_CONTEXT"
NO_CONTEXT_PHRASES = (
    r"\bcontext (does not|doesn't) contain\b",
    r"\bno specific information\b",
    r"\bnot contain any information\b",
    r"\bdoes not mention\b",
    r"\bel contexto (no|no\s+provee)\b",
    r"\bno hay información suficiente\b",
    r"\bno se encuentra información\b",
)


def no_context_rule(answer: Column, longest: int = 64) -> Column:
    """The rule by which an answer says that it found nothing, or null."""
    s = strip_ws(answer)
    out = F.when((F.char_length(s) <= longest) & (F.upper(s) == NO_CONTEXT_TOKEN), "exact_token")
    for k, p in enumerate(NO_CONTEXT_PHRASES):
        out = out.when(answer.rlike(f"(?iU){p}"), f"regex_phrases:{k}")
    return out


def confidence(sim: Column, low: Column, high: Column, mode: Column) -> Column:
    """struct<label, ratio>"""
    ratio = F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (sim - low) / (high - low))))
    label = F.when(mode == "fallback", "Low").when(sim.isNull() | low.isNull(), "Unknown").when(high.isNull() | (high <= low), F.when(sim >= low, "High").otherwise("Low")).when(sim >= high, "High").when(sim >= low, "Medium").otherwise("Low")
    return F.struct(label.alias("label"), F.when(mode == "fallback", F.lit(0.0)).otherwise(ratio).alias("ratio"))


def prompts(selected: DataFrame, questions: DataFrame, system: str = "") -> DataFrame:
    """query_id, prompt: the context chunks in order, then the question."""
    chunks = selected.where("in_context").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("context_rank", "text"))), lambda x: strip_ws(x["text"])).alias("parts"))
    body = F.concat(F.lit(f"{system}\n\n[Context]\n"), F.array_join(F.coalesce("parts", F.array().cast("array<string>")), "\n\n"), F.lit("\n\n[Question]\n"), F.col("question"))
    return questions.join(chunks, "query_id", "left").select("query_id", body.alias("prompt"))


def answers(gated: DataFrame, questions: DataFrame, replies: DataFrame, used: DataFrame) -> DataFrame:
    """The answer record: mode, sources_used, decision_explain and used_chunks.

    ``replies``: query_id, primary, fallback (texts of the models). An answer that
    finds nothing in its context, or a gate that failed, ends in fallback mode.
    """
    chunks = used.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("mmr_rank", "chunk_id", "source", F.col("sim").alias("score"), F.substring("text", 1, 320).alias("snippet")))).alias("used_chunks"))
    rows = questions.join(gated, "query_id").join(replies, "query_id", "left").join(chunks, "query_id", "left")
    rule = no_context_rule(F.coalesce("primary", F.lit("")))
    failed = F.col("gate_failed").isNotNull() | (F.col("decision_mode") == "fallback") | rule.isNotNull()
    mode = F.when(failed, "fallback").otherwise("hybrid")
    answer = F.when(failed, F.col("fallback")).otherwise(F.coalesce(F.nullif(strip_ws(F.col("primary")), F.lit("")), F.col("fallback")))
    explain = F.struct("sim_max", "threshold_low", "threshold_high", "p90", "t_adapt", "gate_failed", "decision_mode", rule.alias("no_context_rule"), "kept_n", "context_n", "context_bytes")
    return rows.select("query_id", "question", answer.alias("answer"), mode.alias("mode"), F.when(mode == "hybrid", "partial").otherwise("none").alias("sources_used"), explain.alias("decision_explain"), "used_chunks")


def evidence(used: DataFrame, explain: DataFrame) -> DataFrame:
    """Chunks to show: none for fallback, failed gates or weak queries; else those
    without a score or with one of the low threshold or more."""
    shown = explain.where("mode <> 'fallback' and gate_failed is null and sim_max >= threshold_low").select("query_id", "threshold_low")
    return used.join(shown, "query_id").where("score is null or score >= threshold_low")
