"""The ingest job: items in, vector rows out, and its counters.

items (doc_id, item_idx, text, content_type, source) are cleaned, sanitised and
cut into chunks, embedded, and stripped of chunks whose hash occurred before.
Chunks stream through the embedder partition by partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loam.functions import sanitize, text
from loam.operators import chunking, dedup, sections, structured
from loam.plans import models
from loam.sources import tables
from loam.sources.manifest import content_bucket, item_error, split_valid

Embedder = Callable[[list[str]], list[list[float] | None]]


@dataclass(frozen=True)
class Profile:
    name: str = "standard"
    chunker: str = "char"  # char, tokens, none, or one of models.STRUCTURED
    structured: bool = True
    inline_figures: bool = False
    figure_chunks: bool = False
    size: int = 2000
    overlap: float = 100
    max_tokens: int = 512
    policy: str = "split"
    index_name: str = "documents_v1"
    distance_metric: str = "DOT"
    sanitize_mode: str = "on"
    batch: int = 32


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in for a model: hashed words, unit length."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 32, retries: int = 2, max_tokens: int = 512) -> DataFrame:
    """Adds ``embedding``; null where the embedder skipped a text or a batch failed
    after ``retries`` further tries. Limits, waits and halving are those of ``models.called``."""
    return models.embed_texts(chunks, embedder, max_tokens=max_tokens, batch=batch, retries=retries).drop("n_parts", "failed_batches")


def prepared(items: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """The valid items, cleaned and sanitised, with ``route``, the chunker that each goes to."""
    good, _ = split_valid(items)
    safe = sanitize.sanitize(text.nonempty(good, text.cleaned(F.col("text"))), mode=profile.sanitize_mode)
    return models.routed(safe.withColumn("text", F.col("sanitized")).drop("sanitized", "redactions"), profile.chunker, profile.structured)


def plain_chunks(items: DataFrame, profile: Profile) -> DataFrame:
    """doc_id, content_type, source, seq, text: items cut as the profile's plain chunker does, or
    by characters. A document's chunks are numbered by running sums of its items' counts."""
    name = profile.chunker if profile.chunker in models.CHUNKERS else "char"
    cut = models.chunker_of(name, size=profile.size, overlap=profile.overlap, max_tokens=profile.max_tokens)(F.col("text"))
    parts = F.filter(F.flatten(F.transform(cut, lambda c: chunking.apply_limit(c, profile.max_tokens, profile.policy))), lambda t: t != "")
    rows = items.select("doc_id", "item_idx", "content_type", "source", parts.alias("parts"))
    before = Window.partitionBy("doc_id").orderBy("item_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0)))
    flat = rows.select("doc_id", "content_type", "source", "before", F.posexplode_outer("parts").alias("part", "text")).where("text is not null")
    return flat.select("doc_id", "content_type", "source", (F.col("before") + F.col("part") + 1).cast("int").alias("seq"), "text")


def structured_chunks(items: DataFrame, profile: Profile) -> DataFrame:
    """As ``plain_chunks``, by the profile's chunker of structured files. The chunks of a document
    have its first source; a first line that they all share stays with the first alone."""
    if profile.chunker == "toc_section_docx":
        cut = sections.chunk_sections(items, profile.max_tokens, inline=profile.inline_figures, figure_chunks=profile.figure_chunks)
    elif profile.chunker == "structured_docx":
        cut = structured.chunk_docx(items, profile.max_tokens)
    else:
        cut = structured.chunk_pdf(items, profile.max_tokens)
    cut = cut.select("doc_id", "chunk_seq", "text")
    if "docx" in profile.chunker:
        cut = chunking.strip_title(cut)
    of = items.groupBy("doc_id").agg(F.min_by(F.struct("content_type", "source"), "item_idx").alias("of"))
    return cut.where(F.trim("text") != "").join(of, "doc_id").select("doc_id", "of.content_type", "of.source", F.col("chunk_seq").cast("int").alias("seq"), "text")


def named_chunks(chunks: DataFrame, profile: Profile) -> DataFrame:
    """Chunks (doc_id, content_type, source, text, chunk_seq) with id, hash and the index they are for."""
    named = chunks.select("doc_id", "chunk_seq", "content_type", "source", "text", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), "chunk_seq").alias("chunk_id"))
    return named.withColumn("hash_norm", text.hash_norm(F.col("text"))).withColumn("profile", F.lit(profile.name)).withColumn("index_name", F.lit(profile.index_name)).withColumn("distance_metric", F.lit(profile.distance_metric))


def chunk_items(items: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """doc_id, chunk_id, chunk_seq, text, content_type, source and hash_norm.

    Under a structured chunker the items of its content types go to it and the others to
    characters: items are read, cleaned and sanitised once, into a table by route, and each
    branch reads its own folder. In a document structured chunks are numbered first.
    """
    ready = prepared(items, profile)
    if profile.chunker not in models.STRUCTURED or not profile.structured:
        return named_chunks(plain_chunks(ready, profile).withColumnRenamed("seq", "chunk_seq"), profile)
    ready = tables.written(ready, "ingest-items", "route")
    first = structured_chunks(ready.where(F.col("route") == profile.chunker), profile)
    rest = plain_chunks(ready.where(F.col("route") != profile.chunker), profile)
    both = first.withColumn("branch", F.lit(0)).unionByName(rest.withColumn("branch", F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy("branch", "seq")
    return named_chunks(both.withColumn("chunk_seq", F.row_number().over(order)), profile)


def ingest(items: DataFrame, profile: Profile = Profile(), embedder: Embedder | None = None) -> DataFrame:
    """Vector rows, the first chunk of each hash; chunks without a vector go."""
    fresh = dedup.first_of_each(chunk_items(items, profile), "hash_norm", ["doc_id", "chunk_seq"])
    return embed(fresh, embedder or hashing_embedder(), profile.batch, max_tokens=profile.max_tokens).where("embedding is not null")


def _kinds() -> dict:
    """Chunks of each kind of file, as expressions that a write can carry."""
    kind = F.coalesce(content_bucket(F.col("content_type")), F.lit("other"))
    return {k: F.count_if(kind == k).alias(k) for k in ("pdf", "pptx", "xlsx", "html", "docx", "txt", "other")}


def _metrics(observed: Observation) -> dict:
    """What was observed; of a table that is known to be empty nothing was."""
    try:
        return observed.get
    except Py4JJavaError:
        return {}


@dataclass(frozen=True)
class Job:
    """What a run of the ingest job left: the table of vector rows, and one row of counters."""

    rows: DataFrame
    counters: DataFrame


def run_job(items: DataFrame, profile: Profile = Profile(), embedder: Embedder | None = None) -> Job:
    """The ingest job, each step evaluated once: items are counted as they are read, chunks as
    they are written, vector rows as they are written. The counters ride on the writes.

    counters: items, errors, documents (that have a chunk), chunks, their numbers by kind of
    file, inserted, skipped (chunks of a hash that occurred before, and those without a vector).
    """
    read, cut, kept = Observation("items"), Observation("chunks"), Observation("vectors")
    seen = items.observe(read, F.count(F.lit(1)).alias("items"), F.count(item_error(items.columns)).alias("errors"))
    named = chunk_items(seen, profile)
    counted = named.observe(cut, F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_seq") == 1).alias("documents"), *_kinds().values())
    chunks = tables.written(counted, "ingest-chunks")
    fresh = dedup.first_of_each(chunks, "hash_norm", ["doc_id", "chunk_seq"])
    vectors = embed(fresh, embedder or hashing_embedder(), profile.batch, max_tokens=profile.max_tokens).where("embedding is not null")
    rows = tables.written(vectors.observe(kept, F.count(F.lit(1)).alias("inserted")), "ingest-vectors")
    tables.dropped(chunks)
    found = {k: int(v) for o in (read, cut, kept) for k, v in _metrics(o).items()}
    found = {k: found.get(k, 0) for k in ("items", "errors", "documents", "chunks", *_kinds(), "inserted")}
    found["skipped"] = found["chunks"] - found["inserted"]
    order = ["items", "errors", "documents", "chunks", *_kinds(), "inserted", "skipped"]
    return Job(rows, items.sparkSession.createDataFrame([tuple(found[k] for k in order)], ", ".join(f"{k} long" for k in order)))


def summary(items: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, errors, chunks, inserted, skipped."""
    _, errors = split_valid(items)
    counts = [items.agg(F.countDistinct("doc_id").alias("docs")), errors.agg(F.count("*").alias("errors")), chunks.agg(F.count("*").alias("chunks")), rows.agg(F.count("*").alias("inserted"))]
    out = counts[0]
    for c in counts[1:]:  # single rows
        out = out.crossJoin(F.broadcast(c))
    return out.withColumn("skipped", F.col("chunks") - F.col("inserted"))


def chunks_by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce(content_bucket(F.col("content_type")), F.lit("other")).alias("content_type")).agg(F.count("*").alias("chunks"))
