"""Ports to models: embedding with limits and retries, answers with a fallback, a vector
store, and the choice of a chunker.

A port is a function on a batch that the caller gives; Spark runs it in the tasks.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.slices import given_back, sliced
from loam.functions.text import strip_ws
from loam.operators import chunking, retrieval

Embedder = Callable[[list[str]], list[list[float] | None]]
Generator = Callable[[list[str]], list[str | None]]


class RateLimited(Exception):
    """A service asks to wait; ``seconds`` where it says how long."""

    def __init__(self, seconds: float | None = None):
        super().__init__("rate limited")
        self.seconds = seconds


class Unavailable(Exception):
    """A service failed in a way that may pass."""


# Tries after the first, and bounds of a wait in seconds.
RETRIES, LONGEST = 2, 8.0


def waiting(attempt: int, asked: float | None = None, draw: Callable[[], float] = random.random) -> float:
    """Seconds before the next try: as asked, else doubling, up to a bound, with jitter."""
    if asked is not None:
        return asked
    return min(LONGEST, 2.0**attempt) * (0.5 + draw() / 2)


def called(embedder: Embedder, texts: list[str], batch: int, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[list[list[float] | None], int]:
    """The vectors of some texts, and how many batches failed for good.

    A batch that is told to wait goes again; told again, it goes in halves. Other
    errors than the two kinds above are errors of the batch and not tried again.
    """
    out: list[list[float] | None] = [None] * len(texts)
    failed = 0
    todo = [(k, min(k + batch, len(texts))) for k in range(0, len(texts), batch)]
    while todo:
        a, b = todo.pop(0)
        limited = 0
        for attempt in range(retries + 1):
            try:
                out[a:b] = embedder(texts[a:b])
                break
            except RateLimited as e:
                limited += 1
                if limited > 1 and b - a > 1:
                    middle = (a + b) // 2
                    todo[:0] = [(a, middle), (middle, b)]
                    break
                asked = e.seconds
            except Unavailable:
                asked = None
            except Exception:  # noqa: BLE001  whatever a service raises fails this batch alone
                failed += 1
                break
            if attempt == retries:
                failed += 1
            else:
                sleep(waiting(attempt, asked))
    return out, failed


def parts_within(text: str, limit: int) -> list[str]:
    """Parts of up to ``limit`` estimated tokens (four characters each), cut at spaces
    where there are some."""
    most, out = 4 * limit, []
    while len(text) > most:
        at = text.rfind(" ", 1, most + 1)
        at = at if at > 0 else most
        out.append(text[:at])
        text = text[at:].lstrip(" ")
    return out + [text] if text or not out else out


def pooled(vectors: list[list[float] | None]) -> list[float] | None:
    """The mean of the vectors there are."""
    held = [v for v in vectors if v is not None]
    return np.mean(np.array(held, np.float64), axis=0).tolist() if held else None


def embed_texts(rows: DataFrame, embedder: Embedder, text: str = "text", max_tokens: int = 512, batch: int = 32, per_minute: float = 0, retries: int = RETRIES) -> DataFrame:
    """Adds ``embedding``, ``n_parts`` and ``failed_batches`` (of the rows' group, on its first row).

    Texts over the limit are embedded in parts whose vectors are averaged; empty texts
    are not sent. ``per_minute``: calls that all tasks together may make.
    """
    # as many tasks call at once as there are cores, or partitions where those are fewer
    at_once = min(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()) if per_minute else 1
    share = per_minute / max(1, at_once)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<double>, n_parts int, failed_batches int"

    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paced = embedder
        if share:

            def paced(texts: list[str]) -> list[list[float] | None]:
                time.sleep(60 / share)
                return embedder(texts)

        for group in (part for batch in batches for part in sliced(batch)):
            parts = [parts_within(t, max_tokens) if isinstance(t, str) and t.strip() else [] for t in group.column(at).to_pylist()]
            owner = [k for k, p in enumerate(parts) for _ in p]
            vectors, failed = called(paced, [x for p in parts for x in p], batch, retries)
            own: list[list] = [[] for _ in parts]
            for k, v in zip(owner, vectors):
                own[k].append(v)
            found = [pa.array([pooled(v) for v in own], pa.list_(pa.float64())), pa.array([len(p) for p in parts], pa.int32()), pa.array([failed if k == 0 else 0 for k in range(len(parts))], pa.int32())]
            yield pa.RecordBatch.from_arrays([*group.columns, *found], names=[*group.schema.names, "embedding", "n_parts", "failed_batches"])
        given_back()

    return rows.mapInArrow(run, schema)


def embed_counters(rows: DataFrame) -> DataFrame:
    """prepared, embedded, skipped, failed_batches of rows that ``embed_texts`` gave."""
    has = F.col("embedding").isNotNull()
    return rows.agg(F.count("*").alias("prepared"), F.count_if(has).alias("embedded"), F.count_if(~has).alias("skipped"), F.coalesce(F.sum("failed_batches"), F.lit(0)).alias("failed_batches"))


def embed_queries(queries: DataFrame, embedder: Embedder, text: str = "question") -> DataFrame:
    """Queries with their vectors; one that gets none is left out, and finds nothing."""
    return embed_texts(queries, embedder, text).where("embedding is not null").drop("n_parts", "failed_batches")


def generated(rows: DataFrame, primary: Generator, fallback: Generator | None = None, prompt: str = "prompt") -> DataFrame:
    """Adds ``answer``, stripped, '' where there is none, and ``answered_by``.

    The fallback is asked where the first model's answer is empty, and there alone.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", answer string, answered_by string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame[prompt].tolist()
            answers = [(a or "").strip() for a in primary(prompts)]
            by = ["primary" if a else None for a in answers]
            empty = [k for k, a in enumerate(answers) if not a]
            if fallback is not None and empty:
                for k, a in zip(empty, fallback([prompts[k] for k in empty])):
                    answers[k] = (a or "").strip()
                    by[k] = "fallback" if answers[k] else None
            yield frame.assign(answer=answers, answered_by=by)

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class VectorStore:
    """A table of vectors that can be searched by text."""

    rows: DataFrame
    embedder: Embedder
    kind: str = "dot_product"
    id_col: str = "vec_id"
    view: str | None = None

    def similarity_search_with_score(self, queries: DataFrame, k: int = 4) -> DataFrame:
        """query_id, rank, raw_score and the found rows; ``queries``: query_id, question."""
        found = retrieval.top_k(self.rows, embed_queries(queries, self.embedder), k, self.kind, self.id_col)
        out = found.join(self.rows, self.id_col)
        return out.withColumn("target_view", F.lit(self.view)) if self.view else out


Chunker = Callable[[Column], Column]
#: Chunkers of plain text by name: functions from a text to an array of chunks.
CHUNKERS: dict[str, Callable[..., Chunker]] = {
    "char": lambda size=2000, overlap=100, **_: lambda c: chunking.chunk_chars(c, size, int(overlap)),
    "tokens": lambda max_tokens=512, overlap=0.0, **_: lambda c: chunking.chunk_tokens(c, max_tokens, overlap),
    "none": lambda **_: lambda c: F.array(strip_ws(c)),
}
# Chunkers of structured files, and the content types that they are for.
STRUCTURED = {"structured_docx": ("wordprocessingml", "docx"), "toc_section_docx": ("wordprocessingml", "docx"), "structured_pdf": ("pdf",)}


def chunker_of(name: str, **options) -> Chunker:
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name}")
    return CHUNKERS[name](**options)


def routed(items: DataFrame, chunker: str, structured: bool = True) -> DataFrame:
    """Adds ``route``: a structured chunker for items of its content type, for the
    others the plain one, characters where the profile names a structured one."""
    if chunker in STRUCTURED and structured:
        kind = F.lower(F.coalesce("content_type", F.lit("")))
        fits = F.lit(False)
        for part in STRUCTURED[chunker]:
            fits = fits | kind.contains(part)
        return items.withColumn("route", F.when(fits, chunker).otherwise("char"))
    if chunker in STRUCTURED:
        return items.withColumn("route", F.lit("char"))
    chunker_of(chunker)
    return items.withColumn("route", F.lit(chunker))
