"""Substring dedup on a compacted De Bruijn graph of word windows.

The edges of the graph are the token k-mers, here windows of ``window`` words; an
edge follows another where their windows follow in a text. As in compaction by
minimisers, each window is owned by its anchor, the least hash among the shorter k-mers
in it; a run of neighbouring windows with one anchor is a path of edges, and paths
travel through the joins instead of edges:

1. every text becomes a row for each path: anchor, hash of its words, coordinates, and
   the paths before and after it;
2. anchors that one document alone holds lead nowhere else and are dropped;
3. an anchor under which all paths are the same text does not branch. Two such paths
   are neighbours on a nonbranching path where the one is always followed by the other,
   and that one always preceded by it (degrees are one). Joins compact all of these
   into chains, each path pointing twice as far in every round;
4. paths under a branching anchor are opened, once for each different text, at
   the coordinates of their first source, and first documents found edge by edge;
5. chains, by the path at their head, and opened paths are joined back to their
   occurrences, which gives the spans. A chain's span counts only where its words have
   the checksum of the words at the coordinates of its first source.

Windows under branching anchors are equal where two independent polynomials of 64 bits
over 64-bit word hashes are.

Words are maximal runs of bytes other than ASCII white space. Null and empty
texts have no words. Documents with null doc_id are left out. Rows that repeat an
id are told apart by their texts; equal ones count once and give equal rows. A window
that repeats within one document alone stays, and so does the first document's copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema
from loam.llm.common import freed, materialize, release, text_hash, texts_with_hash
from loam.llm.words import Hasher, as_bytes, word_hashes

#: Edges of a path at most, so that opening one is bounded.
PATH_EDGES = 64
#: Bytes that are hashed together; bounds a task's arrays, not a text's length.
CHUNK_BYTES = 500_000
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _paths(words: np.ndarray, document: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For words of several documents put together: start, edges, anchor, two hashes of
    each path, and the first hash of the paths before and after it in its document (0:
    none); ``document`` numbers each word's document."""
    n = len(words)
    edges = n - window + 1
    if edges <= 0:
        return tuple(np.zeros(0, np.uint64) for _ in range(7))
    k = (window + 1) // 2
    h = Hasher(words)
    at = np.arange(n - k + 1)
    least, width = h.spans(at, at + k, 0), 1
    whole = window - k + 1
    while width * 2 <= whole:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    anchor = np.minimum(least[:edges], least[whole - width : whole - width + edges])
    own = document[:edges] == document[window - 1 :]
    new = np.ones(edges, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:edges] != document[: edges - 1]) | ~own[:-1]
    first = np.flatnonzero(new & own)
    if not len(first):
        return tuple(np.zeros(0, np.uint64) for _ in range(7))
    # a run ends before the next one, or before an edge that crosses documents
    stops = np.flatnonzero(new | ~own)
    after = np.searchsorted(stops, first, side="right")
    last = np.where(after < len(stops), stops[np.minimum(after, len(stops) - 1)], edges)
    long = last - first
    if long.max(initial=0) > PATH_EDGES:
        parts = (long + PATH_EDGES - 1) // PATH_EDGES
        index = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + index * PATH_EDGES
        last = np.minimum(np.repeat(last, parts), begin + PATH_EDGES)
        first, long = begin, last - begin
    end = first + long + window - 1
    h1 = h.spans(first, end, 0)
    before, after = np.zeros_like(h1), np.zeros_like(h1)
    follows = document[first[1:]] == document[first[:-1]]
    before[1:][follows] = h1[:-1][follows]
    after[:-1][follows] = h1[1:][follows]
    return first, long, anchor[first], h1, h.spans(first, end, 1), before, after


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """(ids, text hashes, hashes of words, numbers of words) of some documents at a time."""
    ids, hashes, texts, size = [], [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            for d, h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2))):
                ids.append(d)
                hashes.append(h)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    yield ids, hashes, *word_hashes(texts)
                    ids, hashes, texts, size = [], [], [], 0
    if ids:
        yield ids, hashes, *word_hashes(texts)


PATHS = "doc_id long, text_hash long, start int, edges int, anchor long, h1 long, h2 long, before long, after long"


def paths(docs: DataFrame, window: int) -> DataFrame:
    """A row for each path of each document."""
    arrow = _arrow_schema(docs, PATHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, flat, lengths in _grouped(batches):
            document = np.repeat(np.arange(len(ids)), lengths)
            begin = np.cumsum(lengths) - lengths
            start, edges, *hashed = _paths(flat, document, window)
            start = start.astype(np.int64)
            of = document[start] if len(start) else np.zeros(0, np.int64)
            columns = [np.array(ids, np.int64)[of], np.array(hashes, np.int64)[of], (start - begin[of]).astype(np.int32), edges.astype(np.int32), *(h.view(np.int64) for h in hashed)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return docs.mapInArrow(freed(run), PATHS)


SPAN = "begin int, end int, checksum bigint"


def chains(compact: DataFrame) -> DataFrame:
    """h1, h2, edges, source (of the head), total: the maximal nonbranching paths.

    ``compact``: h1, h2, edges, source, before, after of paths whose anchor does not
    branch; ``before`` and ``after`` are null where occurrences differ, or 0 where there is none.
    Every round doubles how far a path points towards its head, so their number is the
    logarithm of the longest chain's length. A chain has no cycle: a path that begins a
    text has nothing before it.
    """
    node = compact.select("h1", "edges", "before", "after")
    one = node.where("before <> 0").select("h1", F.col("before").alias("up"))
    follows = one.join(node.where("after <> 0").select(F.col("h1").alias("up"), F.col("after").alias("h1")), ["up", "h1"])
    now = materialize(node.select("h1", "edges").join(follows, "h1", "left").select("h1", "edges", F.coalesce("up", "h1").alias("up"), F.col("up").isNotNull().alias("moved")), "chain-links")
    while not now.where("moved").isEmpty():
        further = now.select(F.col("h1").alias("up"), F.col("up").alias("next"))
        moved = now.join(further, "up").select("h1", "edges", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved"))
        before, now = now, materialize(moved, "chain-links")
        release(before)
    total = now.groupBy(F.col("up").alias("h1")).agg(F.sum("edges").cast("int").alias("total"))
    out = materialize(compact.select("h1", "h2", "edges", "source").join(total, "h1"), "chains")
    release(now)
    return out


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, text_hash, spans: the ranges of words of each document that a window
    covers whose words also start in a document with a smaller doc_id. ``checksum``: of the
    words at the source, where a span is a chain's; ``cut`` compares it."""
    texts = texts_with_hash(docs)
    every = materialize(paths(texts, window), "paths")
    held = every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    # equal rows of one document count once
    found = materialize(every.join(held, "anchor").distinct(), "shared-paths")
    release(every)

    key = ["h1", "h2", "edges"]
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    distinct = found.groupBy("anchor", *key).agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("source"), same("before"), same("after"))
    texts_of = distinct.groupBy("anchor").agg(F.count("*").alias("texts"))
    shared = materialize(distinct.join(texts_of, "anchor"), "different-paths")
    heads = chains(shared.where("texts = 1"))
    words = materialize(_at_sources(shared.where("texts > 1"), heads, texts, window), "source-words")
    windows, checks = words.where("edge >= 0"), words.where("edge < 0").select(*key, F.col("w1").alias("checksum"))
    release(shared)

    # a window that one path alone has is first at that path's source
    first = materialize(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first"), "first-windows")
    each = windows.join(first, ["w1", "w2"], "left").withColumn("first", F.coalesce("first", "doc_id"))
    opened = each.groupBy(*key).agg(F.min("first").alias("first"), F.collect_list(F.struct("edge", "first")).alias("opened"))
    whole = heads.join(checks, key).select(*key, F.col("source.doc_id").alias("first"), F.lit(None).cast("array<struct<edge:int,first:bigint>>").alias("opened"), "total", "checksum")
    resolved = materialize(whole.unionByName(opened, allowMissingColumns=True), "resolved-paths")
    release(words, first, heads)

    begin = F.col("start")
    long = F.array(F.struct(begin.alias("begin"), (begin + F.col("total") + F.lit(window - 1)).alias("end"), F.col("checksum")))
    short = F.transform(F.filter("opened", lambda x: x["first"] < F.col("doc_id")), lambda x: F.struct((begin + x["edge"]).alias("begin"), (begin + x["edge"] + F.lit(window)).alias("end"), F.lit(None).cast("long").alias("checksum")))
    hits = found.join(resolved, key).where("first < doc_id").select("doc_id", "text_hash", F.when(F.col("opened").isNull(), long).otherwise(short).alias("ranges"))
    spans = hits.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("ranges")).alias("spans")).where("size(spans) > 0")
    out = materialize(spans, "spans")
    release(found, resolved)
    return out


def _at_sources(branching: DataFrame, heads: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """What the words at the first sources say: w1, w2 (hashes), doc_id and the path's key for
    each edge of a branching path; key and checksum (w1) of the words of each chain, as
    edge -1."""
    place = lambda df, n: df.select("source", "h1", "h2", "edges", n.alias("words"))
    asked = place(branching, F.lit(0)).union(place(heads, F.col("total") + F.lit(window - 1)))
    wanted = asked.groupBy(F.col("source.doc_id").alias("doc_id"), F.col("source.text_hash").alias("text_hash")).agg(F.collect_list(F.struct("source.start", "edges", "h1", "h2", "words")).alias("wanted"))
    # equal rows of one document are one source
    source = texts.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    schema = "w1 long, w2 long, h1 long, h2 long, edges int, edge int, doc_id long"
    arrow = _arrow_schema(texts, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                out: list[list[np.ndarray]] = []
                for d, t, w in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), part.column("wanted")):
                    start, edges, h1, h2, words = (w.values.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                    long = words > 0
                    if long.any():
                        sums = checksums(t.split(), start[long], start[long] + words[long])
                        out.append([sums, np.zeros_like(sums), h1[long], h2[long], edges[long], np.full(len(sums), -1, np.int32), np.full(len(sums), d, np.int64)])
                    if long.all():
                        continue
                    start, edges, h1, h2 = (x[~long] for x in (start, edges, h1, h2))
                    h = Hasher(word_hashes([t])[0])
                    edge = np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
                    at = np.repeat(start, edges) + edge
                    out.append([h.spans(at, at + window, 0).view(np.int64), h.spans(at, at + window, 1).view(np.int64), np.repeat(h1, edges), np.repeat(h2, edges), np.repeat(edges, edges).astype(np.int32), edge.astype(np.int32), np.full(len(at), d, np.int64)])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=arrow)

    return source.select("doc_id", "text", "wanted").mapInArrow(freed(run), schema)


def checksums(words: list[bytes], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of ranges of words, joined by one space."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(b" ".join(words[a:b])) for a, b in zip(begin.tolist(), end.tolist())], np.uint64).view(np.int64)


def cut(text: str, spans: list[dict]) -> tuple[str, int, int]:
    """The text without the words of ``spans``, its number of words, and of those removed.

    Kept words keep the white space after them. A span whose words have not the
    checksum of its source is no repeat.
    """
    raw = text.encode("utf-8", "replace")
    at = np.array([m.span() for m in WORD.finditer(raw)], np.int64).reshape(-1, 2)
    n = len(at)
    sure = [s for s in spans if s["checksum"] is None]
    long = [s for s in spans if s["checksum"] is not None]
    if long:
        found = checksums(raw.split(), *(np.array([s[k] for s in long]) for k in ("begin", "end")))
        sure += [s for s, c in zip(long, found.tolist()) if s["checksum"] == c]
    spans = sure
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, [s["begin"] for s in spans], 1)
    np.add.at(depth, [s["end"] for s in spans], -1)
    gone = np.cumsum(depth[:-1]) > 0
    begin = at[:, 0]
    end = np.append(at[1:, 0], len(raw))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
    kept = [raw[: begin[0]]] if n else [raw]
    kept += [raw[begin[a] : end[b - 1]] for a, b in zip(edge[::2], edge[1::2])]
    return b"".join(kept).decode(), n, int(gone.sum())


def remove_repeats(docs: DataFrame, window: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_hash (of the text before), text, n_words, n_removed, and ``row``,
    a struct of the columns in ``keep``.

    ``text`` is null where it was; a document of which nothing stays keeps an
    empty text, so that every document has its row.
    """
    spans = repeated_spans(docs, window)
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"), row.alias("row"))
    joined = texts.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "text", "spans", "row")
    schema = f"doc_id long, text_hash long, text string, n_words long, n_removed long, row {joined.schema['row'].dataType.simpleString()}"
    arrow = _arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for d, h, t, s in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if t is None:
                        rows.append((d, h, None, 0, 0))
                    elif not s:
                        rows.append((d, h, t, len(t.encode("utf-8", "replace").split()), 0))
                    else:
                        rows.append((d, h, *cut(t, s)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, type=f.type) for x, f in zip(zip(*rows), arrow)), part.column(4).cast(arrow.field("row").type)], schema=arrow)

    out = joined.mapInArrow(freed(run), schema)
    return out if keep else out.drop("row")
