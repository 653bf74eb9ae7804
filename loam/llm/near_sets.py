"""Groups of documents whose sets of word shingles are alike, for the pipeline.

Two sets link where their Jaccard similarity reaches a threshold. Equal sets are one
node. No step makes all pairs of a group:

1. Counts. Chunks of documents send their different shingles, as packed arrays, to
   buckets of hashes; each bucket counts in how many sets a shingle is and answers every
   chunk. A shingle that is in a chunk many times travels once, so a very frequent one
   never piles up.
2. Candidates. In the order of rising counts, two sets of the similarity share one of
   their first ``n - ceil(similarity * n) + 1`` shingles. Shingles of one set alone come
   first and meet nobody, so a set of which over a fifth is its own has no partner and
   leaves. The others are joined on those first shingles, each to the least set that has
   the same one: a star, not pairs. What stars connect is a candidate component. Every
   link lies within one, whatever the sizes.
3. Tiles. A candidate component is a tile; a large one is several, by size of set. Inside
   a tile, and between two tiles whose sizes allow the similarity, 128-bit SimHash
   fingerprints meet in blocks in order of population counts, by numpy exclusive-or and
   bit counts; blocks whose counts differ beyond the radius are skipped. Pairs within the
   radius that are not connected yet are held against the exact similarity of their sets,
   which the tile has at hand. A tile hands on a spanning forest of its links; two tiles
   only the links between what is still apart.

Fingerprints count each different shingle once. Sets at the similarity lie 19 of 128
bits apart in the mean; the radius of 40 is five standard deviations above. Sets of at
most ``FEW`` shingles skip the fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema, _batch
from loam.llm.common import freed, keyed_rows, materialize, release, small, texts_with_hash
from loam.llm.components import connected_components
from loam.llm.simhash import _lane, fingerprint
from loam.llm.words import Hasher, as_bytes, word_hashes

RADIUS, FEW = 40, 25
#: Bytes and documents of a chunk; shingles of a bucket, on average.
CHUNK_BYTES, CHUNK_DOCS, BUCKET = 500_000, 60_000, 1 << 19
#: Sets and shingles of a tile; rows of a block within it.
TILE_SETS, TILE_SHINGLES, BLOCK = 4096, 1 << 21, 256


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The different hashes, in order, of the ``k``-word shingles of some texts.

    A text of fewer words, but not none, has its whole sequence for a shingle.
    """
    flat, counts = word_hashes(texts, lower=True)
    h = Hasher(flat, lanes=1)
    at = np.arange(max(0, len(flat) - k + 1))
    every = h.spans(at, at + k, 0)
    out, begin = [], 0
    for n in counts.tolist():
        if n >= k:
            own = np.sort(every[begin : begin + n - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(h.spans(np.array([begin]), np.array([begin + n]), 0) if n else np.zeros(0, np.uint64))
        begin += n
    return out


def _chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Some rows at a time, with their sets; ``text`` is a column of the batches."""
    for batch in batches:
        n = batch.num_rows
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
        first = 0
        while first < n:
            before = size[first - 1] if first else 0
            last = min(n, first + CHUNK_DOCS, max(first + 1, int(np.searchsorted(size, before + CHUNK_BYTES, side="right"))))
            part = batch.slice(first, last - first)
            yield part, _sets(as_bytes(part.column("text")), k)
            first = last


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that few are copied to Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _name(h: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    import xxhash

    c0, c1 = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist()
    return c0, c1


def named_sets(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, c0, c1 (the set's name) and n, its number of shingles."""
    schema = "doc_id long, text_hash long, c0 long, c1 long, n long"
    arrow = _arrow_schema(texts, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _chunks(batches, words):
            names = np.array([_name(h) for h in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(h) for h in sets], pa.int64())], schema=arrow)

    return texts.mapInArrow(freed(run), schema)


_REQUEST = "bucket int, phase int, chunk long, keys binary, counts binary, docs binary"
_ANSWER = "chunk long, bucket int, keys binary, counts binary, docs binary, classes binary"


def _requests(texts: DataFrame, words: int, buckets: int) -> DataFrame:
    """Each chunk's shingles by bucket: in phase 0 the different ones and in how many of
    its sets each is, in phase 1 in which; in phase 2 the names and sizes of its sets.

    A set that a task has seen already is not sent again.
    """
    arrow = _arrow_schema(texts, _REQUEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, seen = TaskContext.get().partitionId(), 0, set()
        for _, sets in _chunks(batches, words):
            fresh, names = [], []
            for h in sets:
                if len(h) and (c0 := _name(h)[0]) not in seen:
                    seen.add(c0)
                    fresh.append(h)
                    names.append(c0)
            if not fresh:
                continue
            chunk, number = task << 32 | number, number + 1
            sizes = np.array([len(h) for h in fresh])
            flat = np.concatenate(fresh)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            docs = np.repeat(np.arange(len(fresh), dtype="<u2"), sizes)[order]
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            counts = np.diff(np.append(first, len(flat))).astype("<u2")
            bucket = ((flat[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            keys = (flat[first] & np.uint64(0xFFFFFFFF)).astype("<u4")
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            key_at, doc_at = np.append(edge, len(keys)).tolist(), np.append(first[edge], len(flat)).tolist()
            rows = [(chunk % buckets, 2, chunk, np.array(names, "<i8").tobytes(), sizes.astype("<u4").tobytes(), b"")]
            for i, b in enumerate(bucket[edge].tolist()):
                k, d = slice(key_at[i], key_at[i + 1]), slice(doc_at[i], doc_at[i + 1])
                rows.append((b, 0, chunk, keys[k].tobytes(), counts[k].tobytes(), b""))
                rows.append((b, 1, chunk, b"", b"", docs[d].tobytes()))
            yield _batch(rows, arrow)

    return texts.select("text").mapInArrow(freed(run), _REQUEST)


def _answers(requests: DataFrame) -> DataFrame:
    """For each chunk and bucket the shingles that other sets have too, with a class that
    grows with the number of sets. A task holds the different shingles of one bucket."""
    arrow = _arrow_schema(requests, _ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, pieces, at, classes = None, [], {}, None
        for batch in _slices(batches, 64):
            rows = []
            for b, phase, chunk, keys, counts, docs in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    bucket, pieces, at, classes = b, [], {}, None
                if phase == 2:
                    rows.append((chunk, -1, keys, counts, b"", b""))
                    continue
                if phase == 0:
                    pieces.append((chunk, np.frombuffer(keys, "<u4"), np.frombuffer(counts, "<u2")))
                    continue
                if classes is None:
                    _, own = np.unique(np.concatenate([k for _, k, _ in pieces]), return_inverse=True)
                    total = np.bincount(own, np.concatenate([c for _, _, c in pieces]))
                    # 0: in one set alone
                    classes = np.minimum(255, np.ceil(4 * np.log2(total))).astype(np.uint8)[own]
                    end = 0
                    for held, k, c in pieces:
                        at[held] = (end, k, c)
                        end += len(k)
                start, k, c = at[chunk]
                own = classes[start : start + len(k)]
                both = own > 0
                if both.any():
                    held = np.frombuffer(docs, "<u2")[np.repeat(both, c)]
                    rows.append((chunk, b, k[both].tobytes(), c[both].tobytes(), held.tobytes(), own[both].tobytes()))
            if rows:
                yield _batch(rows, arrow)

    return requests.repartition("bucket").sortWithinPartitions("bucket", "phase").mapInArrow(freed(run), _ANSWER)


def _first_shared(answers: DataFrame, similarity: float) -> DataFrame:
    """key, c0: for every set that may have a partner, its first shared shingles in the
    order of counts."""
    schema = "key long, c0 long"
    arrow = _arrow_schema(answers, schema)

    def one(table: pa.Table) -> pa.Table:
        names = sizes = None
        keys, docs, classes = [], [], []
        for b, k, c, d, x in zip(*(table.column(i).to_pylist() for i in range(1, 6))):
            if b < 0:
                names, sizes = np.frombuffer(k, "<i8"), np.frombuffer(c, "<u4").astype(np.int64)
                continue
            c = np.frombuffer(c, "<u2")
            keys.append(np.repeat(np.frombuffer(k, "<u4").astype(np.int64) | b << 32, c))
            classes.append(np.repeat(np.frombuffer(x, np.uint8), c))
            docs.append(np.frombuffer(d, "<u2"))
        if not keys:
            return pa.Table.from_batches([], schema=arrow)
        key, own, doc = np.concatenate(keys), np.concatenate(classes), np.concatenate(docs).astype(np.int64)
        shared = np.bincount(doc, minlength=len(sizes))
        need = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1 - (sizes - shared)
        use = need[doc] > 0
        key, own, doc = key[use], own[use], doc[use]
        order = np.lexsort((key, own, doc))
        key, doc = key[order], doc[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        use = rank < need[doc]
        return pa.table([pa.array(key[use]), pa.array(names[doc[use]])], schema=arrow)

    return answers.groupBy("chunk").applyInArrow(one, schema)


def candidate_components(texts: DataFrame, words: int, similarity: float, shingles: int) -> DataFrame:
    """node (c0 of a set), component: sets that are not here link with no other."""
    buckets = max(1, -(-shingles // BUCKET))
    keys = materialize(_first_shared(_answers(_requests(texts, words, buckets)), similarity), "first-shared")
    hubs = keys.groupBy("key").agg(F.min("c0").alias("hub"), F.max("c0").alias("top")).where("hub < top").select("key", "hub")
    links = materialize(keys.join(hubs, "key").where("c0 <> hub").select(F.col("c0").alias("a"), F.col("hub").alias("b")).distinct(), "candidate-links")
    release(keys)
    found = connected_components(links)
    release(links)
    return found


def blocks(first: np.ndarray, second: np.ndarray, radius: int, height: int = BLOCK) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, lo, hi): rows a to b of the first tile meet rows lo to hi of the second.

    Both are population counts in rising order; what differs beyond the radius is left
    out, since counts cannot differ by more than the distance.
    """
    for a in range(0, len(first), height):
        b = min(len(first), a + height)
        lo, hi = np.searchsorted(second, first[a] - radius), np.searchsorted(second, first[b - 1] + radius, side="right")
        if lo < hi:
            yield a, b, int(lo), int(hi)


class Tile:
    """Sets (node, label, two lanes of fingerprint, hashes) in order of population counts."""

    def __init__(self, node: np.ndarray, label: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]):
        ones = np.bitwise_count(prints).sum(axis=1).astype(np.int64)
        order = np.argsort(ones, kind="stable")
        self.ones, self.node, self.label, self.prints = ones[order], node[order], label[order], prints[order]
        self.sets = [sets[i] for i in order]
        self.size = np.array([len(h) for h in self.sets], np.int64)

    def few(self) -> np.ndarray:
        return np.flatnonzero(self.size <= FEW)


def links_of(a: Tile, b: Tile | None, similarity: float, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """Nodes of links within a tile, or between two, that connect what is apart.

    Sets of one label count as connected. Exact, but for pairs beyond the radius.
    """
    other = a if b is None else b
    names, labels = np.unique(np.concatenate([a.label, other.label]), return_inverse=True)
    if len(names) < 2:
        return [], []
    left, right = labels[: len(a.label)], labels[len(a.label) :]
    parent = np.arange(len(names))
    start = np.cumsum(other.size) - other.size
    values, own = np.unique(np.concatenate(other.sets), return_inverse=True)
    marked = np.zeros(len(values) + 1, bool)
    u_out, v_out = [], []

    def tested(u: int, near: np.ndarray) -> None:
        """Holds rows ``near`` of the other tile against row ``u``, some at a time."""
        nonlocal parent
        near = near[parent[right[near]] != parent[left[u]]]
        near = near[np.minimum(other.size[near], a.size[u]) >= similarity * np.maximum(other.size[near], a.size[u]) - 1e-9]
        if not len(near):
            return
        at = np.searchsorted(values, a.sets[u])
        at = at[values[np.minimum(at, len(values) - 1)] == a.sets[u]] if len(values) else at
        marked[at] = True
        while len(near):
            part, near = near[:128], near[128:]
            n = other.size[part]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) + np.repeat(start[part] - (ends - n), n)
            both = np.add.reduceat(marked[own[place]].astype(np.int64), ends - n)
            for v in part[both * (1 + similarity) >= similarity * (n + a.size[u]) - 1e-9]:
                x, y = parent[left[u]], parent[right[v]]
                if x != y:
                    parent[parent == max(x, y)] = min(x, y)
                    u_out.append(int(a.node[u]))
                    v_out.append(int(other.node[v]))
            near = near[parent[right[near]] != parent[left[u]]]
        marked[at] = False

    for s, e, lo, hi in blocks(a.ones, other.ones, radius):
        distance = np.zeros((e - s, hi - lo), np.uint8)
        for lane in range(a.prints.shape[1]):
            distance += np.bitwise_count(a.prints[s:e, lane, None] ^ other.prints[None, lo:hi, lane])
        near = distance <= radius
        for u in np.flatnonzero(near.any(axis=1)):
            tested(s + int(u), lo + np.flatnonzero(near[u]))
    for u in a.few():
        tested(int(u), np.arange(len(other.node)))
    if b is not None:
        # rows of the first tile that meet a small set of the second
        few = other.few()
        if len(few):
            for u in np.flatnonzero((a.size > FEW) & (a.size * similarity <= FEW)):
                tested(int(u), few)
    return u_out, v_out


_MEMBER = "node long, label long, f0 long, f1 long, hashes binary"


def _tile_links(rows: DataFrame, keys: list[str], words: int, similarity: float) -> DataFrame:
    """Links (a, b) of the tiles, or pairs of tiles, that ``keys`` name; ``side`` is 0 or 1."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [*keys, "side"]}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", {_MEMBER}"
    arrow, out = _arrow_schema(rows, schema), _arrow_schema(rows, "a long, b long")
    kept = [*kinds, "node", "label"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _chunks(batches, words):
            prints = np.array([[fingerprint(h), fingerprint(_lane(h, 1))] for h in found], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([h.tobytes() for h in found], pa.binary())], schema=arrow)

    def group(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            tiles = []
            for side in (0, 1):
                # equal rows of the input repeat a node
                part = list({r[1]: r for r in rows if r[0] == side}.values())
                if part:
                    _, node, label, f0, f1, h = zip(*part)
                    tiles.append(Tile(np.array(node), np.array(label), np.array([f0, f1], np.int64).T.copy().view(np.uint64), [np.frombuffer(x, np.uint64) for x in h]))
            u, v = links_of(tiles[0], tiles[1] if len(tiles) > 1 else None, similarity) if cross is None or len(tiles) == 2 else ([], [])
            if u:
                yield _batch(list(zip(u, v)), out)

    cross = True if "other" in keys else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in _slices(batches, 256):
            columns = [c.to_pylist() for c in batch.columns]
            for k in range(batch.num_rows):
                key = tuple(columns[i][k] for i in range(len(keys)))
                if key != now:
                    yield from group(held)
                    now, held = key, []
                held.append(tuple(columns[i][k] for i in range(len(keys), len(columns))))
        yield from group(held)

    return rows.select(*kept, "text").mapInArrow(freed(sets), schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(freed(run), "a long, b long")


def similar_sets(texts: DataFrame, named: DataFrame, words: int, similarity: float, tile_sets: int = TILE_SETS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """c0, c1, group: sets that links connect; sets of no link have no row.

    ``named`` is the written table of ``named_sets``; ``group`` names the group.
    """
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = candidate_components(texts, words, similarity, total)
    different = named.groupBy("c0", "c1").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n").alias("n"))
    nodes = different.join(found.withColumnRenamed("node", "c0"), "c0").select("c0", "c1", "at.doc_id", "at.text_hash", "n", "component")
    # sets of a size band and the next may link, others cannot
    band = F.floor(F.log("n") / F.lit(-math.log(similarity)) - F.lit(1e-9)).cast("int")
    nodes = materialize(nodes.withColumn("band", band).withColumn("node", F.monotonically_increasing_id()), "nodes")
    tiles = F.ceil(F.greatest(F.count("*") / tile_sets, F.sum("n") / tile_shingles)).cast("int")
    large = nodes.groupBy("component").agg(tiles.alias("tiles")).where("tiles > 1").select("component")
    per_band = nodes.join(large, "component").groupBy("component", "band").agg(tiles.alias("tiles"))
    layout = per_band.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "tiles"))).alias("tiles"))
    layout = materialize(layout, "layout")
    split = F.col("tiles").isNotNull()
    own = F.pmod(F.xxhash64("node"), F.element_at("tiles", F.col("band"))).cast("int")
    placed = nodes.join(small(layout), "component", "left").select("component", "node", "doc_id", "text_hash", "tiles", F.when(split, F.col("band")).otherwise(0).alias("band"), F.when(split, own).otherwise(0).alias("part"))
    placed = materialize(placed, "placed")

    def with_texts(rows: DataFrame) -> DataFrame:
        return texts.join(small(rows), ["doc_id", "text_hash"])

    single = with_texts(placed.select("component", "band", "part", "node", F.col("node").alias("label"), F.lit(0).alias("side"), "doc_id", "text_hash"))
    links = materialize(_tile_links(single, ["component", "band", "part"], words, similarity), "tile-links")
    labels = connected_components(links)
    wide = placed.where("tiles is not null").join(labels, "node", "left").withColumn("label", F.coalesce(labels["component"], "node")).drop(labels["component"])
    wide = materialize(wide, "wide")
    if not wide.isEmpty():
        # components of several tiles that are not one group yet
        apart = wide.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("component")
        near = F.flatten(F.transform(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda q: F.transform(F.filter(F.sequence(F.lit(0), F.coalesce(F.try_element_at("tiles", q), F.lit(0))), lambda y: y < F.coalesce(F.try_element_at("tiles", q), F.lit(0))), lambda y: F.struct(q.alias("band"), y.cast("int").alias("part")))))
        here = F.struct("band", "part")
        pairs = wide.join(apart, "component").withColumn("at", here).withColumn("partner", F.explode(near)).where("at <> partner")
        pairs = pairs.select("component", F.least("at", "partner").alias("low"), F.greatest("at", "partner").alias("other"), "node", "label", F.when(F.col("at") < F.col("partner"), 0).otherwise(1).alias("side"), "doc_id", "text_hash")
        pairs = materialize(pairs.select("component", F.col("low.band").alias("band"), F.col("low.part").alias("part"), F.col("other.band").alias("other"), F.col("other.part").alias("other_part"), "node", "label", "side", "doc_id", "text_hash"), "tile-pairs")
        more = materialize(_tile_links(with_texts(pairs), ["component", "band", "part", "other", "other_part"], words, similarity), "cross-links")
        labels = connected_components(links.union(more))
        release(pairs)
    out = materialize(nodes.join(labels.select("node", F.col("component").alias("group")), "node").select("c0", "c1", "group"), "groups")
    release(nodes, layout, placed, wide, links)
    return out


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, **tiles: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash) of the row that stands for its group, one for each group; and
    the (doc_id, text_hash) that several rows have.

    The least doc_id stands for a group, of its texts the one of least hash. Rows of
    one id whose texts are unlike are in groups of their own. Texts without words are
    alike. Rows without an id are left out.
    """
    texts = texts_with_hash(docs)
    named = materialize(named_sets(texts, words), "sets")
    groups = similar_sets(texts, named, words, similarity, **tiles)
    grouped = named.join(groups, ["c0", "c1"], "left")
    key = F.when(F.col("group").isNull(), F.struct(F.col("c0"), F.col("c1"))).otherwise(F.struct(F.col("group").alias("c0"), F.lit(None).cast("long").alias("c1")))
    first = grouped.groupBy(key.alias("k")).agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select("at.doc_id", "at.text_hash")
    first = materialize(first, "representatives")
    repeated = materialize(named.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeated")
    release(named, groups)
    return first, repeated


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, **tiles: int) -> DataFrame:
    """doc_id, text_hash, group_id: the least doc_id of each row's group."""
    texts = texts_with_hash(docs)
    named = materialize(named_sets(texts, words), "sets")
    groups = similar_sets(texts, named, words, similarity, **tiles)
    grouped = named.join(groups, ["c0", "c1"], "left").select("doc_id", "text_hash", F.col("group").alias("g0"), F.when(F.col("group").isNull(), F.col("c0")).alias("g1"), F.when(F.col("group").isNull(), F.col("c1")).alias("g2"))
    key = F.struct("g0", "g1", "g2")
    least = grouped.groupBy(key.alias("k")).agg(F.min("doc_id").alias("group_id"))
    return grouped.withColumn("k", key).join(least, "k").select("doc_id", "text_hash", "group_id")


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, **tiles: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their groups.

    Of rows with one id and one text the first stays, in the order of their JSON; rows
    without an id stay.
    """
    first, repeated = representatives(docs, words, similarity, **tiles)
    kept = keyed_rows(docs.where("doc_id is not null")).join(small(first), ["doc_id", "text_hash"], "left_semi")
    if not repeated.isEmpty():
        key = ["doc_id", "text_hash"]
        again = kept.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(repeated, key, "left_anti").unionByName(again)
    return kept.select("row.*").union(docs.where("doc_id is null"))
