"""SimHash near-dedup by tiled exact comparison.

A fingerprint has a bit for each bit of its shingles' hashes: 1 where over half of
them have a 1. Equal fingerprints collapse to the least doc_id that has them.
The others are laid out in tiles by population count. Pairs of tiles are compared
whole, in numpy, by exclusive-or and bit counts; two tiles whose population counts
differ beyond the radius are skipped, since counts cannot differ by more than the
distance (``tile_pairs`` counts both kinds).

The tiles lie within buckets. Of ``radius + 2`` blocks of the bits at least two agree
for any two fingerprints within the radius, so each pair that links shares a bucket
for some two blocks; no link is lost. A bucket's rows of like population counts are a
tile, or several where they are many, so one hot bucket spreads over many tasks.

A tile pair reports a spanning forest of its links, never all of them; components of
the links follow in Spark.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema
from loam.llm.common import freed, ids_and_texts, materialize
from loam.llm.components import connected_components

TILE = 8192


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle of the text, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = (end - length)[: 1 - n or None].tolist()
    end = end[n - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin, end)), np.uint64, len(begin))


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit; no hashes: zero."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further hashes for fingerprints of over 64 bits."""
    if lane == 0:
        return hashes
    x = (hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and f0 (64 bits, signed) for every document.

    A null or empty text has fingerprint zero; null doc_ids are left out; rows
    that repeat an id each have their row.
    """
    schema = "doc_id long, f0 long"
    arrow = _arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                prints = np.array([fingerprint(shingle_hashes(t, words)) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], schema=arrow)

    return ids_and_texts(docs).mapInArrow(freed(run), schema)


def forest(u: np.ndarray, v: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The indexes of links u-v that join trees of ``parent``, which it updates."""
    kept = []
    at = np.arange(len(u))
    while len(at):
        a, b = parent[u[at]], parent[v[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            break
        high, first = np.unique(np.maximum(a, b), return_index=True)
        kept.append(at[first])
        parent[high] = np.minimum(a, b)[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _near(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links (rows of ``a``, rows of ``b`` or ``a``) of a few rows of ``a`` at a time."""
    n, same = len(a), b is None
    other = a if same else b
    height = max(1, (1 << 21) // max(1, len(other)))
    for k in range(0, n, height):
        block = a[k : k + height]
        columns = other[k:] if same else other
        i, j = np.nonzero(np.bitwise_count(block[:, None] ^ columns[None]) <= radius)
        if same:
            above = j > i
            i, j = i[above], j[above]
        if len(i):
            yield i + k, j + (k if same else 0)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within tile ``a`` (b: None) or between two tiles.

    Blocks of rows are reduced to their forests one after the other, so few links are
    ever held.
    """
    shift = 0 if b is None else len(a)
    parent = np.arange(shift + len(a if b is None else b))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for u, v in _near(a, b, radius):
        kept = forest(u, v + shift, parent)
        out.append((u[kept], v[kept]))
    u, v = (np.concatenate(x) for x in zip(*out))
    return u, v


#: A pair of tiles of one bucket: bins of population counts and numbers within them.
PAIR = ["t", "key", "bin", "part", "other_bin", "other_part"]


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of each pair of tiles; rows of the first have ``side`` 0, of the other 1."""
    schema = "a long, b long"
    arrow = _arrow_schema(rows, schema)

    def links(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, (side, node, prints) = c[: len(PAIR)], c[len(PAIR) :]
        prints = prints.view(np.uint64)
        n = len(side)
        new = np.ones(n, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        one_tile = (keys[2] == keys[4]) & (keys[3] == keys[5])
        # most pairs hold two rows; these are compared together
        two = begin[size == 2]
        two = two[one_tile[two] | (side[two] != side[two + 1])]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
        out = [(node[two], node[two + 1])]
        for s, k in zip(begin[size > 2], size[size > 2]):
            cut = s + int(np.searchsorted(side[s : s + k], 1))
            if one_tile[s]:
                u, v = tile_links(prints[s : s + k], None, radius)
                out.append((node[s:][u], node[s:][v]))
            elif s < cut < s + k:
                u, v = tile_links(prints[s:cut], prints[cut : s + k], radius)
                out.append((node[s:][u], node[cut:][v]))
        a, b = (np.concatenate(x) for x in zip(*out))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c)]
            last = np.ones(len(c[0]), bool)
            for x in c[: len(PAIR)]:
                last &= x == x[-1]
            cut = len(last) - int(last.sum())
            if cut:
                yield from links([x[:cut] for x in c])
            held = [x[cut:] for x in c]
        if held is not None:
            yield from links(held)

    return rows.select(*PAIR, "side", "node", "f0").repartition(*PAIR).sortWithinPartitions(*PAIR, "side").mapInArrow(freed(run), schema)


def _binned(distinct: DataFrame, radius: int) -> DataFrame:
    """t, key, bin, node, f0: each fingerprint in its bucket for every two of the blocks;
    counts that differ by the radius at most lie in one bin or in neighbours."""
    size = radius + 2
    edges = [64 * k // size for k in range(size + 1)]
    masks = [sum(1 << i for x in (x, y) for i in range(edges[x], edges[x + 1])) for x, y in itertools.combinations(range(size), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.col("f0").bitwiseAND(F.lit(m)) for m in signed))
    bin_ = F.floor(F.bit_count("f0") / (radius + 1)).cast("int")
    return distinct.select("node", "f0", bin_.alias("bin"), F.posexplode(keys).alias("t", "key"))


def _layout(rows: DataFrame, tile: int) -> DataFrame:
    """t, key, tiles (bin to number of tiles) of the buckets that hold two rows or more."""
    sizes = rows.groupBy("t", "key", "bin").agg(F.count("*").alias("n"))
    per = sizes.groupBy("t", "key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", F.ceil(F.col("n") / tile).cast("int")))).alias("tiles"))
    return per.where("n > 1").select("t", "key", "tiles")


def _partners(of: Column) -> Column:
    """(bin, part) of the tiles that a tile of bin ``of`` meets, itself too."""
    count = lambda q: F.coalesce(F.try_element_at("tiles", q), F.lit(0))
    each = lambda q: F.transform(F.filter(F.sequence(F.lit(0), count(q)), lambda y: y < count(q)), lambda y: F.struct(q.alias("bin"), y.alias("part")))
    return F.flatten(F.transform(F.array(of - 1, of, of + 1), each))


def tile_pairs(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """compared, skipped: pairs of tiles of one bucket, over all buckets."""
    layout = _layout(_binned(distinct, radius), tile)
    tiles = F.aggregate(F.map_values("tiles"), F.lit(0), lambda a, n: a + n)
    met = F.aggregate(F.map_entries("tiles"), F.lit(0), lambda a, e: a + e["value"] * F.size(_partners(e["key"])))
    counted = layout.select((tiles * (tiles + 1) / 2).cast("long").alias("all"), ((met + tiles) / 2).cast("long").alias("compared"))
    return counted.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"), F.coalesce(F.sum(F.col("all") - F.col("compared")), F.lit(0)).alias("skipped"))


def link_forest(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the nodes (node, f0) as all links within the radius do."""
    rows = _binned(distinct, radius)
    own = F.pmod(F.xxhash64("node"), F.element_at("tiles", F.col("bin"))).cast("int")
    placed = rows.join(_layout(rows, tile), ["t", "key"]).withColumn("here", F.struct("bin", own.alias("part")))
    paired = placed.withColumn("there", F.explode(_partners(F.col("bin"))))
    low, high = F.least("here", "there"), F.greatest("here", "there")
    return _compare(paired.select("t", "key", low["bin"].alias("bin"), low["part"].alias("part"), high["bin"].alias("other_bin"), high["part"].alias("other_part"), F.when(F.col("here") <= F.col("there"), 0).otherwise(1).alias("side"), "node", "f0"), radius)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, f0, component_id: the least doc_id that links reach.

    Texts without words share fingerprint zero and link like any other; null doc_ids
    are left out; rows that repeat an id each have their row, and link by it; an
    empty table gives an empty result; extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    distinct = prints.groupBy("f0").agg(F.min("doc_id").alias("node"))
    found = connected_components(link_forest(distinct, radius, tile))
    named = distinct.join(found, "node", "left").select("f0", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "f0").select("doc_id", "f0", "component_id")
