import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from loam.llm import components, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n):
    w = WORD.findall(lower(t))
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])


def print_of(t, n=4):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(t, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}é" for k in range(400)] + ["the", "OF"]
    docs = [(1, ""), (2, None), (3, " \n"), (4, "one"), (5, "one Two three"), (6, "ONE two three"), (7, "x " * 500)]
    d = 10
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((d, rng.choice([" ", "\n"]).join(w)))
            d += 3
    rng.shuffle(docs)
    return docs


def check_small(spark, tile):
    given = corpus(4)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in given] + [(None, "n", "x", 1)], "doc_id long, text string, node string, t int")
    prints = {d: print_of(t) for d, t in given}
    ids = sorted(prints)
    want = grouped(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4])
    rows = simhash.near_duplicates(docs, tile=tile).collect()
    assert {r.doc_id: r.f0 & (1 << 64) - 1 for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == want and len(rows) == len(given)


def test_agrees_with_brute_force(spark):
    check_small(spark, simhash.TILE)


def test_large_buckets_are_tiled(spark):
    check_small(spark, 3)


def test_tile_links_connect_as_all_links_do():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.integers(0, 1 << 63, 40).astype(np.uint64)] * 6)
    for k in range(len(rows)):
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            rows[k] ^= np.uint64(1 << int(b))
    far = np.bitwise_count(rows[:, None] ^ rows[None])
    for b in (None, rows[100:]):
        a = rows if b is None else rows[:100]
        for radius in (3, 8, 12):
            u, v = simhash.tile_links(a, b, radius)
            v = v if b is None else v + 100
            ids = range(len(rows))
            pairs = [(i, j) for i in ids for j in ids if (i < j if b is None else i < 100 <= j) and far[i, j] <= radius]
            assert grouped(ids, pairs) == grouped(ids, list(zip(u, v))) and all(far[i, j] <= radius for i, j in zip(u, v))
            assert len(u) < len(rows)


def test_tile_pairs_beyond_the_radius_are_skipped(spark):
    """Fingerprints of 0, 10, .. ones share the buckets of their high bits and never meet."""
    prints = [(k, (1 << ones) - 1 - (1 << k % 4) * (ones > 4)) for k, ones in enumerate([10] * 4 + [20] * 4 + [30] * 4)]
    nodes = spark.createDataFrame(prints, "node long, f0 long")
    r = simhash.tile_pairs(nodes, 4).first()
    assert r.compared > 0 and r.skipped > 0
    spread = simhash.tile_pairs(nodes, 4, tile=1).first()
    assert spread.compared > r.compared and spread.skipped > r.skipped
    assert {(min(x), max(x)) for x in simhash.link_forest(nodes, 4).collect()} <= {(i, j) for i in range(12) for j in range(12) if i // 4 == j // 4}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    want = grouped({x for p in links for x in p if p[0] != p[1]}, [p for p in links])
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    one = defaultdict(list)
    for r in simhash.near_duplicates(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")).collect():
        one[r.doc_id].append(r.component_id)
    assert one == {1: [1, 1], 2: [2]}
