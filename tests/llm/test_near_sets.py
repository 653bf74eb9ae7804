import random

import numpy as np
import pytest

from loam.llm import near_sets
from loam.llm.common import text_hash
from tests.llm.test_simhash import corpus, grouped, shingles


def brute(given, similarity=0.8):
    sets = [frozenset(shingles(t, 5)) for _, t in given]
    ids = range(len(given))
    linked = [(a, b) for a in ids for b in ids if b < a and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    group = grouped(ids, linked)
    least = {}
    for k in ids:
        least[group[k]] = min(least.get(group[k], given[k][0]), given[k][0])
    return sorted((given[k][0], least[group[k]]) for k in ids)


def same_as_brute(spark, given, **tiles):
    docs = spark.createDataFrame(given, "doc_id long, text string")
    found = sorted((r.doc_id, r.group_id) for r in near_sets.similar_groups(docs, **tiles).collect())
    assert found == brute(given)


def families(seed, count, copies, words, edits, vocabulary=3000):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(vocabulary)]
    out = []
    for f in range(count):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for k in range(copies):
            w = list(base)
            for _ in range(rng.choice(edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append((1000 * f + k, " ".join(w)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("tiles", [{}, {"tile_sets": 3, "tile_shingles": 400}])
def test_groups(spark, tiles):
    # many pairs near the similarity on either side
    same_as_brute(spark, corpus(8) + [(100_000 + d, t) for d, t in families(11, 3, 25, 150, [0, 2, 3, 4, 5])], **tiles)


def test_small_sets_and_common_passages(spark):
    rng = random.Random(7)
    common = [f"c{k}" for k in range(14)]
    given = []
    for f in range(12):
        base = [*common, *(f"w{rng.randrange(4000)}" for _ in range(rng.choice([0, 3, 12, 21])))]
        for k in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1])):
                w[rng.choice([0, 1, -1, -2])] = f"w{rng.randrange(4000)}"
            given.append((20 * f + k, " ".join(w)))
    for k in range(0, 60, 2):
        base = [f"v{rng.randrange(9000)}" for _ in range(9)]
        given += [(5000 + k, " ".join(base)), (5001 + k, " ".join(base[:8]))]
    same_as_brute(spark, given, tile_sets=4)


def test_repeated_passages_count_once(spark):
    rng = random.Random(5)
    given = []
    for k in range(0, 60, 2):
        base = [f"w{rng.randrange(5000)}" for _ in range(250)]
        given += [(k, " ".join(base)), (k + 1, " ".join(base[:20] * 50 + base))]
    # the same set, with another number of repeats
    given += [(100 + k, "\n".join(["over and over it goes again here"] * k)) for k in (2, 3, 9, 400)]
    same_as_brute(spark, given)


def test_tiles_hand_on_less_links_than_rows(spark):
    """A large group in which most pairs are just below the similarity."""
    given = families(3, 1, 120, 200, [2, 3, 4])
    docs = spark.createDataFrame(given, "doc_id long, text string")
    texts = near_sets.texts_with_hash(docs)
    rows = texts.selectExpr("0 as component", "doc_id as node", "doc_id as label", "0 as side", "text")
    links = near_sets._tile_links(rows, ["component"], 5, 0.8)
    assert 0 < links.count() < len(given)
    same_as_brute(spark, given, tile_sets=30)


def test_chance_of_a_pair_beyond_the_radius():
    """Sets that just reach the similarity: none of 3,000 pairs of a size is out of reach."""
    rng = np.random.default_rng(1)
    far = []
    for n in (26, 40, 90, 300):
        common, own = round(n * 8 / 9), n - round(n * 8 / 9)
        for _ in range(3000 if n < 100 else 300):
            h = rng.integers(0, 1 << 63, common + 2 * own).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            h = near_sets._lane(h, 3)
            x, y = h[: common + own], np.concatenate([h[:common], h[common + own :]])
            prints = [[near_sets.fingerprint(s), near_sets.fingerprint(near_sets._lane(s, 1))] for s in (x, y)]
            far.append(sum((a ^ b).bit_count() for a, b in zip(*prints)))
    assert sum(d > near_sets.RADIUS for d in far) <= 3


def test_rows_that_stay(spark):
    rows = [(1, "a b c d e f", 1), (1, "quite another text of one id", 2), (2, "A b c d e f", 3), (2, "A b c d e f", 3), (3, None, 4), (4, "", 5), (None, "no id", 6), (None, None, 7)]
    docs = spark.createDataFrame([(d, t, {"k": v}, t, v) for d, t, v in rows], "doc_id long, text string, text_hash map<string,int>, row string, _hash int")
    out = near_sets.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(r._hash for r in out.collect()) == [1, 2, 4, 6, 7]
    assert near_sets.one_of_each_group(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(7, "x y z", {"k": k}) for k in (2, 1, 3)], "doc_id long, text string, m map<string,int>")
    assert [r.m for r in near_sets.one_of_each_group(same).collect()] == [{"k": 1}]


def test_long_text(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    other = base[:10_000] + ["new"] * 5 + base[10_000:]
    given = [(2, " ".join(base)), (1, " ".join(other)), (3, " ".join(base[:200_000]))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    assert sorted((r.doc_id, r.group_id) for r in near_sets.similar_groups(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert docs.select(text_hash()).distinct().count() == 3
