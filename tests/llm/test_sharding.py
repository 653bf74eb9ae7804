import zlib
from collections import Counter

from pyspark.sql import functions as F

from loam.llm import sharding

DOCS = "doc_id long, text string, size string, row int"


def test_feistel_is_a_permutation(spark):
    for n in [1, 2, 3, 5, 64, 100, 1025]:
        out = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7).alias("p")).collect()]
        assert sorted(out) == list(range(n))
        if n > 60:
            assert out != list(range(n))


def test_shards(spark):
    texts = ["", None, "é", "a" * 9000, "same", "same"] + [f"text {k}" for k in range(100)]
    given = [(7 * k, t, "x", 1) for k, t in enumerate(texts)] + [(0, "", "x", 1), (0, "z", "y", 2)]
    docs = spark.createDataFrame([*given, (None, "none", "x", 1)], DOCS)
    rows = sharding.shard_documents(docs, shards=7).collect()
    assert len(rows) == len(given)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in given)
    again = sharding.shard_documents(docs.repartition(9), shards=7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    one = sharding.shard_documents(docs.where("doc_id = 7"), shards=24).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
