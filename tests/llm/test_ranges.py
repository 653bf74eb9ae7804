from bisect import bisect_right

from pyspark.sql import functions as F

from loam.llm import ranges


def test_range_of(spark):
    for n in (0, 1, 5, 64, 65, 200, 1000):
        bounds = [3 * k for k in range(n)]
        found = spark.range(-10, 3 * n + 10).select("id", ranges.range_of(F.col("id"), bounds).alias("r")).collect()
        assert all(r.r == bisect_right(bounds, r.id) for r in found)


def test_bounds(spark):
    assert ranges.range_bounds(spark.range(0), "id", 4) == []
    bounds = ranges.range_bounds(spark.range(1000), "id", 4)
    assert len(bounds) == 3 and all(abs(b - w) < 20 for b, w in zip(bounds, (250, 500, 750)))
    assert ranges.range_bounds(spark.range(10).select(F.lit(7).alias("id")), "id", 4) == [7]


def test_bounds_by_bytes(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") >= 900, 10_000).otherwise(1).alias("size"))
    bounds = ranges.range_bounds(rows, "id", 8, F.col("size"))
    per = [r.n for r in rows.groupBy(ranges.range_of("id", bounds).alias("r")).agg(F.sum("size").alias("n")).collect()]
    assert len(bounds) <= 7 and max(per) <= 2 * 1_000_900 / 8
    even = ranges.range_bounds(spark.range(1000), "id", 4, F.lit(5))
    assert len(even) == 3 and all(abs(b - w) < 40 for b, w in zip(even, (250, 500, 750)))
    assert ranges.range_bounds(spark.range(0), "id", 4, F.lit(1)) == []
    assert ranges.range_bounds(spark.range(10).select(F.lit(7).alias("id")), "id", 4, F.lit(1)) == []


def test_each_range_has_a_partition(spark):
    for n in (0, 1, 6, 40):
        bounds = [100 * k for k in range(1, n + 1)]
        rows = ranges.in_ranges(spark.range(100 * (n + 1)), "id", bounds)
        assert rows.rdd.getNumPartitions() == n + 1
        per = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("range").alias("r"), F.count("*").alias("c")).collect() if n < 2 else rows.select("range", F.spark_partition_id().alias("p")).distinct().collect()
        assert len(per) == n + 1
    assert ranges.default_ranges(spark.range(10), F.lit(ranges.RANGE_BYTES)) == 10
