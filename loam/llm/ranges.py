"""Rows dealt into consecutive ranges of their ids, by bounds that never change.

``repartitionByRange`` draws its bounds anew for each job. Here they are taken
once, as approximate quantiles, and stay literals of the plan, so that two jobs,
or a task that runs again after an executor was lost, agree on every row's range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Cells of equal numbers of rows of which a range by bytes is made, on average.
CELLS = 8


def range_bounds(df: DataFrame, key: str, ranges: int, size: Column | None = None) -> list[int]:
    """At most ``ranges - 1`` ascending bounds; the driver gets a few numbers for each.

    Ranges have about as many rows; with ``size``, the bytes of a row, about as many bytes: the
    bytes of cells of equal numbers of rows are summed, and cells are put together up to the mean.
    So no range has more than the mean and one cell.
    """
    if ranges < 2:
        return []
    if size is not None:
        cells = range_bounds(df, key, CELLS * ranges)
        per = df.groupBy(range_of(key, cells).alias("cell")).agg(F.sum(size.cast("long")).alias("n")).collect()
        held = {r["cell"]: r["n"] or 0 for r in per}
        mean, now, bounds = sum(held.values()) / ranges, 0, []
        for i, bound in enumerate(cells):
            now += held.get(i, 0)
            if now >= mean * (len(bounds) + 1) > 0 and len(bounds) < ranges - 1:
                bounds.append(bound)
        return bounds
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(key, shares, 10 * ranges).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_of(key: str | Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the key: 0 to ``len(bounds)``."""
    key = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    below = lambda held: F.size(F.filter(held, lambda b: b <= key))
    held = F.lit(bounds).cast("array<bigint>")
    if len(bounds) <= 64:
        return below(held)
    # first among every so many bounds, then among those up to the next of these
    step = math.isqrt(len(bounds)) + 1
    coarse = below(F.lit(bounds[::step]).cast("array<bigint>"))
    start = (coarse - 1) * step
    return F.when(coarse == 0, 0).otherwise(start + below(F.slice(held, start + 1, F.lit(step))))


#: Bytes of a range, on average, where there are more than tasks otherwise.
RANGE_BYTES = 64 << 20


def default_ranges(df: DataFrame, size: Column | str) -> int:
    """As many ranges as shuffles have tasks, or more, so that ranges stay small; ``size``
    is the bytes of a row."""
    size = F.col(size) if isinstance(size, str) else size
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("n")).first()["n"]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))


def in_ranges(df: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """``df`` with ``range`` and ``place``, dealt so that each range has a task of its own.

    ``place`` names the range by a number that a hash partitioning puts into the range's
    partition; windows by ``place`` need no further shuffle.
    """
    n = len(bounds) + 1
    spark = df.sparkSession
    places: dict[int, int] = {}
    while len(places) < n:  # dozens of numbers for each range
        numbers = spark.range(32 * n + 256).select(F.col("id").cast("int").alias("k"))
        per = numbers.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
        places = {r["p"]: r["k"] for r in per.collect()}
    ranged = df.withColumn("range", range_of(key, bounds))
    place = F.element_at(F.lit([places[r] for r in range(n)]).cast("array<int>"), F.col("range") + 1)
    return ranged.withColumn("place", place).repartition(n, "place")
