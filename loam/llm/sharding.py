"""Sharding by a Feistel permutation with cycle walking (native).

Each row gets a global number 0..n-1 in ascending order of its key. A Feistel
network over the smallest power of two that holds n permutes these numbers;
values that fall outside 0..n-1 walk along their cycle until they return. The
permuted number alone gives the shard (remainder) and the slot (quotient), so
any row's place can be computed without a shuffle of the texts, and shard sizes
differ by one row at most.

Null doc_ids are left out; null texts count as empty; rows that repeat an id each
get a place of their own (ties are ordered by size and checksum; rows equal in
all three are interchangeable); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.ranges import default_ranges, in_ranges, range_bounds, range_of

ROUNDS = 6
#: Steps of the walk. Each leaves a row outside with a chance under a half; a row
#: that is outside after all of them raises an error rather than get a wrong place.
WALK = 96
#: About the bytes of a row that is numbered.
ROW_BYTES = 64


def feistel(x: Column, bits: int, seed: int) -> Column:
    """A permutation of 0..2**bits-1; the halves swap widths in each round."""
    low = bits // 2
    high = bits - low
    keys = F.lit([seed * 1_000_003 + r for r in range(ROUNDS)]).cast("array<bigint>")

    def step(s: Column, key: Column) -> Column:
        # widths alternate: the right part of an even round has `low` bits
        left_mask = F.when(s["even"], F.lit((1 << high) - 1)).otherwise(F.lit((1 << low) - 1)).cast("long")
        mixed = F.xxhash64(s["right"], key).bitwiseAND(left_mask)
        return F.struct(s["right"].alias("left"), s["left"].bitwiseXOR(mixed).alias("right"), (~s["even"]).alias("even"))

    start = F.struct(F.shiftright(x, low).alias("left"), x.bitwiseAND(F.lit((1 << low) - 1).cast("long")).alias("right"), F.lit(True).alias("even"))
    return F.aggregate(keys, start, step, lambda s: F.shiftleft(s["left"], low).bitwiseOR(s["right"]))


def permuted(row: Column, n: int, seed: int = 1) -> Column:
    """The place of row number ``row`` in a shuffle of 0..n-1."""
    bits = max(2, (max(n, 2) - 1).bit_length())
    size = F.lit(n).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(row, bits, seed), lambda v, _: F.when(v < size, v).otherwise(feistel(v, bits, seed)))
    return F.when(walked < size, walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def numbered(df: DataFrame, key: str, ties: list[str], ranges: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``row`` 0..n-1 in ascending order of key and ties, and n.

    Ranges of the key are numbered side by side; the driver holds one count a range.
    """
    bounds = range_bounds(df, key, ranges or default_ranges(df, F.lit(ROW_BYTES)))
    ranged = in_ranges(df, key, bounds)
    counts = {r["range"]: r["n"] for r in df.select(range_of(key, bounds).alias("range")).groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for r in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(r, 0)
    w = Window.partitionBy("place").orderBy(key, *ties)
    offset = F.element_at(F.lit(before).cast("array<bigint>"), F.col("range") + 1)
    return ranged.withColumn("row", offset + F.row_number().over(w) - 1).drop("range", "place"), total


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot for every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    ids, n = numbered(narrow, "doc_id", ["size", "text_crc32"])
    place = ids.withColumn("place", permuted(F.col("row").cast("long"), n, seed))
    return place.select("doc_id", "size", "text_crc32", "row", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))
