"""Benchmark decontamination by winnowing (native).

Of the hashes of all k-grams in a sliding window of ``WINDOW - K + 1`` of them the
least is kept, in documents and in benchmark items alike. Equal windows keep equal
hashes, so every span of ``WINDOW`` words that a document shares with an item has
a kept hash in common. Documents whose kept hashes meet an item's are candidates;
there each meeting of k-grams is extended to both sides, word by word, as far as
the words agree, and counts where the span reaches ``WINDOW`` words.

An item of fewer words is one window; for each such length that the benchmark
has, all grams of that length are held against it.

Words: maximal runs of characters other than ASCII controls, punctuation and
white space, A-Z in lower case. Null texts have no words; items without words and
rows without an id are left out; equal item texts are items of their own; rows
that repeat a doc_id are told apart by their texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import is_small, keyed_rows, materialize, small, texts_with_hash

WINDOW, K = 13, 6
#: Hashes of short items up to which documents keep only grams that meet one.
SHORT_LITERALS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _shifted(name: str, by: int, less: int) -> Column:
    """The array from element ``by`` on, and the array without its last ``less``."""
    return F.slice(name, F.lit(by + 1), F.greatest(F.size(name) - by - less, F.lit(0)))


def _zipped(df: DataFrame, out: str, a: str, b: str, by: int, f) -> DataFrame:
    """out[i] = f(a[i], b[i + by]) wherever both exist."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), f))


def with_grams(df: DataFrame) -> DataFrame:
    """Adds ``one`` (hashes of words) and ``grams`` (of K = 6 words), from ``words``."""
    df = df.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    df = _zipped(df, "two", "one", "one", 1, lambda x, y: F.xxhash64(x, y))
    df = _zipped(df, "four", "two", "two", 2, lambda x, y: F.xxhash64(x, y))
    return _zipped(df, "grams", "four", "two", 4, lambda x, y: F.xxhash64(x, y)).drop("two", "four")


def with_prints(df: DataFrame) -> DataFrame:
    """Adds ``prints``: the least of each 8 = WINDOW - K + 1 neighbouring grams."""
    df = _zipped(df, "m2", "grams", "grams", 1, lambda x, y: F.least(x, y))
    df = _zipped(df, "m4", "m2", "m2", 2, lambda x, y: F.least(x, y))
    df = _zipped(df, "m8", "m4", "m4", 4, lambda x, y: F.least(x, y))
    return df.withColumn("prints", F.array_distinct("m8")).drop("m2", "m4", "m8")


def _grams_of(length: int) -> Column:
    """Hashes of all grams of a short length, told apart from other lengths'."""
    n = F.size("one") - (length - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.lit(length), F.slice("one", i, length)))).otherwise(F.array().cast("array<bigint>"))


def _placed(grams: str | Column, length: int, short: bool) -> Column:
    return F.transform(grams, lambda h, i: F.struct(h.alias("hash"), F.lit(length).alias("length"), i.alias("at"), F.lit(short).alias("short")))


def benchmark_prints(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The items' kept grams, each with its class: hash, length, before, after, class; which
    items are in a class: class, item_id; and the lengths of short items.

    ``before`` and ``after`` are up to WINDOW - K words to either side; a short item is one
    gram. Grams that agree in all of these are one class, however many items have them.
    """
    src = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("words"))
    src = with_prints(with_grams(src.where("size(words) > 0")))
    reach = WINDOW - K
    kept = src.where(F.size("words") >= WINDOW).select("item_id", "words", "prints", F.posexplode("grams").alias("at", "hash")).where(F.array_contains("prints", F.col("hash")))
    kept = kept.select("hash", "item_id", F.lit(K).alias("length"), _around("words", "at", reach, "before").alias("before"), _around("words", "at", reach, "after").alias("after"))
    none = F.array().cast("array<string>")
    short = src.where(F.size("words") < WINDOW).withColumn("length", F.size("words"))
    short = short.select(F.xxhash64(F.col("length"), F.col("one")).alias("hash"), "item_id", "length", none.alias("before"), F.col("words").alias("after"))
    every = materialize(kept.union(short).withColumn("class", F.xxhash64("hash", "length", F.size("before"), "before", "after")), "benchmark-prints")
    out = materialize(every.select("hash", "length", "before", "after", "class").dropDuplicates(["class"]), "benchmark-classes")
    of_class = every.select("class", "item_id").distinct()
    whole = (F.size("before") == 0) & (F.size("after") == F.col("length"))
    lengths = sorted(r["length"] for r in out.where(whole).select("length").distinct().collect())  # WINDOW lengths at most
    return out, of_class, lengths


def _around(words_: str, at: str, reach: int, side: str) -> Column:
    """Words before position ``at`` (from 0), nearest first, or from it on."""
    i = F.col(at)
    if side == "before":
        n = F.least(i, F.lit(reach))
        return F.reverse(F.slice(words_, i - n + 1, n))
    return F.slice(words_, i + 1, F.lit(K + reach))


def _agreeing(a: str, b: str) -> Column:
    """How many first elements of two arrays agree."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (sorted as strings), spans.

    Every document has its row; ``spans`` are ranges of words, possibly overlapping.
    """
    bench, of_class, lengths = benchmark_prints(items)
    hashes = bench.select("hash").distinct()
    src = texts_with_hash(docs)
    full = with_prints(with_grams(src.withColumn("words", words(F.col("text")))))
    prints = F.col("prints")
    if lengths:
        short = [r["hash"] for r in bench.where(F.col("length").isin(lengths) & (F.size("before") == 0) & (F.size("after") == F.col("length"))).select("hash").distinct().limit(SHORT_LITERALS + 1).collect()]
        grams = F.array_distinct(F.concat(*(_grams_of(n) for n in lengths)))
        if len(short) <= SHORT_LITERALS:
            grams = F.array_intersect(grams, F.lit(short).cast("array<bigint>"))
        prints = F.concat(prints, grams)
    read = materialize(full.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), prints.alias("prints")), "document-prints")

    hashes = materialize(hashes, "benchmark-hashes")
    few = is_small(hashes)
    hashes = F.broadcast(hashes) if few else hashes
    met = read.select("doc_id", "text_hash", F.explode("prints").alias("hash")).join(hashes, "hash", "left_semi")
    candidates = small(materialize(met.select("doc_id", "text_hash").distinct(), "candidates"))

    near = with_grams(src.join(candidates, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).withColumn("words", words(F.col("text"))))
    none = F.array().cast("array<string>")
    at = [_placed("grams", K, short=False), *(_placed(_grams_of(n), n, short=True) for n in lengths)]
    placed = near.select("doc_id", "text_hash", "words", F.explode(reduce(lambda x, y: F.concat(x, y), at)).alias("g")).select("doc_id", "text_hash", "g.*", "words")
    # else the join of pairs drops them, after the words about a gram were cut out
    placed = placed.join(hashes, "hash", "left_semi") if few else placed
    placed = placed.select("doc_id", "text_hash", "hash", "length", "at", F.when(F.col("short"), none).otherwise(_around("words", "at", WINDOW - K, "before")).alias("d_before"), F.when(F.col("short"), F.slice("words", F.col("at") + 1, F.col("length"))).otherwise(_around("words", "at", WINDOW - K, "after")).alias("d_after"))
    pairs = placed.join(small(bench), ["hash", "length"])
    left, right = _agreeing("d_before", "before"), _agreeing("d_after", "after")
    whole = (F.size("before") == 0) & (F.size("after") == F.col("length")) & (right == F.col("length"))
    spans = pairs.withColumn("left", left).withColumn("right", right).where(((F.col("right") >= F.col("length")) & (F.col("left") + F.col("right") >= WINDOW)) | whole)
    spans = spans.select("doc_id", "text_hash", "class", F.struct((F.col("at") - F.col("left")).alias("begin"), (F.col("at") + F.col("right")).alias("end")).alias("span"))
    spans = materialize(spans, "spans")
    found = spans.select("doc_id", "text_hash", "class").distinct().join(small(of_class), "class").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = spans.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans")).join(found, ["doc_id", "text_hash"])
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"] - 1)))))
    hit = hit.withColumn("n_hit", covered.cast("long"))
    out = read.select("doc_id", "text_hash", "n_words").join(hit, ["doc_id", "text_hash"], "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "spans").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated; rows
    without an id stay."""
    bad = contamination(docs, items).where("contaminated").select("doc_id", "text_hash").distinct()
    bad = materialize(bad, "contaminated")
    kept = keyed_rows(docs).join(small(bad), ["doc_id", "text_hash"], "left_anti")
    return kept.select("row.*")
