"""Golden-query evaluation: hit rate, reciprocal rank and phrase hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.text import bound


#: Short phrases that are broadcast, after a count; more of them are joined without.
SHORT = 10_000


def hits(golden: DataFrame, results: DataFrame, default_k: int = 10) -> DataFrame:
    """query_id, eligible, first_rank: the first rank of a wanted document.

    ``golden``: query_id, expect_doc_ids, expect_phrases, top_k; ``results``:
    query_id, rank, doc_id, chunk_id, text. A result counts by its doc_id, or else
    its chunk_id, up to the query's own top_k.
    """
    g = golden.select("query_id", "expect_doc_ids", "top_k", (F.size(F.coalesce("expect_doc_ids", F.array().cast("array<string>"))) > 0).alias("eligible"))
    r = results.select("query_id", "rank", F.coalesce(F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.col("chunk_id").cast("string")).alias("found"))
    joined = g.join(r, "query_id", "left").where(F.col("rank").isNull() | (F.col("rank") <= F.coalesce("top_k", F.lit(default_k))))
    first = joined.groupBy("query_id").agg(F.min(F.when(F.array_contains("expect_doc_ids", F.col("found")), F.col("rank"))).alias("first_rank"))
    return g.select("query_id", "eligible").join(first, "query_id", "left")


def hit_rate_mrr(golden: DataFrame, results: DataFrame, default_k: int = 10) -> DataFrame:
    """eligible, hits, hit_rate, mrr over the queries that want documents; zeros if none."""
    per = hits(golden, results, default_k).where("eligible")
    out = per.agg(F.count("*").alias("eligible"), F.count("first_rank").alias("hits"), F.coalesce(F.sum(1.0 / F.col("first_rank")), F.lit(0.0)).alias("_rr"))
    zero = lambda c: F.coalesce(F.try_divide(c, F.col("eligible")), F.lit(0.0))
    return out.select("eligible", "hits", zero(F.col("hits").cast("double")).alias("hit_rate"), zero(F.col("_rr")).alias("mrr"))


def phrase_hits(golden: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, phrase_hit: whether a wanted phrase is in a returned text."""
    joined = golden.select("query_id", "expect_phrases").join(results.select("query_id", "text"), "query_id", "left")
    found = F.exists(F.coalesce("expect_phrases", F.array().cast("array<string>")), lambda p: F.lower("text").contains(F.lower(p)))
    return joined.groupBy("query_id").agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("phrase_hit"))


def phrases_in(phrases: DataFrame, texts: DataFrame, words: int = 3) -> DataFrame:
    """query_id, phrase_hit: whether any text holds the whole phrase, in any case.

    The words of a phrase but its first and last are whole words of a text that holds it,
    so the two share the hash of the first few of these; only pairs that do are tested. Phrases
    with fewer words are held against every text. Equal texts are held against them once.
    """
    split = lambda c: F.split(F.trim(F.regexp_replace(c, r"[\x00-\x20]+", " ")), " ")
    p = phrases.where("phrase is not null").select("query_id", F.lower("phrase").alias("phrase"))
    p = p.withColumn("inner", F.slice(split(F.col("phrase")), F.lit(2), F.greatest(F.size(split(F.col("phrase"))) - 2, F.lit(0))))
    t = texts.where("text is not null").select(F.lower("text").alias("text")).groupBy(F.sha2("text", 256).alias("of")).agg(F.first("text").alias("text"))
    grams = bound(split(F.col("text")), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words))))
    long = p.where(F.size("inner") >= words).withColumn("gram", F.xxhash64(F.slice("inner", 1, words)))
    keyed = t.withColumn("gram", F.explode(F.array_distinct(grams)))
    met = keyed.select("gram", "of").join(long.select("gram").distinct(), "gram", "left_semi")
    near = t.join(met, "of").join(long, "gram").where(F.col("text").contains(F.col("phrase"))).select("query_id")
    short = p.where(F.size("inner") < words)
    short = F.broadcast(short) if short.limit(SHORT + 1).count() <= SHORT else short
    hits = near.union(t.join(short, F.col("text").contains(F.col("phrase"))).select("query_id"))
    found = hits.distinct().withColumn("phrase_hit", F.lit(True))
    return phrases.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("phrase_hit", F.lit(False)).alias("phrase_hit"))
