"""Document fingerprints: Merkle trees over paragraphs and sections (native).

Sections of a text are what empty lines (two line feeds) part, paragraphs what a
line feed parts. A paragraph's node is the SHA-256 of its text, a section's that
of its paragraphs' nodes, the root that of its sections' nodes. Roots are equal
exactly where texts are; where they differ, the branches that only one version has
locate the edit.

Below a paragraph lie leaves whose borders the text itself sets: after a word that ends
in certain letters, or after so many characters. An edit changes the leaves about it,
and the borders after it are where they were. The likeness of two trees is
the share of their nodes, on all levels below the root, that both have (Jaccard).

A null text counts as empty; null doc_ids are left out; rows that repeat an id
are neighbours of one another; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.ranges import default_ranges, in_ranges, range_bounds, range_of

#: A leaf: up to the next word that ends in one of the letters, or 48 characters.
LEAF = "[^\n]{0,46}?[esdnt] |[^\n]{1,48}"


def sections(text: Column) -> Column:
    """array<struct<node, paragraphs: array of nodes>>"""
    parts = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.sha2(p, 256)))
    return F.transform(parts, lambda p: F.struct(F.sha2(F.array_join(p, ""), 256).alias("node"), p.alias("paragraphs")))


def root(text: Column) -> Column:
    parts = F.transform(F.split(text, "\n\n", -1), lambda s: F.sha2(F.array_join(F.transform(F.split(s, "\n", -1), lambda p: F.sha2(p, 256)), ""), 256))
    return F.sha2(F.array_join(parts, ""), 256)


def nodes(text: Column) -> Column:
    """The hashes of a tree's different leaves, paragraphs and sections."""
    leaves = F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda b: F.xxhash64(b))
    paragraphs = F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(F.lit("p"), p))
    parts = F.transform(F.split(text, "\n\n", -1), lambda s: F.xxhash64(F.lit("s"), s))
    return F.array_distinct(F.concat(leaves, paragraphs, parts))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union).cast("double")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, root, sections and nodes of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return src.select("doc_id", root(F.col("text")).alias("root"), sections(F.col("text")).alias("sections"), nodes(F.col("text")).alias("nodes"))


def differing_branches(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, side (a or b), section, paragraphs: what only one of two versions of a doc_id
    has (see ``fingerprint_documents``), counted from 0 in that version.

    Nodes are paired with equal ones of the other version, the first with the first,
    so what an insertion moves along is no difference; a mere change of order is none.
    """
    pair = a.select("doc_id", F.col("root").alias("ra"), F.col("sections").alias("sa")).join(b.select("doc_id", F.col("root").alias("rb"), F.col("sections").alias("sb")), "doc_id").where("ra <> rb")
    sides = pair.select("doc_id", F.explode(F.create_map(F.lit("a"), "sa", F.lit("b"), "sb")).alias("side", "sections"))
    each = sides.select("doc_id", "side", F.posexplode("sections").alias("section", "s")).select("doc_id", "side", "section", F.posexplode("s.paragraphs").alias("paragraph", "node"))
    times = F.row_number().over(Window.partitionBy("doc_id", "side", "node").orderBy("section", "paragraph"))
    paired = each.withColumn("times", times).groupBy("doc_id", "node", "times").agg(F.count("*").alias("n"), F.min(F.struct("side", "section", "paragraph")).alias("at")).where("n = 1")
    return paired.groupBy("doc_id", "at.side", "at.section").agg(F.array_sort(F.collect_list("at.paragraph")).alias("paragraphs"))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, nodes, next_text, next_nodes: the document that follows in
    descending order of doc_id (ties: of text); after the last comes the first.

    Ranges of doc_id are put in order side by side. The first row of each range is
    also put at the end of the range before it in that order, as its follower.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = F.octet_length("text") + 8
    bounds = range_bounds(src, "doc_id", ranges or default_ranges(src, size), size)
    held = sorted(r["range"] for r in src.select(range_of("doc_id", bounds).alias("range")).distinct().collect())
    ranged = src.withColumn("range", range_of("doc_id", bounds))
    # the rows of range r are followed by the first row of the next lower one
    before = [r for _, r in sorted({low: high for low, high in zip(held, held[1:] + held[:1])}.items())]
    at = F.array_position(F.lit(held or [0]).cast("array<int>"), F.col("range")).cast("int")
    heads = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "text")).alias("head"))
    heads = heads.select("head.doc_id", "head.text", F.element_at(F.lit(before or [0]).cast("array<int>"), at).alias("range"), F.lit(1).alias("copy"))
    rows = in_ranges(ranged.withColumn("copy", F.lit(0)).unionByName(heads).withColumnRenamed("range", "own"), "own", list(range(1, len(bounds) + 1)))
    w = Window.partitionBy("place").orderBy("copy", F.desc("doc_id"), F.desc("text"))
    # nodes come after the shuffle, which carries texts alone
    ordered = rows.withColumn("nodes", nodes(F.col("text"))).withColumn("next_text", F.lead("text").over(w)).withColumn("next_nodes", F.lead("nodes").over(w))
    return ordered.where("copy = 0").drop("copy", "own", "range", "place")


def edited(text: Column, other: Column) -> Column:
    """The text with its last half replaced by as many first characters of the other."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))
