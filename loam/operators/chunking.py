"""Chunkers as Column expressions, and the lossless splitter to a token limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import SPACE, bound, strip_ws

#: The deepest heading level that a path follows.
DEEPEST = 9


def chunk_chars(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters that start ``size - overlap`` apart, stripped,
    empty ones dropped; the last is the first to reach the end."""
    if size <= 0:
        raise ValueError("size must be positive")
    step = size - min(max(0, overlap), size - 1)

    def windows(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.char_length(t) - size) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: strip_ws(F.substring(t, i * step + 1, F.lit(size))))

    parts = bound(text, windows)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda c: c != "")


def chunk_tokens(text: Column, max_tokens: int, overlap: float = 0.0) -> Column:
    """Windows of white-space tokens; the step is the rounded (half to even) part
    that does not overlap, one at least."""
    step = max(1, round(max_tokens * (1 - min(max(overlap, 0.0), 0.5))))

    def windows(tokens: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - max_tokens) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i * step + 1, max_tokens), " "))

    parts = bound(F.filter(F.split(strip_ws(text), rf"{SPACE}+"), lambda t: t != ""), windows)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda c: c != "")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, half to even."""
    return F.bround(F.char_length(text) / 4, 0).cast("int")


def counted_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("int")


def effective_max_tokens(configured: int | None, profile_max: int, margin: int) -> int:
    limits = [profile_max - margin, *([configured] if configured and configured > 0 else [])]
    return max(1, min(limits))


def split_to_limit(text: Column, max_tokens: int) -> Column:
    """Parts of up to ``max_tokens`` estimated tokens, at ends of sentences, or of
    words where a sentence is longer. No word is lost; a word alone may be longer."""
    limit = 4 * max_tokens
    sentences = F.split(strip_ws(text), rf"(?<=[.!?]){SPACE}+")
    pieces = F.flatten(F.transform(sentences, lambda s: F.when(F.char_length(s) <= limit, F.array(s)).otherwise(F.split(s, rf"{SPACE}+"))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(s: Column, piece: Column) -> Column:
        joined = F.when(s["held"] == "", piece).otherwise(F.concat(s["held"], F.lit(" "), piece))
        fits = F.char_length(joined) <= limit
        done = F.when(fits | (s["held"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(piece).alias("held"))

    return F.aggregate(F.filter(pieces, lambda p: p != ""), start, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def apply_limit(text: Column, max_tokens: int, policy: str) -> Column:
    """The parts of a text under a policy: split, truncate or skip."""
    fits = counted_tokens(text) <= max_tokens
    if policy == "split":
        return F.when(fits, F.array(text)).otherwise(split_to_limit(text, max_tokens))
    if policy == "truncate":
        return F.array(F.substring(text, 1, 4 * max_tokens))
    if policy == "skip":
        return F.when(fits, F.array(text)).otherwise(F.array().cast("array<string>"))
    raise ValueError(f"unknown policy {policy}")


def limit_counts(docs: DataFrame, text: str, max_tokens: int) -> DataFrame:
    over = counted_tokens(F.col(text)) > max_tokens
    return docs.agg(F.count("*").alias("items"), F.count_if(over).alias("over_limit"), F.sum(F.when(over, counted_tokens(F.col(text)) - max_tokens).otherwise(0)).alias("excess_tokens"))


def chunk_rows(items: DataFrame, chunks: Column) -> DataFrame:
    """A row for each chunk, with its number in the document and its id."""
    out = items.select("doc_id", F.posexplode(chunks).alias("pos", "text"))
    return out.withColumn("chunk_seq", F.col("pos") + 1).withColumn("chunk_id", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_seq"))).drop("pos")


def strip_title(chunks: DataFrame) -> DataFrame:
    """Where two or more chunks of a document share their first line, it becomes
    ``doc_title`` and goes from all chunks but the first."""
    first = F.split("text", "\n", 2)[0]
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min(first).alias("_low"), F.max(first).alias("_high"))
    joined = chunks.join(per, "doc_id")
    same = (F.col("_n") >= 2) & (F.col("_low") == F.col("_high"))
    rest = strip_ws(F.coalesce(F.try_element_at(F.split("text", "\n", 2), F.lit(2)), F.lit("")))
    joined = joined.withColumn("doc_title", F.when(same, F.col("_low")))
    return joined.withColumn("text", F.when(same & (F.col("chunk_seq") > 1), rest).otherwise(F.col("text"))).drop("_n", "_low", "_high")


def open_headings(level: Column, title: Column, pos: Column, window, deepest: int = DEEPEST) -> Column:
    """The titles of the headings that are open at a row, outermost first.

    For each level the last heading up to the row counts, unless a shallower one came after it:
    running values only, whatever the number of headings.
    """
    found = []
    for n in range(1, deepest + 1):
        last = F.last(F.when(level == n, F.struct(pos.alias("pos"), title.alias("title"))), ignorenulls=True).over(window)
        shut = F.max(F.when(level < n, pos)).over(window)
        found.append(F.when(shut.isNull() | (last["pos"] > shut), last["title"]))
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def heading_paths(blocks: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """blocks (doc_id, pos, level, title; level null for body) with ``heading_path``:
    the headings that are open at each block, outermost first. Running values within a
    document; a level below 1 shuts all headings and is in no path."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    return blocks.withColumn("heading_path", open_headings(F.col("level"), F.col("title"), F.col("pos"), order, deepest))


def admin_sections(items: DataFrame, heading: str, patterns: list[str], stops: list[str]) -> DataFrame:
    """Items whose heading matches a pattern, and no stop, go."""
    match = lambda ps: F.coalesce(F.col(heading).rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(False)) if ps else F.lit(False)
    return items.where(~match(patterns) | match(stops))


def repeated_page_lines(lines: DataFrame, share: float = 0.6, least_pages: int = 2) -> DataFrame:
    """doc_id, line of lines on ``share`` of the pages or more, of documents with
    ``least_pages``. ``lines``: doc_id, page, line."""
    norm = lines.withColumn("line", strip_ws(F.regexp_replace("line", rf"{SPACE}+", " "))).where("line <> ''")
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    per = norm.where(~F.col("line").rlike(r"^\d+[.)]\s")).select("doc_id", "page", "line").distinct().groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return per.join(pages, "doc_id").where((F.col("pages") >= least_pages) & (F.col("n") / F.col("pages") >= share)).select("doc_id", "line")
