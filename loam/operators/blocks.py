"""Cleaning of blocks over a whole document, and numbering of list levels.

blocks: doc_id, pos, page, block_type, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import is_heading_line, is_toc_anchor, is_toc_candidate, is_toc_like, is_toc_line, is_toc_strict, strip_ws, toc_entries
from loam.operators.chunking import repeated_page_lines


def toc_flags(lines: DataFrame, by: list[str], order: list[str], line: str = "line") -> DataFrame:
    """``lines`` with ``toc``, whether a line lies in a table of contents: from an anchor to the
    next line that looks like a heading.

    An anchor that is no heading opens, a heading that is no anchor shuts, a line that is both
    does the other of what is; so the state is what the last of the first two left, turned as
    often as one of the third kind followed. Running values, linear in the lines.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    c = F.col(line)
    rows = lines.withColumns({"_a": F.coalesce(is_toc_anchor(c), F.lit(False)), "_h": F.coalesce(is_heading_line(c), F.lit(False))})
    sets, turns = F.col("_a") != F.col("_h"), F.col("_a") & F.col("_h")
    rows = rows.withColumn("_turns", F.count_if(turns).over(w))
    base = F.last(F.when(sets, F.struct(F.col("_a").cast("int").alias("open"), F.col("_turns").alias("n"))), ignorenulls=True).over(w)
    rows = rows.withColumn("_state", (F.coalesce(base["open"], F.lit(0)) + F.col("_turns") - F.coalesce(base["n"], F.lit(0))) % 2 == 1)
    before = F.lag("_state", 1, False).over(w)
    toc = is_toc_like(c) | (strip_ws(c).rlike(r"\d{1,4}\s*\z") & ~F.col("_h"))
    return rows.withColumn("toc", F.when(before, ~F.col("_h") & toc).otherwise(F.col("_a"))).drop("_a", "_h", "_turns", "_state")


def without_toc(lines: DataFrame, by: list[str], order: list[str], mode: str = "auto", entries: int = 3, line: str = "line") -> DataFrame:
    """Lines without those of tables of contents.

    ``auto``: the region that an anchor opens goes, and lines that look like an entry anywhere,
    also those in which ``entries`` or more were run together; ``strict``: lines with leaders, a
    tab or a number before a page number; ``off``: none goes.
    """
    c = F.col(line)
    if mode == "off":
        return lines
    if mode == "strict":
        return lines.where(~F.coalesce(is_toc_strict(c), F.lit(False)))
    if mode != "auto":
        raise ValueError(f"unknown mode {mode}")
    alone = is_toc_line(c) | is_toc_candidate(c) | (toc_entries(c) >= entries)
    return toc_flags(lines, by, order, line).where(~F.col("toc") & ~F.coalesce(alone, F.lit(False))).drop("toc")


def clean_blocks(blocks: DataFrame, mode: str, compat: bool = False) -> DataFrame:
    """Blocks without lines of tables of contents, without blank lines and, for
    ``mode`` pdf, without lines that repeat over pages (documents of one page keep
    theirs, unless ``compat``). Images pass as they are; empty blocks go."""
    image = F.coalesce(F.col("block_type") == "image", F.lit(False))
    lines = blocks.where(~image).select("doc_id", "pos", "page", F.posexplode(F.split("text", r"\r\n?|\n")).alias("n", "line"))
    flagged = toc_flags(lines, ["doc_id"], ["pos", "n"])
    kept = flagged.where(~F.col("toc") & (strip_ws(F.col("line")) != ""))
    if mode == "pdf":
        repeated = repeated_page_lines(kept, least_pages=1 if compat else 2).withColumnRenamed("line", "_norm")
        kept = kept.withColumn("_norm", strip_ws(F.regexp_replace("line", r"(?U)\s+", " "))).join(repeated, ["doc_id", "_norm"], "left_anti")
    text = kept.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    cleaned = blocks.where(~image).drop("text").join(text, ["doc_id", "pos"])
    return cleaned.select(blocks.columns).unionByName(blocks.where(image))


def numbered_levels(items: DataFrame, deepest: int = 8) -> DataFrame:
    """items (doc_id, pos, num_id, level from 0) with ``prefix``: a counter for each
    level of each num_id in its document; deeper levels start anew. What a counter had at the
    last shallower item is taken from its running count."""
    w = Window.partitionBy("doc_id", "num_id").orderBy("pos")
    level = F.col("level")
    rows = items.withColumns({f"_c{n}": F.count_if(level == n).over(w) for n in range(deepest + 1)})
    now = [F.col(f"_c{n}") - F.coalesce(F.last(F.when(level < n, F.col(f"_c{n}")), ignorenulls=True).over(w), F.lit(0)) for n in range(deepest + 1)]
    parts = F.array(*(F.when(level >= n, x.cast("string")) for n, x in enumerate(now)))
    return rows.withColumn("prefix", F.array_join(parts, ".")).drop(*(f"_c{n}" for n in range(deepest + 1)))


def placeholders(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, chunk_id, figure_id, image_ref for each mark of a known figure."""
    marks = chunks.select("doc_id", "chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[FIGURE:([^\]]+)\]"), F.lit(1)))).alias("figure_id"))
    return marks.join(figures.select("doc_id", "figure_id", "image_ref"), ["doc_id", "figure_id"])
