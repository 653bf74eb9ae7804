"""Structure-aware chunkers for DOCX and PDF items.

Lines are rows: what a line is (heading, list item, entry of a table of contents,
boilerplate) are Column expressions, where a unit begins is a running count in its
document, and units are put together by aggregation. Only the greedy filling of
chunks up to a token budget runs in Python, on one document's units at a time.

items: doc_id, item_idx, text, section_heading, heading_path, heading_level,
block_type, figure_id, page (those that a chunker does not need may be absent).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.slices import column_of
from loam.functions.text import TOC_LEADER, TOC_TAB, current_heading, is_toc_line, strip_ws
from loam.operators import packing
from loam.operators.blocks import toc_flags, without_toc

CHUNK_FIELDS = ["chunk_seq int", "text string", "section string", "section_range string", "title_first string", "title_last string", "page_start int", "page_end int", "is_split boolean", "split_part int", "split_reason string", "unit_type string"]
ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

# predicates over lines; fixed values: their patterns and limits


def is_list_item(c: Column) -> Column:
    return c.rlike(r"^\s*(?:[-*•]|[0-9]+[.)])\s+")


def is_numbered_heading(c: Column) -> Column:
    return c.rlike(r"^\s*\d{1,3}(?:\.\d{1,3}){0,4}\.?\s+\S")


def is_sop_heading(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*sop\s*\d+\b")


def is_major_heading(c: Column) -> Column:
    return is_sop_heading(c) | (c.rlike(r"^\s*\d+\b") & ~c.rlike(r"^\s*\d+\.\d"))


def is_title_like(c: Column, most_words: int = 10) -> Column:
    """Few words, all begun by capitals, or all capitals; or numbered; no list item."""
    words = F.size(F.split(strip_ws(c), r"(?U)\s+"))
    # a capital begins each run of cased letters and stands nowhere else
    title = c.rlike(r"^[^\p{Lu}\p{Ll}\p{Lt}]*(?:[\p{Lu}\p{Lt}]\p{Ll}*(?:[^\p{Lu}\p{Ll}\p{Lt}]+|$))+$")
    upper = c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")
    return (c != "") & (F.char_length(c) <= 120) & ~is_list_item(c) & (c.rlike(r"^\s*[0-9]+(\.[0-9]+)*\b") | ((words <= most_words) & (title | upper)))


def is_procedure_title(c: Column) -> Column:
    letters = F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))
    upper = F.char_length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    shouted = c.rlike(r":\s*$") & (F.char_length(c) <= 120) & (letters > 0) & (upper >= letters * 0.6)
    return c.rlike(r"^\s*\d+\.\d+") | is_numbered_heading(c) | shouted


def section_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+\.\d+(?:\.\d+)*)\b", 1), F.lit(""))


def is_boilerplate(c: Column) -> Column:
    return c.rlike(r"(?i)confidential|restricted|page\s+\d+\s+of\s+\d+")


# lines and units


def with_default_columns(items: DataFrame) -> DataFrame:
    kinds = {"section_heading": "string", "heading_path": "array<string>", "heading_level": "int", "block_type": "string", "figure_id": "string", "page": "int"}
    return items.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in items.columns})


def lines_of(items: DataFrame) -> DataFrame:
    """doc_id, item_idx, line_no, pos (order in the document), line and the item's fields."""
    rows = with_default_columns(items).select("*", F.posexplode(F.split("text", r"\r\n?|\n")).alias("line_no", "line")).drop("text")
    return rows.withColumn("pos", F.col("item_idx").cast("long") * (1 << 32) + F.col("line_no"))


def joined_units(lines: DataFrame, boundary: Column, keep: list[str]) -> DataFrame:
    """Units from a boundary line to the next: doc_id, unit, text, and the first value
    of each column in ``keep``."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    numbered = lines.withColumn("unit", F.sum(F.when(boundary, 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("doc_id", "unit").agg(text.alias("text"), F.min_by(F.struct(*keep), "pos").alias("_k")).select("doc_id", "unit", strip_ws(F.col("text")).alias("text"), *(F.col(f"_k.{c}").alias(c) for c in keep)).where("text <> ''")


# filling


def _tokens(text: str) -> int:
    return round(len(text) / 4)


def _pieces(text: str, most: int) -> Iterator[str]:
    """Parts of up to ``most`` tokens at line ends, else at words; no word is lost."""
    held = ""
    for line in text.split("\n"):
        words = [line] if _tokens(line) <= most else line.split(" ")
        for k, w in enumerate(words):
            joined = f"{held}{chr(10) if k == 0 else ' '}{w}" if held else w
            if held and _tokens(joined) > most:
                yield held
                held = w
            else:
                held = joined
    if held.strip():
        yield held


def fill(units: DataFrame, max_tokens: int, min_tokens: int = 0, least_tail: int = 0, overlap_words: int = 0) -> DataFrame:
    """Chunks from units (doc_id, unit, section, title, number, page, unit_type, text).

    Units of one section fill a chunk up to the budget; the section's line leads each
    chunk, once. A unit over the budget is split, its section and title lead each
    part. A last part under ``least_tail`` tokens joins the one before it. Units of type
    ``block`` are packed as ``packing`` does, without leading lines.
    """

    def chunks(units: list[dict]) -> list[dict]:
        """The chunks of one document's units."""
        out: list[dict] = []
        held: list[dict] = []

        def lead(section: str | None, title: str | None, body: str) -> str:
            parts = [p for p in (section, title) if p]
            lines = body.split("\n")
            while parts and lines and " ".join(lines[0].split()).lower() in [" ".join(p.split()).lower() for p in parts]:
                lines = lines[1:]
            return "\n".join([*parts, *lines]).strip()

        def emit(rows: list[dict], text: str, split: bool, part: int, reason: str | None) -> None:
            if not text or (min_tokens and _tokens(text) < min_tokens):
                return
            numbers = list(dict.fromkeys(r["number"] for r in rows if r["number"]))
            titles = [r["title"] for r in rows if r["title"]]
            pages = [r["page"] for r in rows if r["page"] is not None]
            out.append({
                "chunk_seq": len(out) + 1, "text": text, "section": rows[0]["section"], "section_range": "-".join(dict.fromkeys([numbers[0], numbers[-1]])) if numbers else None,
                "title_first": titles[0] if titles else None, "title_last": titles[-1] if titles else None, "page_start": min(pages, default=None), "page_end": max(pages, default=None),
                "is_split": split, "split_part": part, "split_reason": reason, "unit_type": rows[0]["unit_type"],
            })

        def flush() -> None:
            if held:
                part = 1 + sum(1 for o in out if o["section"] == held[0]["section"])
                emit(held, lead(held[0]["section"], None, "\n".join(r["text"] for r in held)), part > 1, part, "max_tokens" if part > 1 else None)
                held.clear()

        def pack(rows: list[dict]) -> None:
            """A section without titles: its blocks fill chunks, one-line chunks go forward."""
            parts = packing.merged_forward(packing.filled([(r["text"], bool(r["alone"])) for r in rows], max_tokens, overlap_words))
            for c in parts:
                emit(rows, c["text"], c["is_split"], c["split_part"], c["split_reason"])

        blocks: list[dict] = []
        for row in units:
            if blocks and (row["unit_type"] != "block" or blocks[0]["section"] != row["section"]):
                pack(blocks)
                blocks = []
            if row["unit_type"] == "block":
                flush()
                blocks.append(row)
                continue
            if held and held[0]["section"] != row["section"]:
                flush()
            whole = lead(row["section"], None, "\n".join([*(r["text"] for r in held), row["text"]]))
            if _tokens(whole) <= max_tokens:
                held.append(row)
                continue
            flush()
            if _tokens(lead(row["section"], None, row["text"])) <= max_tokens:
                held.append(row)
                continue
            room = max(8, max_tokens - _tokens(" ".join(p for p in (row["section"], row["title"]) if p)) - 4)
            parts = list(_pieces(row["text"], room))
            if least_tail and len(parts) > 1 and _tokens(parts[-1]) < least_tail:
                parts[-2:] = ["\n".join(parts[-2:])]
            for n, body in enumerate(parts, 1):
                if overlap_words and n > 1:
                    body = " ".join(parts[n - 2].split()[-overlap_words:]) + "\n" + body
                emit([row], lead(row["section"], row["title"], body), True, n, "oversize")
        flush()
        if blocks:
            pack(blocks)
        return out

    wanted = ["unit", "section", "title", "number", "page", "unit_type", "text"]
    alone = F.col("alone") if "alone" in units.columns else F.lit(False)
    one = F.struct(*(F.col(c).cast("int").alias(c) if c == "page" else F.col(c) for c in wanted), alone.alias("alone"))
    # a document is a row, so a task takes many without a group of its own for each
    per = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("units"))
    kind, arrow = f"array<struct<{', '.join(CHUNK_FIELDS)}>>", pa.list_(pa.struct([(f.split(" ")[0], ARROW[f.split(" ")[1]]) for f in CHUNK_FIELDS]))
    cut = column_of(lambda documents: [chunks(d) for d in documents], kind, arrow)
    return per.select("doc_id", F.explode(cut("units")).alias("c")).select("doc_id", "c.*")


# the chunkers


def chunk_docx(items: DataFrame, max_tokens: int, min_tokens: int = 0, drop_toc: bool = True, toc_mode: str | None = None) -> DataFrame:
    """Chunks by major section (the first heading of the path, or a line that looks
    like one where no item of the document has a path), procedures within.

    ``drop_toc``: lines that end in leaders or tabs and a page number go; ``toc_mode`` is
    ``blocks.without_toc``'s, in its place."""
    lines = lines_of(items)
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("pos")
    pathless = ~F.coalesce(F.bool_or(F.size("heading_path") > 0).over(doc), F.lit(False))
    inferred = F.last(F.when(is_major_heading(F.col("line")), strip_ws(F.col("line"))), ignorenulls=True).over(order)
    lines = lines.withColumn("section", F.when(pathless, inferred).otherwise(F.try_element_at("heading_path", F.lit(1))))
    repeats = F.count("*").over(Window.partitionBy("doc_id", F.rtrim("line")))
    lines = lines.withColumn("_n", repeats).where(~((F.col("_n") > 1) & is_boilerplate(F.col("line"))))
    if toc_mode is not None:
        lines = without_toc(lines, ["doc_id"], ["pos"], toc_mode)
    elif drop_toc:
        lines = lines.where(~F.col("line").rlike(rf"{TOC_LEADER}|{TOC_TAB}"))
    title = is_procedure_title(F.col("line"))
    changed = ~F.col("section").eqNullSafe(F.lag("section").over(order))
    titled = F.bool_or(title).over(Window.partitionBy("doc_id", "section"))
    alone = is_title_like(F.col("line")) | is_numbered_heading(F.col("line")) | is_list_item(F.col("line"))
    lines = lines.withColumn("alone", alone).withColumn("titled", titled)
    block = F.col("alone") | F.coalesce(F.lag(F.col("alone") | (strip_ws(F.col("line")) == "")).over(order), F.lit(False))
    lines = lines.withColumn("starts", F.when(F.col("titled"), title).otherwise(block) | changed)
    lines = lines.withColumn("title", F.when(title, strip_ws(F.col("line")))).withColumn("number", section_number(F.col("line"))).withColumn("unit_type", F.when(F.col("titled"), "procedure").otherwise("block"))
    lines = lines.withColumn("alone", F.col("alone") & ~is_list_item(F.col("line")))
    units = joined_units(lines, F.col("starts"), ["section", "title", "number", "page", "unit_type", "alone"])
    return fill(units, max_tokens, min_tokens)


# Words of a heading, and the share of a page's lines beyond which headings are overused
PDF_HEADING_WORDS, PDF_HEADING_SHARE = 12, 0.2


def chunk_pdf(pages: DataFrame, max_tokens: int, min_tokens: int = 0, toc_pages: int = 5, overlap_words: int = 0, least_tail: int = 20) -> DataFrame:
    """Chunks of pages: lines that repeat over pages and tables of contents go, wrapped
    lines join to paragraphs, headings part units unless a page has too many.

    A table of contents is the region that an anchor opens, on the first ``toc_pages`` pages, and
    lines with leaders anywhere. Numbered lines are headings on any page."""
    lines = toc_flags(lines_of(pages).withColumn("line", strip_ws(F.col("line"))).where("line <> ''"), ["doc_id", "item_idx"], ["line_no"])
    count = pages.groupBy("doc_id").agg(F.count("*").alias("_pages"))
    per = lines.where(F.char_length("line") <= 120).groupBy("doc_id", "line").agg(F.count("*").alias("_n"))
    repeated = per.join(count, "doc_id").where((F.col("_n") >= 2) & (F.col("_n") >= F.floor(F.col("_pages") * 0.6))).select("doc_id", "line")
    lines = lines.join(repeated, ["doc_id", "line"], "left_anti")
    lines = lines.where(~is_toc_line(F.col("line")) & ~(F.col("toc") & (F.coalesce("page", F.lit(0)) <= toc_pages)))
    page = Window.partitionBy("doc_id", "item_idx")
    titled = is_title_like(F.col("line"), PDF_HEADING_WORDS)
    overused = F.count_if(titled).over(page) / F.count("*").over(page) > PDF_HEADING_SHARE
    lines = lines.withColumn("heading", is_numbered_heading(F.col("line")) | (titled & ~overused & ~is_list_item(F.col("line"))))
    lines = lines.withColumn("section", F.coalesce(F.last(F.when(F.col("heading"), F.col("line")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos")), current_heading(F.col("section_heading"), F.col("heading_path"))))
    first = F.row_number().over(page.orderBy("pos")) == 1
    lines = lines.withColumn("starts", F.col("heading") | first).withColumn("bullet", is_list_item(F.col("line")) & ~F.col("heading"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    # a line that goes on from the one before is joined by a space, others by a line feed
    joined = F.when(F.col("starts") | F.col("bullet") | F.lag("heading").over(order) | F.lag("bullet").over(order), F.lit("\n")).otherwise(F.lit(" "))
    lines = lines.withColumn("glue", joined).withColumn("title", F.lit(None).cast("string")).withColumn("number", section_number(F.col("line")))
    lines = lines.withColumn("unit", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "glue", "line"))), lambda x: F.concat(x["glue"], x["line"])), "")
    keep = ["section", "title", "number", "page", "bullet"]
    units = lines.groupBy("doc_id", "unit").agg(strip_ws(text).alias("text"), F.min_by(F.struct(*keep), "pos").alias("_k")).select("doc_id", "unit", "text", *(F.col(f"_k.{c}").alias(c) for c in keep))
    return fill(units.withColumn("unit_type", F.when(F.col("bullet"), "list").otherwise("paragraph")), max_tokens, min_tokens, least_tail, overlap_words)


def chunk_sections(items: DataFrame, max_tokens: int, figures: bool = True, figure_chunks: bool = False) -> DataFrame:
    """Chunks by headings of level 1, each sub-section of the next level a unit, led by
    Procedure, Section and Path lines; figures stand inline as ``[FIGURE:id]``."""
    rows = with_default_columns(items)
    order = Window.partitionBy("doc_id").orderBy("item_idx")
    path = F.coalesce("heading_path", F.array().cast("array<string>"))
    major = F.last(F.when(F.col("heading_level") == 1, current_heading(F.col("section_heading"), path)), ignorenulls=True).over(order)
    sub = F.when(F.size(path) >= 2, F.element_at(path, 2))
    is_figure = F.coalesce(F.col("block_type") == "image", F.lit(False))
    body = F.when(is_figure, F.concat(F.lit("[FIGURE:"), F.coalesce("figure_id", F.col("text")), F.lit("]"))).otherwise(F.col("text"))
    rows = rows.withColumn("major", F.coalesce(major, F.try_element_at(path, F.lit(1)))).withColumn("sub", sub).withColumn("body", body)
    if not figures:
        rows = rows.where(~is_figure)
    changed = ~F.struct("major", "sub").eqNullSafe(F.lag(F.struct("major", "sub")).over(order))
    rows = rows.withColumn("unit", F.sum(F.when(changed, 1).otherwise(0)).over(order))
    per = rows.groupBy("doc_id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "body"))), lambda x: x["body"]), "\n").alias("text"), F.min_by(F.struct("major", "sub", path.alias("path"), "page"), "item_idx").alias("k"))
    named = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    header = F.concat_ws("\n", named("Procedure", F.col("k.major")), named("Section", F.col("k.sub")), named("Path", F.array_join("k.path", " > ")))
    units = per.select("doc_id", "unit", "text", header.alias("section"), F.lit(None).cast("string").alias("title"), section_number(F.col("k.sub")).alias("number"), F.col("k.page").cast("int").alias("page"), F.lit("section").alias("unit_type"))
    out = fill(units, max_tokens)
    if not figure_chunks:
        return out
    # a chunk for each figure, linked to the chunk that holds its mark
    marks = out.select("doc_id", F.col("chunk_seq").alias("parent_seq"), F.explode(F.regexp_extract_all("text", F.lit(r"\[FIGURE:([^\]]+)\]"), F.lit(1))).alias("figure_id"))
    owner = marks.groupBy("doc_id", "figure_id").agg(F.min("parent_seq").alias("parent_seq"))
    own = items.where("block_type = 'image'").select("doc_id", F.coalesce("figure_id", "text").alias("figure_id"), "text")
    return out.withColumn("figure_id", F.lit(None).cast("string")).withColumn("parent_seq", F.lit(None).cast("int")).unionByName(own.join(owner, ["doc_id", "figure_id"], "left").withColumn("unit_type", F.lit("figure")), allowMissingColumns=True)
