"""Packing of blocks of lines into chunks of a token budget.

Which lines make a block are running values over lines; the greedy filling, whose every
step depends on the one before, runs in Python on the blocks of one section.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import strip_ws

PARTS = "array<struct<text:string,is_split:boolean,split_reason:string,split_part:int>>"


def tokens(text: str) -> int:
    """A quarter of the characters, half to even."""
    return round(len(text) / 4)


def sentence_parts(text: str, most: int) -> list[str]:
    """Parts of up to ``most`` tokens at ends of sentences, or of words where a sentence is
    longer; no word is lost, and a word alone may be longer."""
    units: list[str] = []
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        units += [s] if tokens(s) <= most else s.split()
    out: list[str] = []
    held = ""
    for u in units:
        joined = f"{held} {u}" if held else u
        if held and tokens(joined) > most:
            out.append(held)
            held = u
        else:
            held = joined
    return out + [held] if held else out


def parts_under_heading(text: str, most: int, heading: str = "", sub_heading: str = "", overlap: int = 0, least: int = 0) -> list[str]:
    """Sentence parts that the heading and sub-heading lead; below them the last ``overlap``
    words of the part before. A part of fewer than ``least`` tokens joins the one before."""
    out: list[str] = []
    before: list[str] = []
    for body in sentence_parts(text, most):
        own = f"{' '.join(before[-overlap:])}\n{body}" if overlap and before else body
        before = body.split()
        heads = [h for h in (heading.strip(), sub_heading.strip()) if h and not own.startswith(h)]
        whole = "\n".join([*heads, own])
        if least and out and tokens(whole) < least:
            out[-1] = f"{out[-1]}\n{own}"
        else:
            out.append(whole)
    return out


def split_block(text: str, heading: bool, most: int, overlap: int = 0) -> list[str]:
    """The parts of a block over the budget. Where its first line is a heading, that leads
    each part; a first part of one line goes in front of the second."""
    first, _, rest = text.partition("\n")
    parts = parts_under_heading(rest, most, first, overlap=overlap) if heading and rest.strip() else parts_under_heading(text, most, overlap=overlap)
    if len(parts) > 1 and "\n" not in parts[0]:
        parts[:2] = ["\n".join(parts[:2])]
    return parts


def filled(blocks: list[tuple[str, bool]], most: int, overlap: int = 0) -> list[dict]:
    """Blocks (text, whether it begins with a heading) in order, as many to a chunk as fit;
    a block of the budget or more is split and stands alone, led in each part by the heading
    right before it."""
    out: list[dict] = []
    held: list[str] = []
    size = 0
    lead: str | None = None

    def emit(text: str, reason: str | None) -> None:
        out.append({"text": text, "is_split": bool(reason or out), "split_reason": reason or ("max_tokens" if out else None), "split_part": len(out) + 1})

    for text, heading in blocks:
        n = tokens(text)
        if n >= most and lead is not None and "\n" not in lead:
            held.pop()
            text, heading = f"{lead}\n{text}", True
        lead = text if heading and n < most else None
        if held and (n >= most or size + n > most):
            emit("\n".join(held), None)
            held, size = [], 0
        if n >= most:
            for part in split_block(text, heading, most, overlap):
                emit(part, "oversize_block")
            continue
        held.append(text)
        size += n
    if held:
        emit("\n".join(held), None)
    return out


def merged_forward(chunks: list[dict]) -> list[dict]:
    """A chunk of one line goes in front of the next one, which may be one that took one
    in; the last stays. Chunks of a section that has several are all split."""
    out: list[dict] = []
    for k, c in enumerate(chunks):
        if out and out[-1].pop("open", False):
            lone = out.pop()
            c = c | {"text": f"{lone['text'].strip()}\n{c['text'].strip()}".strip(), "is_split": True, "split_reason": c["split_reason"] or lone["split_reason"] or "max_tokens"}
        lines = sum(1 for line in c["text"].splitlines() if line.strip())
        out.append(c | ({"open": True} if lines <= 1 and k + 1 < len(chunks) else {}))
    several = len(out) > 1
    return [c | {"is_split": c["is_split"] or several, "split_reason": c["split_reason"] if several else None} for c in out]


def block_lines(lines: DataFrame, alone: Column, by: list[str], pos: str = "pos", line: str = "line") -> DataFrame:
    """by, block_no, text, heading: lines that stand ``alone`` are blocks, the others make one
    up to a blank line or one that stands alone."""
    order = Window.partitionBy(*by).orderBy(pos)
    rows = lines.withColumn("_blank", strip_ws(F.col(line)) == "").withColumn("_alone", alone & (strip_ws(F.col(line)) != ""))
    rows = rows.withColumn("_new", F.col("_alone") | F.coalesce(F.lag(F.col("_alone") | F.col("_blank")).over(order), F.lit(True)))
    rows = rows.withColumn("block_no", F.count_if("_new").over(order)).where(~F.col("_blank"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, line))), lambda x: x[line]), "\n")
    return rows.groupBy(*by, "block_no").agg(text.alias("text"), F.bool_or("_alone").alias("heading"))


def pack(blocks: DataFrame, by: list[str], max_tokens: int, overlap: int = 0, merge: bool = True) -> DataFrame:
    """by, part_seq, text, is_split, split_reason, split_part from by, block_no, text, heading.

    Null and blank texts are no blocks. A section's blocks are one array, bounded by its text.
    """

    @F.pandas_udf(PARTS)
    def run(sections: pd.Series) -> pd.Series:
        out = []
        for s in sections:
            chunks = filled([(b["text"], bool(b["heading"])) for b in s], max_tokens, overlap)
            out.append(merged_forward(chunks) if merge else chunks)
        return pd.Series(out)

    whole = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text", "heading"))), lambda b: F.struct(b["text"].alias("text"), b["heading"].alias("heading")))
    per = blocks.where(strip_ws(F.col("text")) != "").groupBy(*by).agg(whole.alias("blocks"))
    return per.select(*by, F.posexplode(run("blocks")).alias("part_seq", "c")).select(*by, (F.col("part_seq") + 1).alias("part_seq"), "c.*")


def split_with_heading(rows: DataFrame, max_tokens: int, overlap: int = 0, least: int = 0) -> DataFrame:
    """rows (text, heading, sub_heading and others) with a row for each part: part_seq and text."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series, heading: pd.Series, sub: pd.Series) -> pd.Series:
        return pd.Series([parts_under_heading(t or "", max_tokens, h or "", s or "", overlap, least) for t, h, s in zip(text, heading, sub)])

    others = [c for c in rows.columns if c != "text"]
    return rows.select(*others, F.posexplode(run("text", "heading", "sub_heading")).alias("part_seq", "text")).withColumn("part_seq", F.col("part_seq") + 1)
