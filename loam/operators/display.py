"""What an answer needs before it is shown: all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.text import strip_ws

ANSWER = "answer string, answer2 string, answer3 string, mode string, question string"


def selected_answer(*answers: Column, names: tuple[str, ...] = ("answer", "answer2", "answer3")) -> Column:
    """struct<text, field>: the first answer that is not blank, else null and ``none``."""
    text, field = None, None
    for a, n in zip(answers, names):
        filled = strip_ws(F.coalesce(a, F.lit(""))) != ""
        text = F.when(filled, a) if text is None else text.when(filled, a)
        field = F.when(filled, F.lit(n)) if field is None else field.when(filled, F.lit(n))
    return F.struct(text.alias("text"), field.otherwise("none").alias("field"))


def coerced_response(raw: Column) -> Column:
    """One shape for a reply: a JSON object, one below ``response`` (as an object or as
    a JSON text), or plain text, which becomes the answer."""
    inner = F.get_json_object(raw, "$.response")
    body = F.coalesce(inner, raw)
    parsed = F.from_json(body, ANSWER)
    is_object = F.get_json_object(body, "$").isNotNull() & F.trim(body).startswith("{")
    plain = F.struct(body.alias("answer"), *(F.lit(None).cast("string").alias(n) for n in ("answer2", "answer3", "mode", "question")))
    filled = F.struct(F.coalesce(parsed["answer"], F.lit("")).alias("answer"), *(parsed[n].alias(n) for n in ("answer2", "answer3", "mode", "question")))
    return F.when(is_object, filled).otherwise(plain)


def without_figure_labels(answer: Column) -> Column:
    """Without blocks from a figure label's line to the next blank line."""
    label = r"(?i)^\s*(related figure\(s\):|figure\(s\):|see images?:)"
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def step(s: Column, line: Column) -> Column:
        blank = strip_ws(line) == ""
        begins = ~s["skip"] & line.rlike(label)
        drop = s["skip"] | begins
        return F.struct(F.when(drop, s["kept"]).otherwise(F.concat(s["kept"], F.array(line))).alias("kept"), F.when(begins, True).when(s["skip"] & blank, False).otherwise(s["skip"]).alias("skip"))

    return F.aggregate(F.split(F.coalesce(answer, F.lit("")), "\n", -1), start, step, lambda s: F.array_join(s["kept"], "\n"))


def _parts(text: Column, pattern: str, kind: str, inner: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(inner))
    around = F.split(text, pattern, -1)
    pairs = F.transform(around, lambda t, i: F.array(F.struct(F.lit("text").alias("kind"), t.alias("value")), F.struct(F.lit(kind).alias("kind"), F.try_element_at(found, i + 1).alias("value"))))
    return F.filter(F.flatten(pairs), lambda p: p["value"].isNotNull() & ((p["kind"] != "text") | (p["value"] != "")))


def split_by_figures(answer: Column) -> Column:
    """array<struct<kind, value>>: texts and the ids of figures between them."""
    return F.transform(_parts(F.coalesce(answer, F.lit("")), r"\[FIGURE:([^\]]+)\]", "figure", 1), lambda p: F.struct(p["kind"].alias("kind"), F.when(p["kind"] == "figure", F.trim(p["value"])).otherwise(p["value"]).alias("value")))


def split_fenced(answer: Column) -> Column:
    """array<struct<kind, value>>: texts and fenced blocks of code."""
    return _parts(F.coalesce(answer, F.lit("")), r"(?s)```.*?```", "code", 0)


def image_refs(metas: Column) -> Column:
    """Distinct relative image references, in order, of figures or whatever has one.

    ``metas``: array<struct<chunk_type, figure_id, image_ref>>
    """
    usable = F.filter(metas, lambda m: m["image_ref"].isNotNull() & (strip_ws(m["image_ref"]) != "") & ~strip_ws(m["image_ref"]).startswith("/"))
    return F.array_distinct(F.transform(usable, lambda m: strip_ws(m["image_ref"])))


def figure_map(metas: Column) -> Column:
    """figure_id to image_ref; the first of each id counts."""
    good = F.filter(metas, lambda m: (F.lower(m["chunk_type"]) == "figure") & (strip_ws(m["figure_id"]) != "") & (strip_ws(m["image_ref"]) != "") & ~strip_ws(m["image_ref"]).startswith("/"))
    ids = F.array_distinct(F.transform(good, lambda m: strip_ws(m["figure_id"])))
    return F.map_from_arrays(ids, F.transform(ids, lambda i: strip_ws(F.element_at(F.filter(good, lambda m: strip_ws(m["figure_id"]) == i), 1)["image_ref"])))


def snippet(text: Column, length: int = 320) -> Column:
    return F.substring(text, 1, length)


def preview(text: Column, length: int = 400) -> Column:
    return F.translate(F.substring(text, 1, length), "\n", " ")
