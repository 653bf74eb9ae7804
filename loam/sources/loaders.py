"""File loaders: a row for each file in, a row for each item out.

Files are read by Spark (``binaryFile``), so any store will do; each kind has a
small parser of one file's bytes that runs inside ``mapInPandas``. PDF text comes
from an extractor that the caller gives, a function from bytes to pages.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import cleaned, collapse_ws, nonempty, strip_ws
from loam.sources.manifest import loader_of

ITEM = "path string, item_idx int, text string, content_type string, section_path string, slide_number int, has_notes boolean, sheet_name string, n_rows int, n_cols int, page int, has_ocr boolean, block_type string, section_heading string, heading_path array<string>, heading_level int, figure_no int, figure_id string, image_ref string, image_sha256 string, image binary"
FIELDS = [f.strip().split(" ")[0] for f in ITEM.split(", ")]
Parser = Callable[[bytes], Iterator[dict]]

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


HEADINGS = ("h1", "h2")


class _Events(HTMLParser):
    """A page's tags and texts, in order."""

    def __init__(self) -> None:
        super().__init__()
        self.seen: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen.append(("open", tag))

    def handle_endtag(self, tag: str) -> None:
        self.seen.append(("close", tag))

    def handle_data(self, data: str) -> None:
        self.seen.append(("text", data))


def html_sections(page: str) -> list[tuple[str, str]]:
    """(path, text) of each stretch of a page that h1 and h2 tags open.

    The path of a stretch names all such tags up to it. A page without text between
    tags is one stretch, with white space collapsed.
    """
    scan = _Events()
    scan.feed(page)
    scan.close()
    opens = [kind == "open" and value in HEADINGS for kind, value in scan.seen]
    tags = [value for (_, value), new in zip(scan.seen, opens) if new]
    parts: dict[int, list[str]] = {}
    for number, (kind, value) in zip(accumulate(opens), scan.seen):
        if kind == "text" and value.strip():
            parts.setdefault(number, []).append(value)
        elif kind == "close" and value in HEADINGS:
            parts.setdefault(number, []).append("\n")
    texts = {number: " ".join(held).replace("\r", "\n").strip() for number, held in parts.items()}
    return [(">".join(tags[:number]), t) for number, t in texts.items() if t] or [("", " ".join(page.split()))]


def parse_html(raw: bytes) -> Iterator[dict]:
    for path, text in html_sections(raw.decode("utf-8", "replace")):
        yield {"text": text, "content_type": "text/html", "section_path": path}


def _slide_number(name: str) -> int:
    m = re.search(r"slide(\d+)\.xml$", name)
    return int(m[1]) if m else -1


def _runs(xml: bytes) -> list[str]:
    return [t.text for t in ElementTree.fromstring(xml).iter(f"{A}t") if t.text]


def parse_pptx(raw: bytes) -> Iterator[dict]:
    """One item a slide, in the order of names; notes follow the slide's text after an
    empty line, so that cleaning keeps or drops each by itself."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        for name in sorted(n for n in names if re.fullmatch(r"ppt/slides/slide[^/]*\.xml", n)):
            text = "\n".join(_runs(z.read(name)))
            n = _slide_number(name)
            notes_name = f"ppt/notesSlides/notesSlide{n}.xml"
            notes = "\n".join(_runs(z.read(notes_name))) if notes_name in names else ""
            spoken = f"Notes:\n{notes}" if notes.strip() else ""
            yield {"text": "\n\n".join(x for x in (text, spoken) if x), "content_type": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "slide_number": n, "has_notes": bool(spoken)}


def cell_range(ref: str) -> tuple[int, int]:
    """Rows and columns up to the last cell of a range such as A1:C10."""
    last = ref.split(":")[-1]
    letters, digits = re.sub(r"[^A-Za-z]", "", last), re.sub(r"\D", "", last)
    columns = reduce(lambda n, ch: n * 26 + ord(ch) - 64, letters.upper(), 0)
    return int(digits or 0), columns


def parse_xlsx(raw: bytes) -> Iterator[dict]:
    """One summary item a sheet file: its size."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        ElementTree.fromstring(z.read("xl/workbook.xml"))
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet[^/]*\.xml", n)):
            try:
                dimension = ElementTree.fromstring(z.read(name)).find(f".//{S}dimension")
            except ElementTree.ParseError:
                dimension = None
            rows, columns = cell_range(dimension.get("ref") or "") if dimension is not None else (0, 0)
            stem = name.rsplit("/", 1)[1].removesuffix(".xml")
            yield {"text": f"Sheet {stem}: size {rows} x {columns}", "content_type": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "sheet_name": stem, "n_rows": rows, "n_cols": columns}


def _style_level(style: str) -> int | None:
    m = re.fullmatch(r"(?i)(?:heading|t[íi]tulo)\s*(\d)", style)
    return int(m[1]) if m else None


R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
V = "{urn:schemas-microsoft-com:vml}"


def image_parts(z: zipfile.ZipFile, part: str = "word/document.xml") -> dict[str, str]:
    """Relationship id to member name of the images that a part of a package refers to.

    Targets are relative to the part's folder, or absolute in the package, percent-encoded;
    external ones and those outside the package have no member.
    """
    folder, name = posixpath.split(part)
    rels = posixpath.join(folder, "_rels", f"{name}.rels")
    members = set(z.namelist())
    if rels not in members:
        return {}
    found = {}
    for r in ElementTree.fromstring(z.read(rels)):
        if (r.get("Type") or "").endswith("/image") and r.get("TargetMode") != "External":
            target = unquote(r.get("Target") or "")
            path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
            if path in members:
                found[r.get("Id") or ""] = path
    return found


def _fragments(p: ElementTree.Element) -> list[tuple[str, str]]:
    """A paragraph's stretches of text and its images' relationship ids, in order."""
    out: list[tuple[str, str]] = []
    text = ""
    for t in p.iter():
        if t.tag == f"{W}t":
            text += t.text or ""
        elif t.tag == f"{W}tab":
            text += "\t"
        rid = t.get(f"{R}embed") if t.tag == f"{A}blip" else t.get(f"{R}id") if t.tag == f"{V}imagedata" else None
        if rid:
            out += [("text", text), ("image", rid)]
            text = ""
    return [(kind, x.strip()) for kind, x in [*out, ("text", text)] if x.strip()]


def _paragraphs(parent: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs in body order, those of tables' cells too, none within another."""
    for child in parent:
        if child.tag == f"{W}p":
            yield child
        elif child.tag != f"{W}sectPr":
            yield from _paragraphs(child)


def parse_docx(raw: bytes, images: bool = False) -> Iterator[dict]:
    """Paragraphs in body order, tables' cells too, with block types and the path of
    headings that are open; lines of a table of contents are left out.

    ``images``: a picture is an item where it stands, with its bytes; text of its paragraph
    before and after it are items too, of which the first alone is a heading. A picture whose
    part is missing or outside the file is left out.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId") or ""] = (name.get(f"{W}val") or "") if name is not None else ""
        members = image_parts(z) if images else {}
        stack: list[tuple[int, str]] = []
        counters: dict[str, list[int]] = {}
        figures = 0

        def item(text: str, kind: str, **more) -> dict:
            path = [t for n, t in stack if n >= 1]
            return {"text": text, "content_type": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "block_type": kind, "section_heading": path[-1] if path else None, "heading_path": path, "heading_level": stack[-1][0] if stack else None} | more

        for p in _paragraphs(body) if body is not None else ():
            parts = _fragments(p) if images else []
            if not any(kind == "image" for kind, _ in parts):
                text = "".join((t.text or "") if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "" for t in p.iter()).strip()
                parts = [("text", text)] if text else []
            style = p.find(f"{W}pPr/{W}pStyle")
            sid = style.get(f"{W}val") if style is not None else ""
            name = styles.get(sid, "") or sid
            if not parts or name.lower().startswith("toc"):
                continue
            level = _style_level(name)
            numbering = p.find(f"{W}pPr/{W}numPr")
            prefix = ""
            if numbering is not None:
                num = numbering.find(f"{W}numId")
                depth = numbering.find(f"{W}ilvl")
                key = num.get(f"{W}val") if num is not None else ""
                at = int(depth.get(f"{W}val")) if depth is not None else 0
                held = counters.setdefault(key, [])
                held[:] = (held + [0] * (at + 1 - len(held)))[: at + 1]
                held[at] += 1
                prefix = ".".join(map(str, held))
            kind = "heading" if level is not None else "list" if numbering is not None or "list" in name.lower() else "paragraph"
            for what, x in parts:
                if what == "image":
                    if x in members:
                        figures += 1
                        content = z.read(members[x])
                        yield item("", "image", figure_no=figures, extension=posixpath.splitext(members[x])[1].lower() or ".img", image=content, image_sha256=hashlib.sha256(content).hexdigest())
                elif kind == "heading":
                    title = f"{prefix} {x}".strip() if prefix else x
                    stack = [s for s in stack if s[0] < level] + [(level, title)]
                    yield item(title, kind)
                    kind = "paragraph"
                else:
                    yield item(x, kind)


def parse_docx_with_images(raw: bytes) -> Iterator[dict]:
    return parse_docx(raw, images=True)


PARSERS: dict[str, Parser] = {"html": parse_html, "pptx": parse_pptx, "xlsx": parse_xlsx, "docx": parse_docx}


def pdf_parser(pages: Callable[[bytes], list[str]], ocr: Callable[[bytes, int], str] | None = None, mode: str = "auto", least: int = 50, limit: int | None = None) -> Parser:
    """A parser from an extractor of pages; pages with little text may go to ``ocr``."""

    def parse(raw: bytes) -> Iterator[dict]:
        for n, text in enumerate(pages(raw)[:limit], 1):
            poor = len(text.strip()) < least
            use = ocr is not None and (mode == "force" or (mode == "auto" and poor))
            yield {"text": ocr(raw, n) if use else text, "content_type": "application/pdf", "page": n, "has_ocr": use}

    return parse


def _named_figure(path: str, item: dict) -> dict:
    """A figure's id, which is its text, and its path below the folder of figures."""
    n = item.get("figure_no")
    if n is None:
        return item
    stem = posixpath.splitext(posixpath.basename(path))[0]
    return item | {"text": f"{stem}_img_{n:03d}", "figure_id": f"{stem}_img_{n:03d}", "image_ref": f"{stem}/img_{n:03d}{item['extension']}"}


def figures_of(items: DataFrame) -> DataFrame:
    """doc_id (the file's name), n, extension, content of the images among parsed items, for
    ``sinks.figure_files``."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return items.where("block_type = 'image'").select(name.alias("doc_id"), F.col("figure_no").alias("n"), F.regexp_extract("image_ref", r"\.([^./]+)$", 1).alias("extension"), F.col("image").alias("content"))


def parsed_items(files: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """Raw items of files (path, content, loader) that have a parser; a file that
    fails gives a row with the error as its only field."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content, loader in zip(frame["path"], frame["content"], frame["loader"]):
                try:
                    rows += [{"path": path, "item_idx": k, "error": None} | _named_figure(path, item) for k, item in enumerate(parsers[loader](bytes(content)))]
                except Exception as e:  # noqa: BLE001  any broken file is that file's error
                    rows.append({"path": path, "item_idx": 0, "error": f"{path}: {e}"})
            out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in [*FIELDS, "error"]})
            for c, kind in (("slide_number", "Int32"), ("n_rows", "Int32"), ("n_cols", "Int32"), ("page", "Int32"), ("heading_level", "Int32"), ("figure_no", "Int32"), ("item_idx", "Int32"), ("has_notes", "boolean"), ("has_ocr", "boolean")):
                out[c] = out[c].astype(kind)
            yield out

    return files.where(F.col("loader").isin(*parsers)).select("path", "content", "loader").mapInPandas(run, f"{ITEM}, error string")


def text_items(files: DataFrame, longest: int = 4000) -> DataFrame:
    """Items of text files: cleaned whole, or by paragraph where longer."""
    whole = nonempty(files.where("loader = 'txt'").select("path", F.decode("content", "UTF-8").alias("text")), cleaned(F.col("text")))
    paragraphs = F.transform(F.split("text", r"\n(?:[ \t]*\n)+"), collapse_lines)
    parts = F.when(F.char_length("text") > longest, paragraphs).otherwise(F.array("text"))
    rows = whole.select("path", F.posexplode_outer(parts).alias("item_idx", "text"))
    return nonempty(rows, cleaned(F.col("text"))).withColumn("content_type", F.lit("text/plain"))


def collapse_lines(p):
    return strip_ws(F.regexp_replace(p, r"(?<![ \t])[ \t]*+\n[ \t]*+", " "))


def load_files(spark: SparkSession, paths: list[str], pdf: Parser | None = None, images: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cleaned items of all files, and the errors. ``images``: pictures of documents are items too. Each kind of file is one branch of
    the same scan; branches are put together by name."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content").withColumn("loader", loader_of(F.col("path")))
    parsers = PARSERS | ({"pdf": pdf} if pdf else {}) | ({"docx": parse_docx_with_images} if images else {})
    parsed = parsed_items(files, parsers)
    tables = F.col("content_type").contains("spreadsheet")
    figure = F.col("block_type").eqNullSafe("image")
    good = nonempty(parsed.where(F.col("error").isNull() & ~figure).drop("error"), cleaned(F.col("text"), tables))
    if images:
        good = good.unionByName(parsed.where(F.col("error").isNull() & figure).drop("error"))
    items = good.unionByName(text_items(files), allowMissingColumns=True)
    return items, parsed.where("error is not null").select("path", "error")


def html_page_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, item_idx, section_path, text (raw) of pages that are columns of a table."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, n, path, text) for k, page in zip(frame[key], frame[html]) if page is not None for n, (path, text) in enumerate(html_sections(page))]
            yield pd.DataFrame(rows, columns=[key, "item_idx", "section_path", "text"]).astype({"item_idx": "int32"})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, item_idx int, section_path string, text string")


def html_text(html):
    """Visible text of a page as an expression: no tags, scripts, styles or comments."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return collapse_ws(c)
