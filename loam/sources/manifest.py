"""Manifests, golden queries, JSON tables, and the sniffing of file types."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, doc_id string, profile string, tags array<string>, lang string, priority int, metadata map<string,string>"
GOLDEN = "query_id long, query string, expect_doc_ids array<string>, expect_phrases array<string>, top_k int"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines manifest, with all fields; the stem of the file is
    the doc_id where none is given.

    Blank lines are skipped; a line that is no object, or has no path, is an error
    that names it. Paths are taken from the manifest's folder.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ENTRY).add("_corrupt", "string")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    base = os.path.dirname(path)
    rows = rows.withColumn("path", F.when(F.col("_corrupt").isNotNull() | F.col("path").isNull() | (F.trim("path") == ""), F.raise_error(F.concat(F.lit("manifest line without a path or not an object: "), F.coalesce("_corrupt", F.lit("{}")))).cast("string")).otherwise(F.col("path")))
    absolute = F.when(F.col("path").rlike(r"^(/|[a-z0-9]+:/)"), F.col("path")).otherwise(F.concat(F.lit(f"{base}/"), F.col("path")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.withColumn("path", absolute).withColumn("doc_id", F.coalesce("doc_id", stem)).drop("_corrupt")


def expand(entries: list[dict], base: str) -> list[dict]:
    """Entries with their wild cards expanded, sorted, once each; missing files go."""
    out = []
    for e in entries:
        if not isinstance(e, dict) or not e.get("path"):
            raise ValueError("a manifest entry needs a path")
        path = os.path.join(base, e["path"])
        found = sorted(set(glob.glob(path, recursive=True))) if any(x in path for x in "*?[") else [path]
        out += [e | {"path": f} for f in found if os.path.isfile(f)]
    return out


def expand_in_store(spark: SparkSession, entries: list[dict], base: str) -> list[dict]:
    """As ``expand``, in whatever store the paths name: wild cards are the store's own, which do
    not reach into deeper folders."""
    sc, out = spark.sparkContext, []
    for e in entries:
        if not isinstance(e, dict) or not e.get("path"):
            raise ValueError("a manifest entry needs a path")
        path = e["path"] if "://" in e["path"] or e["path"].startswith("/") else f"{base.rstrip('/')}/{e['path']}"
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        found = target.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(target) or []
        out += [e | {"path": p} for p in sorted({f.getPath().toString() for f in found if f.isFile()})]
    return out


def parse_manifest(text: str) -> list[dict]:
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        try:
            entry = json.loads(line)
        except ValueError as e:
            raise ValueError(f"line {n}: {e}") from e
        if not isinstance(entry, dict) or not entry.get("path"):
            raise ValueError(f"line {n}: an object with a path is needed")
        out.append(entry)
    return out


def golden_queries(spark: SparkSession, parsed: list | dict | None) -> DataFrame:
    """Golden queries from parsed YAML or JSON: a list, or an object with ``queries``."""
    rows = parsed.get("queries") if isinstance(parsed, dict) else parsed
    if not rows:
        raise ValueError("no golden queries")
    many = lambda x: [] if x is None else [str(v) for v in x] if isinstance(x, list) else [str(x)]
    out = []
    for n, r in enumerate(rows):
        k = r.get("top_k")
        if k is not None and (not isinstance(k, int) or isinstance(k, bool) or k < 1):
            raise ValueError(f"top_k of query {n} must be a positive integer")
        out.append((n, str(r["query"]), many(r.get("expect_doc_ids", r.get("doc_ids"))), many(r.get("expect_phrases", r.get("phrases"))), k))
    return spark.createDataFrame(out, GOLDEN)


def read_json_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON array of rows; a file that cannot be read as one gives no rows."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    key = schema.names[0]
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where(F.col(key).isNotNull())


#: Bytes at the end of a zip file in which its directory is looked for.
DIRECTORY = 1 << 16


def sniffed_type(content: Column, path: Column) -> Column:
    """The media type by first bytes, then by extension. Zip files tell their kind by
    the member names in their directory."""
    from loam.operators.dedup import MEDIA_TYPES

    head = F.substring(content, 1, 4096).cast("string")
    start = F.substring(content, 1, 4)
    # the directory stands at the end; one of more than this many bytes is told by extension
    tail = F.decode(F.substring(content, -DIRECTORY, DIRECTORY), "ISO-8859-1")
    low = F.lower(head)
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_name = F.try_element_at(F.create_map(*(F.lit(x) for p in MEDIA_TYPES.items() for x in p)), extension)
    # an entry of the directory has its member's name 46 bytes after its mark
    member = lambda folder: tail.rlike(rf"(?s)PK\x01\x02.{{42}}{folder}/")
    office = F.when(member("word"), MEDIA_TYPES["docx"]).when(member("ppt"), MEDIA_TYPES["pptx"]).when(member("xl"), MEDIA_TYPES["xlsx"]).when((F.length(content) > DIRECTORY) & by_name.isNotNull(), by_name).otherwise("application/zip")
    printable = F.substring(content, 1, 128).cast("string").rlike(r"\A[\t\n\r\x20-\x7E]+\z")
    return (
        F.when(start == F.lit(b"%PDF"), MEDIA_TYPES["pdf"])
        .when(start == F.lit(b"PK\x03\x04"), office)
        .when(low.contains("<html") | low.contains("<!doctype html"), MEDIA_TYPES["html"])
        .when(printable, MEDIA_TYPES["txt"])
        .otherwise(F.coalesce(by_name, F.lit("application/octet-stream")))
    )


def content_bucket(content_type: Column) -> Column:
    """The short name of a media type, or null."""
    c = F.lower(content_type)
    return (
        F.when(c.contains("pdf"), "pdf")
        .when(c.contains("presentation") | c.contains("ppt"), "pptx")
        .when(c.contains("spreadsheet") | c.contains("xlsx"), "xlsx")
        .when(c.contains("html"), "html")
        .when(c.contains("wordprocessingml") | c.contains("docx"), "docx")
        .when(c.contains("plain") | c.contains("markdown") | c.contains("txt"), "txt")
    )


def loader_of(path: Column) -> Column:
    """The loader by extension; anything unknown is text."""
    e = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(e.isin("pdf", "docx", "pptx", "xlsx"), e).when(e.isin("html", "htm"), "html").otherwise("txt")


#: What each kind of item must carry.
REQUIRED = {"pdf": ["page"], "pptx": ["slide_number"], "xlsx": ["sheet_name", "n_rows", "n_cols"], "html": ["section_path"]}


def item_error(columns: list[str]) -> Column:
    """What is wrong with an item, or null."""
    bucket = content_bucket(F.col("content_type"))
    error = F.when(F.coalesce("source", F.lit("")) == "", "missing source").when(bucket.isNull(), "unknown content type")
    for kind, fields in REQUIRED.items():
        for f in fields:
            if f in columns:
                error = error.when((bucket == kind) & F.col(f).isNull(), f"missing {f}")
    return error


def split_valid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a source and the fields of their kind, and the others with ``error``."""
    marked = items.withColumn("error", item_error(items.columns))
    return marked.where("error is null").drop("error"), marked.where("error is not null")


# Media types and their short names.
TYPES = {"pdf", "docx", "pptx", "xlsx", "html", "txt"}
SHORT = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/html": "html",
    "text/plain": "txt",
    "text/markdown": "txt",
}


def type_token(content_type: Column, source: Column) -> Column:
    """The short name of a media type or short name, else that of the source's extension."""
    low = F.lower(content_type)
    names = F.create_map(*(F.lit(x) for pair in SHORT.items() for x in pair))
    named = F.coalesce(F.try_element_at(names, low), F.when(low.isin(*sorted(TYPES)), low))
    return F.coalesce(named, loader_of(source))


def absolute(source: Column, root: str) -> Column:
    """A path or address as it stands if it is absolute, else below ``root``; without the steps
    ``.`` and ``..``."""
    whole = F.when(source.startswith("/"), source).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), source))
    steps = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda held, x: F.when(x != "..", F.concat(held, F.array(x))).otherwise(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))))
    return F.when(source.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), source).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def normalized(items: DataFrame, root: str = "/") -> tuple[DataFrame, DataFrame]:
    """Items with an absolute source, the short name of their type, and defaults (``chunk_id`` and
    ``lang`` null, ``has_ocr`` and ``has_notes`` false); and those with ``error`` that lack a
    source or a field that their type needs."""
    rows = items
    for name, kind in {"source": "string", "content_type": "string", "lang": "string", "chunk_id": "string", "has_ocr": "boolean", "has_notes": "boolean", "page": "int", "slide_number": "int", "sheet_name": "string", "n_rows": "int", "n_cols": "int", "section_path": "string"}.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    token = type_token(F.col("content_type"), F.coalesce("source", F.lit("")))
    error = F.when(F.col("source").isNull(), "source is required")
    for kind, fields in REQUIRED.items():
        for f in fields:
            error = error.when((token == kind) & F.col(f).isNull(), f"{f} is required")
    marked = rows.withColumns(
        {
            "error": error,
            "content_type": token,
            "lang": F.nullif("lang", F.lit("")),
            "has_ocr": F.when(token == "pdf", F.coalesce("has_ocr", F.lit(False))).otherwise(F.col("has_ocr")),
            "has_notes": F.when(token == "pptx", F.coalesce("has_notes", F.lit(False))).otherwise(F.col("has_notes")),
        }
    )
    return marked.where("error is null").drop("error").withColumn("source", absolute(F.col("source"), root)), marked.where("error is not null")
