"""Metadata of items, configuration files, lines of tables of contents."""

import pytest
from pyspark.sql import functions as F

from loam.functions import config, text
from loam.operators import blocks, structured
from loam.sources import manifest


def test_normalized_items(spark):
    rows = [
        ("a", "docs/./x/../a.PDF", None, "", 3, None),
        ("b", "/abs/b.bin", "text/markdown", "en", None, None),
        ("c", "s3://bucket/c.html", "TEXT/HTML", None, None, "Top > In"),
        ("d", None, "text/plain", None, None, None),
        ("e", "e.pdf", "nonsense/type", None, None, None),
        ("f", "../../f.docx", None, None, None, None),
    ]
    items = spark.createDataFrame(rows, "id string, source string, content_type string, lang string, page int, section_path string")
    good, bad = manifest.normalized(items, "/base")
    got = {r.id: (r.source, r.content_type, r.lang, r.has_ocr, r.chunk_id) for r in good.collect()}
    assert got == {
        "a": ("/base/docs/a.PDF", "pdf", None, False, None),
        "b": ("/abs/b.bin", "txt", "en", None, None),
        "c": ("s3://bucket/c.html", "html", None, None, None),
        "f": ("/f.docx", "docx", None, None, None),
    }
    assert {r.id: r.error for r in bad.collect()} == {"d": "source is required", "e": "page is required"}
    assert manifest.normalized(items.limit(0))[0].count() == 0


def test_configuration_order(tmp_path, monkeypatch):
    (tmp_path / "fall").mkdir()
    (tmp_path / "fall/app.json").write_text('{"from": "fallback", "key": "${NAME}"}')
    (tmp_path / "own.json").write_text('{"from": "override"}')
    (tmp_path / "confpack").mkdir()
    (tmp_path / "confpack/__init__.py").write_text("")
    monkeypatch.syspath_prepend(str(tmp_path))
    load = lambda env, **more: config.load_config("APP", "app.json", env=env, root=tmp_path, **more)
    fall = tmp_path / "fall"
    assert load({"NAME": "n"}, fallback=fall) == {"from": "fallback", "key": "n"}
    assert load({}, package="confpack", fallback=fall)["from"] == "fallback"  # the package has no such file
    (tmp_path / "confpack/app.json").write_text('{"from": "package"}')
    assert load({}, package="confpack", fallback=fall) == {"from": "package"}
    assert load({"APP": "own.json"}, package="confpack", fallback=fall) == {"from": "override"}
    assert load({"APP": str(tmp_path / "own.json")}) == {"from": "override"}
    assert load({}, package="no.such.package", fallback=fall)["from"] == "fallback"
    with pytest.raises(FileNotFoundError):
        load({"APP": "gone.json"}, fallback=fall)
    with pytest.raises(FileNotFoundError):
        load({})
    (tmp_path / "confpack/app.json").write_text("")
    assert load({}, package="confpack") == {}


def test_kinds_of_toc_lines(spark):
    lines = ["Intro ..... 3", "Intro\t\t12", "2.1 Scope of work 14", "abc", "a 1", None, "1Start2 2Middle5 3.1End12", "x" * 170 + " .... 3", "plain words"]
    c = F.col("c")
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, c string").select("k", text.is_toc_line(c).alias("l"), text.is_toc_strict(c).alias("s"), text.is_toc_candidate(c).alias("m"), text.toc_entries(c).alias("n")).orderBy("k").collect()
    assert [r.l for r in rows] == [True, False, False, False, False, None, False, True, False]
    assert [r.s for r in rows] == [True, True, True, False, False, None, False, True, False]
    assert [r.m for r in rows] == [True, True, True, False, False, None, False, False, False]
    assert [r.n for r in rows][6] == 3 and rows[2].n == 1


def test_lines_without_tables_of_contents(spark):
    lines = ["Contents", "Scope 4", "1Start2 2Middle5 3.1End12 and so on", "Real Heading", "body words, 1 of 2; more", "Late entry ..... 9", "2.1 Kept in auto as prose 14 words"]
    frame = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id int, pos int, line string")
    kept = lambda mode: [r.line for r in blocks.without_toc(frame, ["doc_id"], ["pos"], mode).orderBy("pos").collect()]
    assert kept("off") == lines
    assert kept("strict") == [x for x in lines if x != "Late entry ..... 9"]
    assert kept("auto") == ["Real Heading", "body words, 1 of 2; more", "2.1 Kept in auto as prose 14 words"]
    with pytest.raises(ValueError):
        kept("else")
    items = spark.createDataFrame([("d", 0, "\n".join(lines))], "doc_id string, item_idx int, text string")
    everything = "\n".join(r.text for r in structured.chunk_docx(items, 200, toc_mode="auto").collect())
    assert "Real Heading" in everything and "Late entry" not in everything and "Middle" not in everything


def test_entries_of_a_store(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.md"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    entries = [{"path": "*.txt", "lang": "en"}, {"path": "c.md"}, {"path": "gone.txt"}, {"path": "sub"}]
    got = manifest.expand_in_store(spark, entries, f"file://{tmp_path}")
    assert [(e["path"].rsplit("/", 1)[1], e.get("lang")) for e in got] == [("a.txt", "en"), ("b.txt", "en"), ("c.md", None)]
    with pytest.raises(ValueError):
        manifest.expand_in_store(spark, [{}], str(tmp_path))


def test_type_of_a_zip_with_a_long_tail(spark):
    entry = b"PK\x01\x02" + b"\x00" * 42 + b"word/document.xml"
    head = b"PK\x03\x04" + b"\x00" * 100_000
    rows = [("a.bin", bytearray(head + entry)), ("b.xlsx", bytearray(head + entry + b"\x00" * 70_000)), ("c.zip", bytearray(b"PK\x03\x04 short"))]
    frame = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r.t for r in frame.select("path", manifest.sniffed_type(F.col("content"), F.col("path")).alias("t")).collect()}
    assert got["a.bin"].endswith("wordprocessingml.document") and got["b.xlsx"].endswith("spreadsheetml.sheet") and got["c.zip"] == "application/zip"
