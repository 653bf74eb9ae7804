import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loam.operators import dedup
from loam.sources import loaders, manifest, sinks
from loam.streaming import flows

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


def paragraph(text, style=None, num=None):
    p = f'<w:pStyle w:val="{style}"/>' if style else ""
    p += f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{num}"/></w:numPr>' if num else ""
    return f"<w:p><w:pPr>{p}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.html").write_text("<html><p>before all of it</p><h1>First title</h1>some longer text<h2>Second title</h2>more of the text</html>")
    (d / "b.txt").write_text("A plain text of some words.\n\nAnother paragraph of it.")
    (d / "long.txt").write_text("\n\n".join(f"paragraph number {k} with many\nwords in it" for k in range(200)))
    (d / "c.pptx").write_bytes(zipped({"ppt/slides/slide1.xml": f"<s {A}><a:t>Slide one words</a:t></s>", "ppt/slides/slide10.xml": f"<s {A}><a:t>Slide ten words</a:t></s>", "ppt/slides/slide2.xml": f"<s {A}><a:t>Slide two words</a:t></s>", "ppt/notesSlides/notesSlide2.xml": f"<s {A}><a:t>a note of it</a:t></s>"}))
    (d / "d.xlsx").write_bytes(zipped({"xl/workbook.xml": f"<workbook {S}/>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><dimension ref="A1:AB12"/></worksheet>'}))
    doc = paragraph("Starting from here", "Heading1", 5) + paragraph("Contents of it", "TOC1") + paragraph("body text of it") + paragraph("Deeper part", "Heading2") + "<w:tbl><w:tr><w:tc>" + paragraph("cell text of it") + "</w:tc></w:tr></w:tbl>" + paragraph("Next part follows", "Heading1", 5)
    (d / "e.docx").write_bytes(zipped({"word/document.xml": f"<w:document {W}><w:body>{doc}</w:body></w:document>"}))
    (d / "bad.docx").write_bytes(b"no zip")
    (d / "f.pdf").write_bytes(b"%PDF-1.4 page one words here|page two words here")
    return d


def test_loaders(spark, folder):
    pdf = loaders.pdf_parser(lambda raw: raw.decode().split("1.4 ")[1].split("|"))
    items, errors = loaders.load_files(spark, [str(folder)], pdf)
    rows = {}
    for r in items.orderBy("path", "item_idx").collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [r.section_path for r in rows["a.html"]] == ["", "h1", "h1>h2"]
    assert rows["b.txt"][0].text.startswith("A plain text") and len(rows["long.txt"]) == 200
    assert [r.slide_number for r in rows["c.pptx"]] == [1, 10, 2] and rows["c.pptx"][2].text == "Slide two words\n\nNotes:\na note of it" and rows["c.pptx"][2].has_notes
    assert (rows["d.xlsx"][0].n_rows, rows["d.xlsx"][0].n_cols, rows["d.xlsx"][0].text) == (12, 28, "Sheet sheet1: size 12 x 28")
    blocks = [(r.block_type, r.text, r.heading_path) for r in rows["e.docx"]]
    assert blocks == [("heading", "1 Starting from here", ["1 Starting from here"]), ("paragraph", "body text of it", ["1 Starting from here"]), ("heading", "Deeper part", ["1 Starting from here", "Deeper part"]), ("paragraph", "cell text of it", ["1 Starting from here", "Deeper part"]), ("heading", "2 Next part follows", ["2 Next part follows"])]
    assert [r.page for r in rows["f.pdf"]] == [1, 2]
    assert [r.path.rsplit("/", 1)[1] for r in errors.collect()] == ["bad.docx"]


def test_sniffing(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder))
    kinds = {r.path.rsplit("/", 1)[1]: r.k for r in files.select("path", manifest.content_bucket(manifest.sniffed_type(F.col("content"), F.col("path"))).alias("k")).collect()}
    assert {kinds[n] for n in ("a.html",)} == {"html"} and kinds["c.pptx"] == "pptx" and kinds["d.xlsx"] == "xlsx" and kinds["e.docx"] == "docx" and kinds["f.pdf"] == "pdf" and kinds["b.txt"] == "txt"


def test_manifest(spark, tmp_path):
    (tmp_path / "x1.txt").write_text("a")
    (tmp_path / "x2.txt").write_text("b")
    lines = [{"path": "x1.txt", "tags": ["t"], "priority": 3}, {"path": "x*.txt", "doc_id": "own"}, {"path": "gone.txt"}]
    text = "\n\n".join(json.dumps(x) for x in lines)
    assert [e["path"].rsplit("/", 1)[1] for e in manifest.expand(manifest.parse_manifest(text), str(tmp_path))] == ["x1.txt", "x1.txt", "x2.txt"]
    with pytest.raises(ValueError, match="line 2"):
        manifest.parse_manifest('{"path": "a"}\n{"x": 1}')
    (tmp_path / "m.jsonl").write_text(text)
    rows = manifest.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()
    assert [(r.doc_id, r.priority) for r in rows] == [("x1", 3), ("own", None), ("gone", None)] and rows[0].path == f"{tmp_path}/x1.txt"
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "q"}')
    with pytest.raises(Exception, match="manifest line"):
        manifest.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    g = manifest.golden_queries(spark, {"queries": [{"query": "q", "doc_ids": "d", "top_k": 3}, {"query": "r", "phrases": ["p"]}]}).collect()
    assert g[0].expect_doc_ids == ["d"] and g[1].expect_phrases == ["p"] and g[1].top_k is None
    for bad in ([], [{"query": "q", "top_k": 0}]):
        with pytest.raises(ValueError):
            manifest.golden_queries(spark, bad)
    (tmp_path / "t.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "broken.json").write_text("[{")
    assert manifest.read_json_table(spark, str(tmp_path / "t.json"), "id int").count() == 2
    assert manifest.read_json_table(spark, str(tmp_path / "broken.json"), "id int").count() == 0


def test_sync_rejections(spark):
    rows = [(True, "/b/a.txt", True, ".txt", 5, "n"), (False, "/b/a.txt", True, ".txt", 5, "n"), (True, None, True, ".txt", 5, "n"), (True, "/c/a.txt", True, ".txt", 5, "n"), (True, "/b/../x", True, ".txt", 5, "n"), (True, "/b/a", False, ".txt", 5, "n"), (True, "/b/a.exe", True, ".exe", 5, "n"), (True, "/b/a", True, "txt", 500, "n"), (True, "/b/a", True, "txt", 5, "seen"), (True, "/b/a", True, "pdf", 5, "n")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, download_success boolean, path string, exists boolean, extension string, size_bytes long, sha256 string")
    out = dedup.sync_rejections(df, spark.createDataFrame([("seen",)], "sha256 string"), "/b", ["text/plain"], 100)
    assert [r.reject_reason for r in out.orderBy("k").collect()] == [None, "download_failed", "missing_path", "outside_base_dir", "outside_base_dir", "file_not_found", "extension_not_allowed", "too_large", "duplicate", "type_not_allowed"]


def test_tables_and_alias(spark):
    spark.sql("DROP VIEW IF EXISTS docs_alias")
    spark.sql("DROP TABLE IF EXISTS vec_t")
    ddl = "id string, text string, metadata struct<doc_id:string>, embedding array<float>, hash_norm string"
    sinks.ensure_table(spark, "vec_t", ddl, 2)
    sinks.ensure_table(spark, "vec_t", ddl, 2)
    with pytest.raises(ValueError):
        sinks.ensure_table(spark, "vec_t", ddl, 3)
    rows = spark.createDataFrame([("1", "a", ("d",), [1.0, 0.0], "h"), ("2", "a", ("d",), [1.0, 0.0], "h"), ("3", "b", ("d",), [1.0], "g"), ("4", "c", ("d",), [1.0, 1.0], None)], ddl)
    sinks.append_vectors(rows, "vec_t", 2, ["id"])
    sinks.append_vectors(rows, "vec_t", 2, ["id"])
    assert sorted(r.id for r in spark.table("vec_t").collect()) == ["1", "4", "4"]
    sinks.swap_alias(spark, "docs_alias", "vec_t")
    assert spark.table("docs_alias").columns == ["id", "text", "metadata", "embedding"]
    with pytest.raises(ValueError):
        sinks.swap_alias(spark, "vec_t", "vec_t")
    spark.sql("DROP VIEW docs_alias")
    spark.sql("DROP TABLE vec_t")
    m = sinks.generated_manifest(spark.createDataFrame([("p", "u", ["b", "a"], "es")], "path string, upload_id string, tags array<string>, lang string"), {"tags": ["c", "a"], "lang": "auto", "priority": 2, "profile": "x"}).first()
    assert m.tags == ["a", "b", "c"] and m.lang == "es"
    t = spark.createDataFrame([('["x", " y "]',), ("a, b,,",), ("[bad",)], "r string").select(sinks.parse_tags(F.col("r")).alias("t")).collect()
    assert [r.t for r in t] == [["x", "y"], ["a", "b"], []]


def test_incremental_sync(spark, tmp_path):
    src, registry, check = tmp_path / "in", str(tmp_path / "reg"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("one")
    got = []
    run = lambda: flows.sync_once(flows.incremental_files(spark, str(src)), registry, check, lambda df, n: got.append(sorted(bytes(r.content) for r in df.collect())))
    run()
    (src / "c.txt").write_text("one")
    (src / "d.txt").write_text("two")
    run()
    assert got == [[b"one"], [b"two"]]


def test_usage_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = flows.usage_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    q = flows.session_updates(stream.withColumnRenamed("user_id", "session_id")).writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("s").count() == events.select("user_id").where("user_id is not null").distinct().count()
