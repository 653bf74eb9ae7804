"""The routed ingest plan: each item to its chunker, one scan, one numbering."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from loam.operators import sections
from loam.plans import ingest, registry

SF = "/root/testdata/sf0.001"
DOCX = registry.DOCX
SCHEMA = "doc_id string, item_idx int, text string, content_type string, source string, section_heading string, heading_level int"


def items(spark):
    long = "some words of a plain text file that go on and on. " * 60
    rows = [
        ("a", 0, "Starting the engine\nFirst turn the key fully.", DOCX, "a.docx", "Starting the engine", 1),
        ("a", 1, "Checks of the oil\nThen look at the oil gauge.", DOCX, "a.docx", "Checks of the oil", 2),
        ("a", 2, "plain note beside the handbook", "text/plain", "a.txt", None, None),
        ("b", 0, long, "text/plain", "b.txt", None, None),
        ("b", 1, long, "text/html", "b.html", None, None),
        ("c", 0, "no source, so it is an error", "text/plain", "", None, None),
        ("d", 0, "   ", "text/plain", "d.txt", None, None),
        ("e", 0, None, DOCX, "e.docx", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_items_go_to_their_chunkers(spark):
    profile = ingest.Profile(chunker="toc_section_docx", size=500, overlap=50)
    rows = sorted(ingest.chunk_items(items(spark), profile).collect(), key=lambda r: (r.doc_id, r.chunk_seq))
    a = [r for r in rows if r.doc_id == "a"]
    assert [(r.chunk_seq, r.content_type, r.source) for r in a] == [(1, DOCX, "a.docx"), (2, "text/plain", "a.txt")]
    assert a[0].text == "Procedure: Checks of the oil\nSection: Checks of the oil\nPath: Starting the engine | Checks of the oil\nFirst turn the key fully.\nThen look at the oil gauge."
    b = [r for r in rows if r.doc_id == "b"]
    assert [r.chunk_seq for r in b] == list(range(1, len(b) + 1)) and [r.chunk_id for r in b][:2] == ["b_chunk_1", "b_chunk_2"]
    kinds = [r.content_type for r in b]
    assert kinds == sorted(kinds, reverse=True) and kinds.count("text/plain") == kinds.count("text/html")
    assert {r.doc_id for r in rows} == {"a", "b"}
    plain = ingest.chunk_items(items(spark).where("content_type <> '" + DOCX + "'"), ingest.Profile(size=500, overlap=50)).collect()
    assert sorted(r.text for r in rows if r.content_type != DOCX) == sorted(r.text for r in plain)


def test_every_route_and_the_switch(spark):
    frame = items(spark)
    for chunker in ("structured_docx", "structured_pdf", "tokens", "none", "char"):
        rows = ingest.chunk_items(frame, ingest.Profile(chunker=chunker, overlap=0.1 if chunker == "tokens" else 50)).collect()
        assert {r.doc_id for r in rows} == {"a", "b"}, chunker
        assert len({r.chunk_id for r in rows}) == len(rows)
    off = ingest.chunk_items(frame, ingest.Profile(chunker="toc_section_docx", structured=False)).collect()
    assert not any("Procedure:" in r.text for r in off)
    assert ingest.chunk_items(frame.limit(0), ingest.Profile(chunker="toc_section_docx")).count() == 0


def test_routed_tables(spark):
    rows = {r.content_type: r.chunks for r in registry.QUERIES["chunks_by_type"](spark, SF).collect()}
    assert set(rows) == {"txt", "html", "docx"}
    chunks = registry.QUERIES["ingest_routed"](spark, SF)
    assert chunks.count() == sum(rows.values()) == chunks.select("chunk_id").distinct().count()
    ready = ingest.prepared(registry._mixed_items(spark, SF), registry.ROUTED)
    alone = sections.chunk_sections(ready.where("route = 'toc_section_docx'"), 512)
    assert alone.count() == rows["docx"]


def test_branches_read_their_own_folder(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        registry.QUERIES["ingest_routed"](spark, SF).explain("formatted")
    text = out.getvalue()
    assert "documents.parquet" not in text and text.count("PartitionFilters: [isnotnull(route") >= 2 and "CartesianProduct" not in text


def test_chunks_of_a_long_document_are_numbered_by_running_sums(spark):
    many = spark.range(3000).select(F.lit("x").alias("doc_id"), F.col("id").cast("int").alias("item_idx"), F.concat(F.lit("words of item number "), "id").alias("text"), F.lit("text/plain").alias("content_type"), F.lit("s").alias("source"))
    rows = sorted(ingest.chunk_items(many.repartition(5)).collect(), key=lambda r: r.chunk_seq)
    assert [r.chunk_seq for r in rows] == list(range(1, 3001)) and rows[77].text == "words of item number 77"
    out = io.StringIO()
    with redirect_stdout(out):
        ingest.chunk_items(many).explain("formatted")
    assert "collect_list" not in out.getvalue()
