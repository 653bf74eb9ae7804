import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.operators import chunking, structured


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("c")).first()["c"]


def test_fixed_windows(spark):
    assert one(spark, "abcdefghij", lambda c: chunking.chunk_chars(c, 4, 1)) == ["abcd", "defg", "ghij"]
    assert len(one(spark, "abcdefgh", lambda c: chunking.chunk_chars(c, 3, 0))) == 3
    assert one(spark, "", lambda c: chunking.chunk_chars(c, 3, 0)) == []
    assert one(spark, None, lambda c: chunking.chunk_chars(c, 3, 0)) == []
    eight = "a b c d e f g h"
    assert one(spark, eight, lambda c: chunking.chunk_tokens(c, 3, 0.5)) == ["a b c", "c d e", "e f g", "g h"]


def test_estimates(spark):
    rows = spark.createDataFrame([("x" * n,) for n in range(20)], "t string").select(chunking.estimated_tokens(F.col("t")).alias("e"), chunking.counted_tokens(F.col("t")).alias("c")).collect()
    assert [r.e for r in rows] == [round(n / 4) for n in range(20)]
    assert [r.c for r in rows] == [-(-n // 4) for n in range(20)]
    assert chunking.effective_max_tokens(None, 512, 12) == 500 and chunking.effective_max_tokens(100, 512, 12) == 100 and chunking.effective_max_tokens(5, 1, 9) == 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab. !\n", max_size=300), st.integers(1, 20))
def test_splitter_loses_no_word(spark, text, most):
    parts = one(spark, text, lambda c: chunking.split_to_limit(c, most))
    assert " ".join(parts).split() == text.split()


def test_policies(spark):
    text = "word " * 100
    assert one(spark, text, lambda c: chunking.apply_limit(c, 10, "skip")) == []
    assert one(spark, text, lambda c: chunking.apply_limit(c, 10, "truncate")) == [text[:40]]
    assert all(len(p) <= 40 for p in one(spark, text, lambda c: chunking.apply_limit(c, 10, "split")))
    with pytest.raises(ValueError):
        chunking.apply_limit(F.col("x"), 1, "other")


def test_title_and_headings(spark):
    chunks = spark.createDataFrame([(1, 1, "Guide\nfirst"), (1, 2, "Guide\nsecond"), (2, 1, "A\nx"), (2, 2, "B\ny")], "doc_id int, chunk_seq int, text string")
    rows = {(r.doc_id, r.chunk_seq): (r.text, r.doc_title) for r in chunking.strip_title(chunks).collect()}
    assert rows == {(1, 1): ("Guide\nfirst", "Guide"), (1, 2): ("second", "Guide"), (2, 1): ("A\nx", None), (2, 2): ("B\ny", None)}
    blocks = spark.createDataFrame([("d", 0, 1, "A"), ("d", 1, None, "x"), ("d", 2, 2, "B"), ("d", 3, 3, "C"), ("d", 4, None, "y"), ("d", 5, 2, "D"), ("d", 6, 1, "E")], "doc_id string, pos int, level int, title string")
    paths = {r.pos: r.heading_path for r in chunking.heading_paths(blocks).collect()}
    assert paths == {0: ["A"], 1: ["A"], 2: ["A", "B"], 3: ["A", "B", "C"], 4: ["A", "B", "C"], 5: ["A", "D"], 6: ["E"]}


def test_admin_and_page_lines(spark):
    items = spark.createDataFrame([("Document Control",), ("Procedure",), (None,), ("Version history",)], "h string")
    assert [r.h for r in chunking.admin_sections(items, "h", ["document control", "version history"], []).collect()] == ["Procedure", None]
    lines = spark.createDataFrame([(1, p, "ACME  Corp") for p in (1, 2, 3)] + [(1, 1, "body"), (2, 1, "only")], "doc_id int, page int, line string")
    assert [(r.doc_id, r.line) for r in chunking.repeated_page_lines(lines).collect()] == [(1, "ACME Corp")]


def test_docx_sections(spark):
    body = "Confidential\n7. Start\n7.1 Login\n- open\n- type\nConfidential\n7.2 Leave\n" + "step words here\n" * 80
    items = spark.createDataFrame([("d", 0, body), ("d", 1, "8. Next\nContents ..... 3\nshort text")], "doc_id string, item_idx int, text string")
    rows = sorted(structured.chunk_docx(items, 100).collect(), key=lambda r: r.chunk_seq)
    assert {r.section for r in rows} == {"7. Start", "8. Next"}
    assert all(r.text.startswith(r.section) and len(r.text) / 4 <= 110 for r in rows)
    everything = "\n".join(r.text for r in rows)
    assert everything.count("step words here") == 80 and "Confidential" not in everything and "....." not in everything
    assert [r.split_part for r in rows if r.is_split and r.split_reason == "oversize"][:2] == [1, 2]
    assert rows[0].section_range.startswith("7.1")


def test_pdf_pages(spark):
    pages = [(1, n, f"ACME manual\nINTRO PART\nthis line wraps\nonto the next.\n- one\n- two\nfoot note {n}", n + 1) for n in range(3)]
    items = spark.createDataFrame(pages, "doc_id int, item_idx int, text string, page int")
    rows = structured.chunk_pdf(items, 200).collect()
    text = "\n".join(r.text for r in rows)
    assert "ACME manual" not in text and "INTRO PART" not in text  # on all pages
    assert all(r.page_start is not None for r in rows)
    lone = "\n".join(r.text for r in structured.chunk_pdf(items.where("page = 1"), 200).collect())
    assert "this line wraps onto the next." in lone and "- one\n- two" in lone


def test_sections_and_figures(spark):
    items = [("d", 0, "Install", "Install", ["Install"], 1, None, None), ("d", 1, "Get the parts", None, ["Install", "2.1 Parts"], 2, None, None), ("d", 2, "img", None, ["Install", "2.1 Parts"], 2, "image", "d_img_001")]
    frame = spark.createDataFrame(items, "doc_id string, item_idx int, text string, section_heading string, heading_path array<string>, heading_level int, block_type string, figure_id string")
    rows = structured.chunk_sections(frame, 200, figure_chunks=True).collect()
    part = next(r for r in rows if "Get the parts" in r.text)
    assert "Procedure: Install\nSection: 2.1 Parts\nPath: Install > 2.1 Parts" in part.text and "[FIGURE:d_img_001]" in part.text
    figure = next(r for r in rows if r.unit_type == "figure")
    assert figure.parent_seq == part.chunk_seq
    assert all("FIGURE" not in r.text for r in structured.chunk_sections(frame, 200, figures=False).collect())


def test_empty_documents(spark):
    none = spark.createDataFrame([], "doc_id int, item_idx int, text string")
    rng = random.Random(0)
    for f in (structured.chunk_docx, structured.chunk_pdf, structured.chunk_sections):
        assert f(none, rng.randrange(10, 50)).count() == 0
