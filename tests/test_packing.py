"""Packing of blocks against a plain restatement, and the chunker that uses it."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import packing, structured


def test_fill_split_and_merge_by_hand():
    assert packing.filled([("a" * 40, False), ("b" * 40, False), ("c" * 40, False)], 25) == [
        {"text": "a" * 40 + "\n" + "b" * 40, "is_split": False, "split_reason": None, "split_part": 1},
        {"text": "c" * 40, "is_split": True, "split_reason": "max_tokens", "split_part": 2},
    ]
    chunks = packing.merged_forward(packing.filled([("Alone.", False), ("x. " * 60, False), ("tail", False)], 20))
    assert chunks[0]["text"].startswith("Alone.\nx. x.") and chunks[-1]["text"].endswith("tail")
    assert all(c["is_split"] for c in chunks)
    assert packing.merged_forward([]) == [] and packing.filled([], 10) == []
    lone = packing.merged_forward(packing.filled([("one line", False)], 10))
    assert lone == [{"text": "one line", "is_split": False, "split_reason": None, "split_part": 1}]


def test_chains_go_forward():
    lines = [{"text": t, "is_split": k > 0, "split_reason": "max_tokens" if k else None, "split_part": k + 1} for k, t in enumerate(["a", "b", "c", "d\ne", "f"])]
    assert [c["text"] for c in packing.merged_forward(lines)] == ["a\nb", "c\nd\ne", "f"]
    blank = [{"text": t, "is_split": True, "split_reason": None, "split_part": k + 1} for k, t in enumerate(["", "a", "b"])]
    assert [c["text"] for c in packing.merged_forward(blank)] == ["a\nb"]


def test_parts_repeat_headings_and_overlap():
    text = "One two three. Four five six. Seven eight nine."
    parts = packing.parts_under_heading(text, 5, "HEAD", "Sub", overlap=2)
    assert parts == ["HEAD\nSub\nOne two three.", "HEAD\nSub\ntwo three.\nFour five six.", "HEAD\nSub\nfive six.\nSeven eight nine."]
    assert packing.parts_under_heading("HEAD stays once.", 50, "HEAD") == ["HEAD stays once."]
    assert packing.parts_under_heading("Aaaa bbbb cccc. Dd.", 4, "H", least=3) == ["H\nAaaa bbbb cccc.\nDd."]
    block = packing.split_block("TITLE\n" + "word " * 40, True, 10)
    assert len(block) > 3 and all(p.startswith("TITLE\n") for p in block)
    assert " ".join(p.removeprefix("TITLE\n") for p in block).split() == ["word"] * 40


def plain_pack(blocks, most):
    """Greedy chunks of (text, heading) that are all under the budget, one-liners forward."""
    chunks, i = [[]], 0
    for text, _ in blocks:
        if chunks[-1] and sum(round(len(t) / 4) for t in chunks[-1]) + round(len(text) / 4) > most:
            chunks.append([])
        chunks[-1].append(text)
    texts = ["\n".join(c) for c in chunks if c]
    while i < len(texts) - 1:
        if len([x for x in texts[i].splitlines() if x.strip()]) <= 1:
            texts[i : i + 2] = [texts[i] + "\n" + texts[i + 1]]
        else:
            i += 1
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_pack_against_plain(spark, seed):
    r = random.Random(seed)
    sections = {(d, s): [("\n".join("w" * r.randint(1, 60) for _ in range(r.randint(1, 3)))[:110], False) for _ in range(r.randint(1, 25))] for d in range(6) for s in range(3)}
    rows = [(d, s, k, t, h) for (d, s), blocks in sections.items() for k, (t, h) in enumerate(blocks)] + [(9, 9, 0, " ", False), (9, 9, 1, None, False)]
    frame = spark.createDataFrame(rows, "doc_id int, section int, block_no int, text string, heading boolean").repartition(3)
    got = sorted(packing.pack(frame, ["doc_id", "section"], 40).collect(), key=lambda x: (x.doc_id, x.section, x.part_seq))
    # chunks of which one took in another may be fused no further: the walk above fuses from the left
    for key, blocks in sections.items():
        assert [x.text for x in got if (x.doc_id, x.section) == key] == plain_pack(blocks, 40)
    assert all(x.doc_id != 9 for x in got)


def test_no_word_is_lost(spark):
    r = random.Random(5)
    text = " ".join("w" * r.randint(1, 12) + r.choice(["", "", ".", "!"]) for _ in range(800))
    for most in (3, 10, 60):
        assert " ".join(packing.sentence_parts(text, most)).split() == text.split()
        assert all(packing.tokens(p) <= most or " " not in p for p in packing.sentence_parts(text, most))


def test_blocks_of_lines(spark):
    lines = [(1, k, x) for k, x in enumerate(["TITLE", "a", "b", "", "c", "- item", "d", "  ", "", "e"])]
    frame = spark.createDataFrame(lines, "doc_id int, pos int, line string")
    got = packing.block_lines(frame, F.col("line").rlike("^(TITLE|- )"), ["doc_id"]).orderBy("block_no").collect()
    assert [(x.text, x.heading) for x in got] == [("TITLE", True), ("a\nb", False), ("c", False), ("- item", True), ("d", False), ("e", False)]


def test_split_with_heading_rows(spark):
    rows = spark.createDataFrame([(1, "One two three. Four five six.", "H", None), (2, None, "H", "S")], "k int, text string, heading string, sub_heading string")
    assert [(x.k, x.part_seq, x.text) for x in packing.split_with_heading(rows, 5).collect()] == [(1, 1, "H\nOne two three."), (1, 2, "H\nFour five six.")]


def test_docx_sections_without_titles_are_packed(spark):
    body = "plain words here and there\nmore plain words\n\nanother block of words\n- an item\n" + "a long sentence of many words goes on. " * 40
    items = spark.createDataFrame([("d", 0, body, ["Part one"]), ("d", 1, "7.1 Start\nstep words", ["Part two"])], "doc_id string, item_idx int, text string, heading_path array<string>")
    rows = sorted(structured.chunk_docx(items, 60).collect(), key=lambda r: r.chunk_seq)
    one = [r for r in rows if r.section == "Part one"]
    assert len(one) > 2 and all(r.unit_type == "block" and r.is_split for r in one)
    assert " ".join(r.text for r in one).split() == body.split()
    assert all(len(r.text.splitlines()) > 1 for r in one[:1])
    assert [r.text for r in rows if r.section == "Part two"] == ["Part two\n7.1 Start\nstep words"]
    assert [r.chunk_seq for r in rows] == list(range(1, len(rows) + 1))


def test_mixed_case_is_no_title(spark):
    rows = spark.createDataFrame([("McDonald ABc",), ("Two Words",), ("ALL CAPS 3",), ("O'Neil's Way",), ("O'Neil'S Way",), ("Über Öl",), ("漢字 Title",), ("lower Title",)], "t string")
    got = {r.t: r.y for r in rows.select("t", structured.is_title_like(F.col("t")).alias("y")).collect()}
    assert got == {t: bool(t.istitle() or t.isupper()) for t in got}


def pdf(spark, pages, most, **more):
    rows = [("d", k, t, k + 1, h) for k, (t, h) in enumerate(pages)]
    items = spark.createDataFrame(rows, "doc_id string, item_idx int, text string, page int, section_heading string")
    return sorted(structured.chunk_pdf(items, most, **more).collect(), key=lambda r: r.chunk_seq)


def test_pdf_headers_go_and_wrapped_lines_join(spark):
    pages = [("Internal - Acme Works\nPART ONE\nThis is a line\nthat goes on here\n- point a\nFoot 1", None), ("Internal - Acme Works\nPART TWO\nOn the second page\nit wraps around\nFoot 1", None)]
    got = pdf(spark, pages, 64)
    texts = "\n".join(r.text for r in got)
    assert "Internal" not in texts and "Foot 1" not in texts
    assert "This is a line that goes on here\n- point a" in texts and "On the second page it wraps around" in texts
    assert min(r.page_start for r in got) == 1 and max(r.page_end for r in got) == 2


def test_pdf_heading_leads_each_part(spark):
    got = pdf(spark, [("TOP\nThe Working Steps\nThe first step is told here and it keeps on going.\nThe second step goes on with details for the test.", "The Working Steps")], 18)
    assert len(got) > 1 and all(r.text.split("\n")[0] == "The Working Steps" and "\n" in r.text for r in got)


def test_pdf_overused_headings_part_nothing(spark):
    got = pdf(spark, [("Heading A\nline a1 goes\nHeading B\nline b1 goes\nHeading C\nline c1 goes", None)], 64)
    assert len(got) <= 2 and all("Heading A" in r.text and "line a1" in r.text for r in got)


def test_pdf_numbered_lines_begin_chunks(spark):
    got = pdf(spark, [("7. OP2 - Start anew\nStep one for OP2\nStep two for OP2\n8. OP3 - Look over\nStep one for OP3\nStep two for OP3", None)], 24)
    assert len(got) == 2 and [r.text.split("\n")[0][:2] for r in got] == ["7.", "8."]


def test_pdf_tables_of_contents_go_on_the_first_pages_alone(spark):
    toc = "Contents\nScope 4\nTerms 5\nA Real Heading\nbody words here, 1 of 2;"
    got = pdf(spark, [(toc, None), ("Contents\nKept line 7\nmore of the body, and so on;", None)], 200, toc_pages=1)
    texts = "\n".join(r.text for r in got)
    assert "Scope 4" not in texts and "Terms 5" not in texts and "body words here" in texts and "Kept line 7" in texts


def docx(spark, items, most, **more):
    rows = [("d", k, t, p) for k, (t, p) in enumerate(items)]
    frame = spark.createDataFrame(rows, "doc_id string, item_idx int, text string, heading_path array<string>")
    return sorted(structured.chunk_docx(frame, most, **more).collect(), key=lambda r: r.chunk_seq)


def test_docx_noise_goes_and_lists_stay_with_their_paragraph(spark):
    one = "Confidential - Acme\nForeword\nThis is the first line.\nThis is the second line.\n- point one\n- point two\n\nTable of Contents\nPart A ..... 3"
    got = docx(spark, [(one, ["Foreword"]), ("Confidential - Acme\nPart One\nWords of part one\nmore of its words\n- item a", ["Part One"])], 48)
    texts = [r.text for r in got]
    assert all("Confidential" not in t and "Part A" not in t for t in texts)
    assert any("- point one" in t and "This is the second line." in t for t in texts)
    assert got[0].section == "Foreword"


def test_docx_heading_stays_with_its_body_and_leads_each_part(spark):
    body = "Section Alpha\nThe first line of the body.\nThe second line goes on with it.\nA third line adds more so that it splits.\nThe fourth makes sure of that."
    got = docx(spark, [(body, ["Section Alpha"])], 20)
    assert len(got) > 1 and all(r.text.split("\n")[0] == "Section Alpha" and len(r.text.splitlines()) > 1 for r in got)
    assert " ".join(x for r in got for x in r.text.splitlines()[1:]).split() == " ".join(body.splitlines()[1:]).split()


def test_docx_many_headings_fill_one_chunk(spark):
    got = docx(spark, [("Heading One\nfirst words here\nHeading Two\nsecond words here\nHeading Three\nthird words here", None)], 64)
    assert len(got) == 1 and len(got[0].text.splitlines()) == 6


def test_docx_numbered_lines_are_sections_that_lead_their_parts(spark):
    got = docx(spark, [("7. OP2 - Start anew\nStep one for OP2\nStep two for OP2\n8. OP3 - Look over\nStep one for OP3\nStep two for OP3", None)], 24)
    assert [r.text.split("\n")[0] for r in got] == ["7. OP2 - Start anew", "8. OP3 - Look over"]
    text = "8. OP3 - New start of the pool keeper\n8.1 Overview\nThis part tells how it is done.\n8.2 Terms\nPK: the pool keeper itself.\n- Step one: read the logs.\n- Step two: start it anew.\n- Step three: see that it is well.\n9. OP4 - What follows\nWords that follow."
    got = docx(spark, [(text, None)], 32)
    eight = [r for r in got if r.text.startswith("8.")]
    assert len(eight) > 1 and all(r.text.split("\n")[0].startswith("8. OP3") and len(r.text.splitlines()) > 1 for r in got if r in eight)
    assert got[-1].text == "9. OP4 - What follows\nWords that follow."
