"""Pictures in documents: package parts, body order, marks, files."""

import io
import zipfile

from pyspark.sql import functions as F

from loam.operators import sections
from loam.sources import loaders, sinks

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:v="urn:schemas-microsoft-com:vml"'


def text(x):
    return f"<w:r><w:t>{x}</w:t></w:r>"


def picture(rid):
    return f'<w:r><w:drawing><a:blip r:embed="{rid}"/></w:drawing></w:r>'


def paragraph(*runs, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={style!r}/></w:pPr>" if style else ""}{"".join(runs)}</w:p>'.replace("'", '"')


def document(*body, rels=(), media=None, styles=True):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="T1"><w:name w:val="toc 1"/></w:style></w:styles>')
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{kind}" Target="{t}"{more}/>' for i, t, more in rels) + "</Relationships>")
        for name, content in (media or {}).items():
            z.writestr(name, content)
    return raw.getvalue()


RELS = [("r1", "media/one.png", ""), ("r2", "/word/media/two%20b.JPG", ""), ("r3", "../../etc/passwd", ""), ("r4", "http://x.test/p.png", ' TargetMode="External"'), ("r5", "media/none.png", ""), ("r6", "../word/media/one.png", "")]
MEDIA = {"word/media/one.png": b"first", "word/media/two b.JPG": b"second"}


def guide():
    return document(
        paragraph(text("Repair guide"), style="H1"),
        paragraph(text("Before the picture we write.")),
        paragraph(picture("r1")),
        paragraph(text("left words"), picture("r2"), text("right words")),
        paragraph(text("gone"), picture("r3"), picture("r4"), picture("r5")),
        paragraph(picture("r1"), text("contents line"), style="T1"),
        f"<w:tbl><w:tr><w:tc>{paragraph(text('in a cell'), picture('r6'))}</w:tc></w:tr></w:tbl>",
        '<w:p><w:r><w:pict><v:shape><v:imagedata r:id="r1"/></v:shape></w:pict></w:r></w:p>',
        rels=RELS,
        media=MEDIA,
    )


def files(spark, **named):
    return spark.createDataFrame([(f"/in/{k}.docx", bytearray(v), "docx") for k, v in named.items()], "path string, content binary, loader string")


def test_parts_and_body_order():
    rows = list(loaders.parse_docx_with_images(guide()))
    got = [(r["block_type"], r["text"] or (r["figure_no"], r["extension"], r["image"])) for r in rows]
    assert got == [
        ("heading", "Repair guide"),
        ("paragraph", "Before the picture we write."),
        ("image", (1, ".png", b"first")),
        ("paragraph", "left words"),
        ("image", (2, ".jpg", b"second")),
        ("paragraph", "right words"),
        ("paragraph", "gone"),
        ("paragraph", "in a cell"),
        ("image", (3, ".png", b"first")),
        ("image", (4, ".png", b"first")),
    ]
    assert [r["text"] for r in loaders.parse_docx(guide())] == ["Repair guide", "Before the picture we write.", "left wordsright words", "gone", "in a cell"]
    head = document(paragraph(picture("r1"), text("Part one"), picture("r2"), text("tail"), style="H1"), rels=RELS, media=MEDIA)
    assert [(r["block_type"], r["heading_path"]) for r in loaders.parse_docx_with_images(head)] == [("image", []), ("heading", ["Part one"]), ("image", ["Part one"]), ("paragraph", ["Part one"])]


def test_no_relationships_and_broken_files(spark):
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{paragraph(text('alone'), picture('r1'))}</w:body></w:document>")
    assert [r["text"] for r in loaders.parse_docx_with_images(bare.getvalue())] == ["alone"]
    rows = loaders.parsed_items(files(spark, bad=b"no zip", good=guide()), {"docx": loaders.parse_docx_with_images})
    assert rows.where("error is not null").count() == 1 and rows.where("block_type = 'image'").count() == 4


def test_from_file_to_chunks_and_figure_files(spark, tmp_path):
    src = tmp_path / "guide.docx"
    src.write_bytes(guide())
    items, errors = loaders.load_files(spark, [str(src)], images=True)
    assert errors.count() == 0
    pictures = sorted((r.item_idx, r.figure_id, r.image_ref, bytes(r.image), r.text) for r in items.where("block_type = 'image'").collect())
    assert [p[1:] for p in pictures][:2] == [("guide_img_001", "guide/img_001.png", b"first", "guide_img_001"), ("guide_img_002", "guide/img_002.jpg", b"second", "guide_img_002")]
    plain, _ = loaders.load_files(spark, [str(src)])
    assert plain.where("block_type = 'image'").count() == 0

    chunks = sections.chunk_sections(items.withColumn("doc_id", F.lit("guide")), 512, inline=True, figure_chunks=True).orderBy("chunk_seq").collect()
    assert chunks[0].text.split("\n")[:5] == ["Procedure: Repair guide", "Section: Repair guide", "Path: Repair guide", "Before the picture we write.", "[FIGURE:guide_img_001]"]
    assert chunks[0].figure_ids == ["guide_img_001", "guide_img_002", "guide_img_003", "guide_img_004"]
    assert [(c.chunk_type, c.parent_chunk_id) for c in chunks[1:]] == [("figure", "guide_chunk_1")] * 4

    out = tmp_path / "figures"

    def put(path, content, root=str(out)):
        import os

        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(content)

    written = {r.path: r.length for r in sinks.figure_files(loaders.figures_of(items), put).collect()}
    assert written == {"guide/img_001.png": 5, "guide/img_002.jpg": 6, "guide/img_003.png": 5, "guide/img_004.png": 5}
    assert (out / "guide/img_002.jpg").read_bytes() == b"second"
