import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from loam.operators import blocks
from loam.sources import sinks
from loam.sources.remote import RemoteListing


def test_clean_blocks(spark):
    rows = [("d", 0, 1, "paragraph", "ACME\nContents\nOne .... 2\nTwo\t\t4"), ("d", 1, 1, "paragraph", "Real Heading\n\nbody line 7"), ("d", 2, 2, "paragraph", "ACME\nmore body"), ("d", 3, 2, "image", "ACME"), ("e", 0, 1, "paragraph", "lone page")]
    frame = spark.createDataFrame(rows, "doc_id string, pos int, page int, block_type string, text string")
    got = {(r.doc_id, r.pos): r.text for r in blocks.clean_blocks(frame, "pdf").collect()}
    assert got == {("d", 1): "Real Heading\nbody line 7", ("d", 2): "more body", ("d", 3): "ACME", ("e", 0): "lone page"}
    assert ("e", 0) not in {(r.doc_id, r.pos) for r in blocks.clean_blocks(frame, "pdf", compat=True).collect()}
    assert {(r.doc_id, r.pos): r.text for r in blocks.clean_blocks(frame, "docx").collect()}[("d", 2)] == "ACME\nmore body"


def test_numbering(spark):
    rows = [("d", k, n, lv) for k, (n, lv) in enumerate([("5", 0), ("5", 1), ("5", 1), ("6", 0), ("5", 0), ("5", 1), ("5", 3)])]
    got = {r.pos: r.prefix for r in blocks.numbered_levels(spark.createDataFrame(rows, "doc_id string, pos int, num_id string, level int")).collect()}
    assert got == {0: "1", 1: "1.1", 2: "1.2", 3: "1", 4: "2", 5: "2.1", 6: "2.1.0.1"}


def test_placeholders_and_files(spark, tmp_path):
    chunks = spark.createDataFrame([("d", "c", "see [FIGURE:f1] and [FIGURE:f1] [FIGURE:gone]")], "doc_id string, chunk_id string, text string")
    figures = spark.createDataFrame([("d", "f1", "a.png", 1, "png", bytearray(b"xy"))], "doc_id string, figure_id string, image_ref string, n int, extension string, content binary")
    assert [tuple(r) for r in blocks.placeholders(chunks, figures).collect()] == [("d", "f1", "c", "a.png")]
    base = str(tmp_path)

    def put(path, content):
        import os

        os.makedirs(os.path.dirname(f"{base}/{path}"), exist_ok=True)
        with open(f"{base}/{path}", "wb") as f:
            f.write(content)

    r = sinks.figure_files(figures, put).first()
    assert r.path == "d/img_001.png" and r.length == 2 and (tmp_path / "d/img_001.png").read_bytes() == b"xy"


def test_remote_listing(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            folder = self.path.rsplit("/", 1)[1]
            body = json.dumps([{"name": f"{folder}.txt", "path": f"/{folder}", "size_bytes": 3}]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RemoteListing)
    rows = spark.read.format("remote_listing").option("base", f"http://127.0.0.1:{server.server_port}").option("folders", "a,b").load().collect()
    server.shutdown()
    assert sorted((r.folder, r.name, r.extension, r.size_bytes) for r in rows) == [("a", "a.txt", ".txt", 3), ("b", "b.txt", ".txt", 3)]
