"""The stream of remote changes: a service on this machine, runs that are killed."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from loam.sources import remote
from loam.streaming import flows


class Service:
    """Answers as the sync service does; ``changes``: (number, folder, entry)."""

    def __init__(self):
        self.changes, self.asked, self.broken = [], [], False
        own = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlparse(self.path)
                own.asked.append(self.path)
                parts = url.path.strip("/").split("/")
                if own.broken:
                    body = {"status": "failed"}
                elif parts == ["history", "summary"]:
                    body = {"status": "success", "last": max((n for n, _, _ in own.changes), default=0)}
                else:
                    q = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
                    entries = [e for n, f, e in own.changes if f == parts[2] and q["after"] < n <= q["upto"]]
                    body = {"status": "success", "download_summary": {"target_directory": f"to/{parts[2]}"}, "downloaded_files_details": entries}
                raw = json.dumps(body).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def entry(name, **more):
    return {"name": name, "relative_path": name, "download_success": True, "extension": "." + name.rsplit(".", 1)[-1], "id": f"id-{name}", "lastModified": "2024-05-01T10:00:00Z"} | more


def stream(spark, service, store):
    spark.dataSource.register(remote.RemoteChanges)
    return spark.readStream.format("remote_changes").option("base", service.base).option("site", "main").option("folders", "a,b").option("download_dir", str(store)).load()


def test_offsets_and_rows(service, tmp_path):
    (tmp_path / "x.txt").write_text("one")
    service.changes = [(1, "a", entry("x.txt")), (2, "b", entry("no.txt")), (3, "a", entry("y.txt", relative_path="../y.txt")), (4, "a", entry("z.txt", relative_path=None)), (5, "a", entry("f.txt", download_success=False)), (6, "a", "no object")]
    r = remote._Changes({"base": service.base, "site": "main", "folders": "a,b", "download_dir": str(tmp_path)})
    assert r.initialOffset() == {"change": 0} and r.latestOffset() == {"change": 6}
    assert r.partitions({"change": 6}, {"change": 6}) == []
    rows = [dict(zip([f.split()[0] for f in remote.CHANGES.split(", ")], row)) for p in r.partitions({"change": 0}, {"change": 6}) for row in r.read(p)]
    assert [(x["name"], x["error"]) for x in rows] == [("x.txt", None), ("y.txt", "outside_base_dir"), ("z.txt", "missing_path"), ("f.txt", "download_failed"), ("no.txt", "file_missing")]
    assert rows[0]["content"] == b"one" and rows[0]["size_bytes"] == 3 and rows[0]["target_directory"] == "to/a" and rows[0]["modified"].year == 2024
    assert [x["name"] for p in r.partitions({"change": 1}, {"change": 3}) for x in [dict(zip(["site", "folder", "name"], row)) for row in r.read(p)]] == ["y.txt", "no.txt"]
    service.broken = True
    with pytest.raises(remote.RemoteError):
        r.latestOffset()
    assert remote.inside("/b", "/b/../c") is None and remote.inside("/b", "/b/c//d") == "/b/c/d" and remote.inside("/b", "/b") is None


def test_killed_runs_lose_nothing_and_double_nothing(spark, service, tmp_path, monkeypatch):
    store, folder, check = tmp_path / "store", str(tmp_path / "out"), str(tmp_path / "check")
    store.mkdir()
    for name, text in [("x.txt", "one"), ("copy.txt", "one"), ("y.txt", "two"), ("z.exe", "three")]:
        (store / name).write_text(text)
    service.changes = [(1, "a", entry("x.txt")), (2, "b", entry("copy.txt")), (3, "b", entry("z.exe")), (4, "a", entry("gone.txt"))]
    run = lambda: flows.sync_changes(stream(spark, service, store), folder, check, str(store), ["text/plain"], 1000)

    # the first run dies when the uploads are written and the registry is not
    read = spark.read
    monkeypatch.setattr(flows, "UPLOADS", "this is no schema")
    with pytest.raises(Exception):
        run()
    monkeypatch.undo()
    service.changes += [(5, "a", entry("y.txt"))]
    run()
    run()
    (store / "late.txt").write_text("two")
    service.changes += [(6, "b", entry("late.txt")), (7, "a", entry("w.txt"))]
    (store / "w.txt").write_text("four")
    run()
    got = sorted((bytes(r.content), r.path.rsplit("/", 1)[1], r.batch) for r in read.parquet(f"{folder}/uploads").collect())
    assert [g[:2] for g in got] == [(b"four", "w.txt"), (b"one", "copy.txt"), (b"two", "y.txt")]
    assert sorted(r.sha256 for r in read.parquet(f"{folder}/registry").collect()) == sorted(r.sha256 for r in read.parquet(f"{folder}/uploads").collect())
    assert sorted((r.name, r.reject_reason) for r in read.parquet(f"{folder}/rejected").collect()) == [("gone.txt", "file_missing"), ("late.txt", "duplicate"), ("z.exe", "extension_not_allowed")]
    first = read.parquet(f"{folder}/uploads").where("name = 'copy.txt'").first()
    assert first.metadata["item_id"] == "id-copy.txt" and first.tags == ["source:remote", "site:main", "dir:to/b"] and first.content_type == "text/plain"


def test_the_least_path_of_equal_contents_stays(spark):
    rows = spark.createDataFrame([("h", "b", 1), ("h", "a", 2), ("g", "z", 3)], "sha256 string, path string, n int")
    assert sorted(tuple(r) for r in flows.first_copies(rows).collect()) == [("g", "z", 3), ("h", "a", 2)]
