"""A remote listing as a Spark data source.

``spark.dataSource.register(RemoteListing)``, then
``spark.read.format("remote_listing").option("base", url).option("folders", "a,b").load()``
gives a row for each entry of each folder; a folder is one partition, fetched in its
task. The service answers ``GET base/list/folder`` with a JSON array of objects.

``spark.readStream.format("remote_changes").option("base", url).option("site", s)
.option("folders", "a,b").option("download_dir", dir)`` is a stream of the files that the
service has fetched. Its offset is the number of the last change, which ``GET
base/history/summary`` tells (``{"last": n}``); a batch holds the changes after one offset up
to another, asked of ``base/update/site/folder?after=..&upto=..`` (option ``mode``: update or
download), one task for each folder. So a batch that runs again asks for the same changes. An
entry's file is read in the task from ``download_dir``, a folder or store that all tasks see;
what is wrong with an entry is its ``error``, and it stays a row.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "folder string, name string, path string, extension string, size_bytes long, etag string, modified string"


class _Folder(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class RemoteListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["base"].rstrip("/")
        self.folders = [f.strip() for f in options.get("folders", "").split(",") if f.strip()]
        self.timeout = float(options.get("timeout", "30"))

    def partitions(self) -> list[InputPartition]:
        return [_Folder(f) for f in self.folders]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with urlopen(f"{self.base}/list/{quote(partition.folder)}", timeout=self.timeout) as reply:
            entries = json.load(reply)
        for e in entries:
            name = e.get("name") or ""
            yield partition.folder, name, e.get("path"), "." + name.rsplit(".", 1)[1] if "." in name else "", e.get("size_bytes"), e.get("etag"), e.get("modified")


CHANGES = "site string, folder string, name string, path string, extension string, size_bytes long, item_id string, etag string, modified timestamp, url string, target_directory string, download_success boolean, exists boolean, sha256 string, content binary, error string"


class RemoteError(RuntimeError):
    """The service cannot be reached, or answers what is no success."""


def asked(url: str, timeout: float) -> dict:
    """The JSON object that the service answers."""
    try:
        with urlopen(url, timeout=timeout) as reply:
            got = json.load(reply)
    except (OSError, ValueError) as e:
        raise RemoteError(f"{url}: {e}") from e
    if not isinstance(got, dict) or got.get("status", "success") != "success":
        raise RemoteError(f"{url}: no success")
    return got


def inside(base: str, path: str | None) -> str | None:
    """The path below ``base`` that a relative or absolute path names, or null."""
    if not path:
        return None
    whole = posixpath.normpath(path if path.startswith("/") else posixpath.join(base, path))
    return whole if whole.startswith(posixpath.normpath(base).rstrip("/") + "/") else None


class RemoteChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options)


class _Range(InputPartition):
    def __init__(self, folder: str, after: int, upto: int):
        super().__init__(folder)
        self.folder, self.after, self.upto = folder, after, upto


class _Changes(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.base, self.site = options["base"].rstrip("/"), options["site"]
        self.folders = [f.strip() for f in options.get("folders", "").split(",") if f.strip()]
        self.mode, self.store = options.get("mode", "update"), options["download_dir"].rstrip("/")
        self.timeout, self.most = float(options.get("timeout", "30")), int(options.get("max_bytes", str(100 << 20)))
        if self.mode not in ("update", "download"):
            raise ValueError(f"unknown mode {self.mode}")

    def initialOffset(self) -> dict:
        return {"change": 0}

    def latestOffset(self) -> dict:
        return {"change": int(asked(f"{self.base}/history/summary", self.timeout)["last"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(f, start["change"], end["change"]) for f in self.folders] if end["change"] > start["change"] else []

    def commit(self, end: dict) -> None:
        """The service keeps its history: nothing to tell it."""

    def read(self, partition: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        got = asked(f"{self.base}/{self.mode}/{quote(self.site)}/{quote(partition.folder)}?{urlencode({'after': partition.after, 'upto': partition.upto})}", self.timeout)
        target = (got.get("download_summary") or {}).get("target_directory")
        if not target:
            raise RemoteError(f"{partition.folder}: no target directory")
        store, base = fs.FileSystem.from_uri(self.store) if "://" in self.store else (fs.LocalFileSystem(), self.store)
        for e in got.get("downloaded_files_details") or []:
            if isinstance(e, dict):
                yield self._row(partition.folder, target, e, store, base)

    def _row(self, folder: str, target: str, e: dict, store, base: str) -> tuple:
        raw = e.get("relative_path") or e.get("download_path")
        name = e.get("name") or posixpath.basename(raw or "")
        path, error, content, size, exists = inside(base, raw), None, None, e.get("size_bytes"), False
        good = e.get("download_success") is True
        if not good:
            error = "download_failed"
        elif not raw:
            error = "missing_path"
        elif path is None:
            error = "outside_base_dir"
        else:
            found = store.get_file_info(path)
            exists = found.is_file
            if not exists:
                error = "file_missing"
            else:
                size = found.size
                if size > self.most:
                    error = "too_large"
                else:
                    with store.open_input_stream(path) as f:
                        content = f.read()
        extension = (e.get("extension") or (name.rsplit(".", 1)[1] if "." in name else "")).lower().lstrip(".")
        changed = e.get("lastModified")
        try:
            modified = datetime.fromisoformat(changed.replace("Z", "+00:00")) if changed else None
        except ValueError:
            modified = None
        if modified is not None and modified.tzinfo is None:
            modified = modified.replace(tzinfo=timezone.utc)
        sha = hashlib.sha256(content).hexdigest() if content is not None else None
        return self.site, folder, name, path or raw, extension, size, e.get("id"), e.get("etag"), modified, e.get("url"), target, good, exists, sha, content, error
