"""Token-id files with shuffled bit or byte planes.

Documents are dealt into ranges of ascending doc_id; each range is a segment.
The ids of a segment, each document closed by an end id, run through blocks of a
fixed size. A block's ids are transposed into planes (one for each byte, or each
bit, of the ids), each plane is compressed by zstandard, and planes that hold
only zeros take no bytes. The container is a Parquet folder: a row is a chunk,
with its planes and its part of the index (which documents' ids lie where), so
Spark's own commit protocol keeps files whole when executors are lost, and a
reader that wants some documents opens their chunks alone.

A null text is empty and gives the end id alone; null doc_ids are left out; rows
that repeat an id are stored one after the other; an empty table gives an empty
folder; extra columns are ignored. A document may span any number of chunks.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema, coder
from loam.llm.common import freed, ids_and_texts
from loam.llm.ranges import default_ranges, in_ranges, range_bounds

BLOCK = 1 << 16
CHUNKS = "segment int, chunk int, id_start long, n_ids int, planes array<binary>, crc long, doc_ids array<long>, ordinals array<long>, doc_starts array<int>, doc_lengths array<int>, begins array<boolean>"


def to_planes(ids: np.ndarray, planes: str = "byte", level: int = 3) -> list[bytes]:
    """The compressed planes of a block of unsigned 32-bit ids."""
    import zstandard

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows = np.ascontiguousarray(raw.T)
    else:
        rows = np.packbits(np.ascontiguousarray(np.unpackbits(raw, axis=1, bitorder="little").T), axis=1, bitorder="little")
    out = zstandard.ZstdCompressor(level=level)
    return [out.compress(r.tobytes()) if r.any() else b"" for r in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block; 4 planes are bytes, 32 are bits."""
    import zstandard

    inflate = zstandard.ZstdDecompressor()
    width = n if len(planes) == 4 else (n + 7) // 8
    rows = np.zeros((len(planes), width), np.uint8)
    for k, p in enumerate(planes):
        if p:
            rows[k] = np.frombuffer(inflate.decompress(p, max_output_size=width), np.uint8)
    if len(planes) == 4:
        raw = np.ascontiguousarray(rows.T)
    else:
        raw = np.packbits(np.ascontiguousarray(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T), axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class _Writer:
    """One segment at a time; holds less than a block and one document's ids."""

    def __init__(self, schema: pa.Schema, planes: str):
        self.schema, self.planes = schema, planes
        self.segment: int | None = None

    def _begin(self, segment: int) -> None:
        self.segment, self.chunk, self.id_start, self.ordinal = segment, 0, 0, 0
        self.held: list[np.ndarray] = []
        self.size = 0
        self.slices: list[tuple] = []

    def _flush(self) -> dict:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        row = {"segment": self.segment, "chunk": self.chunk, "id_start": self.id_start, "n_ids": len(ids), "planes": to_planes(ids, self.planes), "crc": zlib.crc32(ids.tobytes())}
        row |= dict(zip(("doc_ids", "ordinals", "doc_starts", "doc_lengths", "begins"), map(list, zip(*self.slices))))
        self.chunk, self.id_start = self.chunk + 1, self.id_start + len(ids)
        self.held, self.size, self.slices = [], 0, []
        return row

    def rows(self, segment: int, doc_id: int, ids: np.ndarray) -> Iterator[dict]:
        if segment != self.segment:
            yield from self.last()
            self._begin(segment)
        at = 0
        while at < len(ids):
            take = min(BLOCK - self.size, len(ids) - at)
            self.held.append(ids[at : at + take])
            self.slices.append((doc_id, self.ordinal, self.size, take, at == 0))
            self.size += take
            at += take
            if self.size == BLOCK:
                yield self._flush()
        self.ordinal += 1

    def last(self) -> Iterator[dict]:
        if self.segment is not None and self.size:
            yield self._flush()


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, planes: str = "byte", ranges: int | None = None) -> None:
    """Encode every document and write the folder at ``path``."""
    src = ids_and_texts(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    bounds = range_bounds(src, "doc_id", ranges or default_ranges(src, size), size)
    dealt = in_ranges(src, "doc_id", bounds).withColumnRenamed("range", "segment").drop("place").sortWithinPartitions("segment", "doc_id", "text")
    arrow = _arrow_schema(src, CHUNKS)
    close = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        out = _Writer(arrow, planes)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for segment, d, t in zip(*(part.column(n).to_pylist() for n in ("segment", "doc_id", "text"))):
                    rows = list(out.rows(segment, d, np.frombuffer(c.encode(t) + close, "<u4")))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if rows := list(out.last()):
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    dealt.mapInArrow(freed(run), CHUNKS).write.option("compression", "none").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromDDL(CHUNKS)).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """segment, ordinal, doc_id, chunk, ids: a row for each part of a document in a chunk."""
    schema = "segment int, ordinal long, doc_id long, chunk int, ids array<int>"
    return _slices(read_chunks(spark, path), schema, lambda row, s, ids: (row["segment"], s[1], s[0], row["chunk"], ids.tolist()))


def _slices(chunks: DataFrame, schema: str, make) -> DataFrame:
    arrow = _arrow_schema(chunks, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"])
                if zlib.crc32(ids.tobytes()) != row["crc"]:
                    raise ValueError(f"segment {row['segment']}, chunk {row['chunk']}: its checksum differs")
                rows = [make(row, s, ids[s[2] : s[2] + s[3]]) for s in zip(row["doc_ids"], row["ordinals"], row["doc_starts"], row["doc_lengths"])]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    return chunks.mapInArrow(freed(run), schema)


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2), modulo that of crc32 (bits reversed)."""
    product = 0
    while a:
        if a & 0x80000000:
            product ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def crc_of_both(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings put together."""
    power, square, n = 0x80000000, 0x40000000, second_bytes * 8
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    chunks = read_chunks(spark, path)
    totals = {r["segment"]: r["n"] for r in chunks.groupBy("segment").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = [0] * (max(totals, default=0) + 1), 0
    for s in range(len(before)):
        before[s] = total
        total += totals.get(s, 0)
    schema = "segment int, ordinal long, doc_id long, chunk int, start long, n long, crc long"
    slices = _slices(chunks, schema, lambda row, s, ids: (row["segment"], s[1], s[0], row["chunk"], row["id_start"] + s[2], len(ids), zlib.crc32(ids.tobytes())))
    whole = slices.groupBy("segment", "ordinal", "doc_id").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("chunk", "n", "crc"))).alias("parts"))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    arrow = _arrow_schema(chunks, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = crc = 0
                for p in r["parts"]:
                    crc = crc_of_both(crc, p["crc"], 4 * p["n"]) if n else p["crc"]
                    n += p["n"]
                rows.append((r["doc_id"], before[r["segment"]] + r["start"], n, crc))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows) if rows else [()] * 4, arrow)], schema=arrow)

    return whole.mapInArrow(freed(run), out)
