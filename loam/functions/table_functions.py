"""Chunkers that SQL calls: ``SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_text(d.text, 2000, 100) c``.

``register(spark)`` names them for a session. They cut as the expressions of ``chunking`` do.
``chunk_documents`` takes a table whose rows are partitioned by document, and numbers the
chunks of each document through:

    SELECT * FROM chunk_documents(TABLE(items) PARTITION BY doc_id ORDER BY (item_idx), 2000, 100)

A null or blank text has no chunks. Sizes are checked when a query is analysed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loam.functions.text import SPACES

_SPLIT = re.compile(f"[{re.escape(SPACES)}]+")
_CHUNK = StructType().add("chunk_seq", IntegerType()).add("text", StringType())


def char_windows(text: str | None, size: int, overlap: int) -> list[str]:
    if text is None:
        return []
    step = size - min(max(0, overlap), size - 1)
    windows = 1 + max(0, math.ceil((len(text) - size) / step))
    return [c for c in (text[k * step : k * step + size].strip(SPACES) for k in range(windows)) if c]


def token_windows(text: str | None, size: int, overlap: float) -> list[str]:
    words = [w for w in _SPLIT.split((text or "").strip(SPACES)) if w]
    step = max(1, round(size * (1 - min(max(overlap, 0.0), 0.5))))
    windows = 1 + max(0, math.ceil((len(words) - size) / step))
    return [c for c in (" ".join(words[k * step : k * step + size]) for k in range(windows)) if c]


def _checked(size: AnalyzeArgument) -> None:
    if not size.isConstantExpression or size.value is None or size.value <= 0:
        raise ValueError("size must be a positive constant")


@udtf
class ChunkText:
    """chunk_seq, text: windows of ``size`` characters that share ``overlap``."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _checked(size)
        return AnalyzeResult(_CHUNK)

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(char_windows(text, size, int(overlap)), 1)


@udtf
class ChunkTokens:
    """chunk_seq, text: windows of ``size`` words, the share ``overlap`` of which is shared."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _checked(size)
        return AnalyzeResult(_CHUNK)

    def eval(self, text: str, size: int, overlap: float) -> Iterator[tuple]:
        yield from enumerate(token_windows(text, size, float(overlap)), 1)


@udtf
class ChunkDocuments:
    """doc_id, item_idx, chunk_seq, text: windows of characters of a document's items, numbered
    through; needs the table PARTITION BY doc_id ORDER BY item_idx, and holds one item at a time."""

    def __init__(self) -> None:
        self.n = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _checked(size)
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        types = {f.name: f.dataType for f in rows.dataType}
        if not {"doc_id", "item_idx", "text"} <= set(types):
            raise ValueError("the table needs doc_id, item_idx and text")
        schema = StructType().add("doc_id", types["doc_id"]).add("item_idx", types["item_idx"])
        return AnalyzeResult(schema.add("chunk_seq", IntegerType()).add("text", StringType()))

    def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
        for c in char_windows(row["text"], size, int(overlap)):
            self.n += 1
            yield row["doc_id"], row["item_idx"], self.n, c


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("chunk_tokens", ChunkTokens)
    spark.udtf.register("chunk_documents", ChunkDocuments)
