"""Collocations: phrases mined level by level, scored by their weakest cut.

Each level is one pass over the texts. A chunk of texts is split in numpy and its words are
numbered, so that a chunk sends each of its distinct phrases once, with its count. From the
second level on, a phrase is emitted only where both phrases of one word less that it holds
are frequent (Apriori). These reach the tasks as a bitmap of hashes whose size has a fixed
bound, whatever the number of frequent phrases: a false hit emits a phrase that its own
count then drops, so results do not depend on the bitmap. The scores come from joins of the
level tables.

All rows count, with or without a doc_id; a null text is empty; a null language is ``und``;
repeated rows count each time; empty tables give no rows; extra columns are ignored. A text
longer than a chunk is cut at the marks between pieces, a piece longer than that at a space,
with the words before it that a phrase may need.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema
from loam.llm.common import freed, materialize, release

#: Bytes of a chunk; bits of the bitmap for each frequent phrase, and at most.
CHUNK, BITS_EACH, MOST_BITS = 1 << 23, 16, 1 << 28
#: What each byte becomes: A-Z lower case, marks between pieces a line end, tab a space.
FOLD = bytes(x + 32 if 65 <= x < 91 else 10 if x in b".,;:!?\n\x0b\x0c\r" else 32 if x == 9 else x for x in range(256))
NO_LANGUAGE = "und"


def folded_words(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of some texts and the number of the piece each is in."""
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]).translate(FOLD), np.uint8)
    border = raw == 10
    inside = ~border & (raw != 32)
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[inside])])
    return words, np.searchsorted(np.flatnonzero(border), start)


def _cut(text: bytes, size: int, overlap: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text and how many words of each belong to the one before."""
    at, before = 0, 0
    while len(text) - at > size:
        part = text[at : at + size].translate(FOLD)
        border = part.rfind(b"\n")
        if border > 0:
            yield text[at : at + border], before
            at, before = at + border, 0
            continue
        space = part.rfind(b" ")
        words = part[:space].split() if space > 0 else []
        if len(words) <= overlap + before:  # a word of a chunk's length: the text goes as it is
            break
        yield text[at : at + space], before
        back = space
        for _ in range(overlap):
            back = part[:back].rstrip(b" ").rfind(b" ")
        at, before = at + back, overlap
    yield text[at:], before


class _Filter:
    """Tests phrases against the bitmap of the level below."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.mask = len(bits) * 8 - 1

    def holds(self, lang: bytes, phrases: pa.Array) -> np.ndarray:
        digest = functools.partial(xxhash.xxh64_intdigest, seed=42)
        prefix = lang + b"\x00"
        out = np.zeros(len(phrases), bool)
        for k in range(0, len(phrases), 1 << 16):
            part = phrases.slice(k, 1 << 16).to_pylist()
            at = np.fromiter((digest(prefix + p) & self.mask for p in part), np.int64, len(part))
            out[k : k + len(part)] = (self.bits[at >> 3] >> (at & 7)) & 1
        return out


def _place(bits: int) -> Column:
    """Spark's xxhash64 has the seed 42 and the same bytes."""
    return F.xxhash64(F.concat("lang", F.lit("\x00"), "phrase")).bitwiseAND(F.lit(bits - 1))


def bitmap(level: DataFrame) -> bytes:
    """A bitmap of the hashes of a level's phrases, MOST_BITS at most."""
    n = level.count()
    bits = 1 << 16
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits *= 2
    place = level.select(_place(bits).alias("p"))
    words = place.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
    found = words.toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.tobytes()


def _joined(left: pa.Array, right: pa.Array, key: np.ndarray, base: int) -> pa.Array:
    """Spellings of pairs: key // base numbers the left one, key % base the right one."""
    return pc.binary_join_element_wise(left.take(pa.array(key // base)), right.take(pa.array(key % base)), pa.scalar(b" ", pa.large_binary()))


def chunk_counts(lang: bytes, texts: list[bytes], counted: int, length: int, below: _Filter | None) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of ``length`` words of some texts that the filter lets through, and
    their counts; phrases that end within the first ``counted`` words are another part's."""
    words, piece = folded_words(texts)
    held = words.dictionary_encode()
    code, names = held.indices.to_numpy().astype(np.int64), held.dictionary
    if length == 1:
        n = np.bincount(code[counted:], minlength=len(names))
        return names.filter(pa.array(n > 0)), n[n > 0]
    base = max(len(names), 1)
    together = piece[:-1] == piece[1:]
    # numbers and spellings of the phrases of one word less, by the word they begin with
    number, spelled = code, names
    for m in range(2, length):
        ok = (number[:-1] >= 0) & together[m - 2 :]
        key, place = np.unique(number[:-1][ok] * base + code[m - 1 :][ok], return_inverse=True)
        spelled = _joined(spelled, names, key, base)
        number = np.full(len(ok), -1)
        number[ok] = place
    good = np.append(below.holds(lang, spelled), False)[number]
    ok = good[:-1] & good[1:] & together[length - 2 :]
    ok[: max(counted - length + 1, 0)] = False
    key, n = np.unique(number[:-1][ok] * base + code[length - 1 :][ok], return_counts=True)
    return _joined(spelled, names, key, base), n


def phrase_counts(texts: DataFrame, length: int, below: Broadcast | None, chunk: int) -> DataFrame:
    """lang, phrase and n of all phrases of ``length`` words that the filter lets through, not
    yet summed; at length 1 also the number of all words, with a null phrase."""
    fields = "lang string, phrase string, n long"
    schema = _arrow_schema(texts, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _Filter(below.value) if below else None
        held: dict[str, list[bytes]] = {}

        def rows(lang: str, parts: list[bytes], counted: int = 0) -> Iterator[pa.RecordBatch]:
            phrases, n = chunk_counts(lang.encode(), parts, counted, length, passes)
            counts = pa.array(n, pa.int64())
            for k in range(0, len(phrases), 1 << 16):
                names = phrases.slice(k, 1 << 16).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), names, counts.slice(k, 1 << 16)], schema=schema)
            if length == 1 and len(n):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.array([int(n.sum())], pa.int64())], schema=schema)

        size = 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            sizes = pc.binary_length(column).fill_null(0).to_pylist()
            for k, (lang, m) in enumerate(zip(batch.column(0).to_pylist(), sizes)):
                if m > chunk:
                    for part, counted in _cut(column[k].as_py(), chunk, length - 1):
                        yield from rows(lang, [part], counted)
                elif m:
                    if size + m > chunk:
                        for of, parts in held.items():
                            yield from rows(of, parts)
                        held, size = {}, 0
                    held.setdefault(lang, []).append(column[k].as_py())
                    size += m
        for of, parts in held.items():
            yield from rows(of, parts)

    return texts.mapInArrow(freed(run), fields)


def levels(docs: DataFrame, longest: int = 3, least: int = 10, language: str = "lang", chunk: int = CHUNK) -> tuple[list[DataFrame], DataFrame]:
    """The tables (lang, phrase, f) of phrases of 1 to ``longest`` words found ``least`` times or
    more, and (lang, n), the number of all words."""
    texts = docs.select(F.coalesce(F.col(f"`{language}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))
    first = phrase_counts(texts, 1, None, chunk).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    counted = materialize(first.where(f"phrase is null or f >= {least}"), "phrases-1")
    out = [counted.where("phrase is not null")]
    total = counted.where("phrase is null").select("lang", F.col("f").alias("n"))
    sc = docs.sparkSession.sparkContext
    for length in range(2, longest + 1):
        below = sc.broadcast(bitmap(out[-1]))
        counts = phrase_counts(texts, length, below, chunk).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(f"f >= {least}")
        out.append(materialize(counts, f"phrases-{length}"))
        below.unpersist()
    out[0]._loam_path = counted._loam_path
    return out, total


def _part(begin: int, n: int) -> Column:
    """Words ``begin`` to ``begin + n - 1`` of the phrase, the first being 0."""
    return F.array_join(F.slice(F.split("phrase", " "), begin + 1, n), " ")


def cut_scores(tables: list[DataFrame], scale: int = 1_000_000) -> DataFrame:
    """lang, phrase, length, a, l, r, score of all phrases of two or more words: the cut with
    the least floor(scale * a * a / (l * r)), the earliest of equals. Products are decimals."""
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    out = None
    for length in range(2, len(tables) + 1):
        cuts = None
        for k in range(1, length):
            left = tables[k - 1].select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
            right = tables[length - k - 1].select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
            whole = tables[length - 1].select("lang", "phrase", F.col("f").alias("a"), _part(0, k).alias("left"), _part(k, length - k).alias("right"))
            both = whole.join(left, ["lang", "left"]).join(right, ["lang", "right"])
            one = both.select("lang", "phrase", "a", F.lit(k).alias("k"), "l", "r")
            cuts = one if cuts is None else cuts.unionByName(one)
        product = (F.lit(scale).cast("decimal(7,0)") * (wide("a") * wide("a"))).cast("decimal(38,0)")
        scored = cuts.withColumn("product", product).withColumn("score", F.expr("product div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
        least = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")) if length > 2 else scored.select("lang", "phrase", "a", F.struct("score", "k", "l", "r").alias("c"))
        level = least.select("lang", "phrase", F.lit(length).alias("length"), "a", "c.l", "c.r", "c.score")
        out = level if out is None else out.unionByName(level)
    return out


def swallowed(tables: list[DataFrame], percent: int) -> DataFrame:
    """lang and phrase of candidates that a longer one holds with ``percent`` of their count."""
    out = None
    for length in range(3, len(tables) + 1):
        for inner in range(2, length):
            parts = tables[length - 1].select("lang", "f", F.explode(F.array_distinct(F.array(*(_part(k, inner) for k in range(length - inner + 1))))).alias("phrase"))
            most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
            hit = tables[inner - 1].join(most, ["lang", "phrase"]).where(f"100 * cast(longer as decimal(20,0)) >= {percent} * cast(f as decimal(20,0))").select("lang", "phrase")
            out = hit if out is None else out.unionByName(hit)
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, language: str = "lang", chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language by score, count
    and phrase. Phrases swallowed by a longer one are left out. A language may hold most phrases:
    the first of each of many parts of it are found before those of the whole."""
    tables, total = levels(docs, longest, least, language, chunk)
    spark = docs.sparkSession
    scored = cut_scores(tables)
    if longest > 2:
        scored = scored.join(swallowed(tables, percent).distinct(), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
    out = materialize(out, "phrases")
    release(*tables)
    return out
