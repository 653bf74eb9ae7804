"""Alignment of two tokenizers over the same text, and how often their tokens are linked.

A is a byte-level BPE, B a SentencePiece BPE. Both part a text before a space or a line end
that follows a character that is no white space, and between a letter and most signs, so the
text falls into units that either encodes alone. The B tokens of all new units of a chunk, end to end, are a static interval
index: each A token is a stabbing query that bisects their ends and beginnings for the B
tokens it overlaps. What a query spans is marked on the gaps between B tokens by differences
and a running sum; gaps that none spans are the borders of groups.

Counts come from all documents. A chunk of texts sends each id pair once, with the number of
its documents that hold it; sums of these are the pair counts, and each chunk gets back those
of its own pairs. So a pair that every document holds travels once a chunk, and no table of
pairs is broadcast.

Texts that are null or empty, or whose A or B tokens do not add up to a space and the text, have
no tokens: zeros. Rows without a doc_id are left out; repeated rows are documents of their own;
extra columns are ignored. Long texts are read in slices; a document's distinct pairs, at most
the product of the vocabularies, are held in one task, as are the distinct ids of one group.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema
from loam.llm.common import freed, materialize, release
from loam.llm.pieces import SPACE, PieceCoder

#: Characters of a chunk; of a slice of a long text; units kept for each worker.
CHUNK, SLICE, KEPT_UNITS = 1 << 22, 1 << 20, 300_000
#: White space as the byte-level tokenizers' pattern has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class Units:
    """The units met so far: their numbers of tokens and groups, group texts and id pairs."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        made = json.loads(self.a.to_str())
        split = made["pre_tokenizer"] or {}
        if made["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or made["post_processor"]:
            raise ValueError("A must be a byte-level BPE without normalisation or prefix space")
        # the byte alphabet: printable bytes stand for themselves, others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}
        size = self.a.get_vocab_size(with_added_tokens=True)
        text = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in text]
        self.length_a = np.array([len(b) for b in self.bytes_a])
        self.b = PieceCoder(path_b)
        self.length_b = np.array([len(b) for b in self.b.raw])
        self.decimal = list(map(str, range(max(size, self.b.size))))
        white = re.compile(f"[{WHITE}]").fullmatch
        inside = {y for t in self.b.texts for x, y in zip(t, t[1:]) if x != SPACE and not white(x)}
        if SPACE in inside or "\n" in inside:
            raise ValueError("B has pieces that go on over a space or a line end")
        stuck = "".join(y for y in inside if white(y))
        more = f"(?:[{stuck}][{WHITE}]*)?" if stuck else ""
        # a run of letters also ends before an ASCII sign that no piece holds after a letter
        letter = re.compile(r"[^\W\d_]").fullmatch
        after = {y for t in self.b.texts for x, y in zip(t, t[1:]) if letter(x)}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
        word = f"[{WHITE}]*[^\\W\\d_]+(?=[{signs}])|" if signs else ""
        self.units_of = re.compile(f"{word}[{WHITE}]*(?:[^{WHITE}]+{more})+|[{WHITE}]+").findall
        self.slice_end = re.compile(f"(?<=[^{WHITE}])[ \n]").search
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.n = np.zeros((4, 0), np.int64)  # A tokens, B tokens, groups, whether bytes differ
        self.begin, self.key, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keeps the units met most, half of the table at most."""
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > KEPT_UNITS // 2:
            keep = np.sort(keep[np.argpartition(-self.hits[keep], KEPT_UNITS // 2)[: KEPT_UNITS // 2]])
        names, groups = list(self.known), self.groups  # in the order of their numbers
        self.known = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.groups = [groups[i] for i in keep.tolist()]
        at = self._pairs_of(keep)
        self.begin = np.concatenate([[0], np.cumsum(self.begin[keep + 1] - self.begin[keep])])
        self.key, self.times = self.key[at], self.times[at]
        self.n, self.hits = self.n[:, keep], self.hits[keep] // 2

    def _pairs_of(self, flat: np.ndarray) -> np.ndarray:
        """Where the id pairs of some units are, one unit after the other."""
        sizes = self.begin[flat + 1] - self.begin[flat]
        return np.repeat(self.begin[flat] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > KEPT_UNITS and self.known:
            self.shrink()
            new = [u for u in units if u not in self.known]
        if not new:
            return
        ids_a = [e.ids for e in self.a.encode_batch(new, add_special_tokens=False)]
        b, begin_b = self.b.encode_words([u.replace(" ", SPACE) for u in new])
        n_a, n_b = np.fromiter(map(len, ids_a), np.int64, len(new)), np.diff(begin_b)
        flat_a = list(chain.from_iterable(ids_a))
        a, b = np.array(flat_a, np.int64), b.astype(np.int64)
        raw = [u.encode() for u in new]
        size = np.fromiter(map(len, raw), np.int64, len(new))
        same = (_sums(self.length_a[a], n_a) == size) & (_sums(self.length_b[b], n_b) == size)
        whole = b"".join(raw)
        if not same.all() or b"".join(map(self.bytes_a.__getitem__, flat_a)) != whole or b"".join(map(self.b.raw.__getitem__, b.tolist())) != whole:
            ids_b = np.split(b, begin_b[1:-1])
            same = np.array([b"".join(map(self.bytes_a.__getitem__, x)) == u == b"".join(map(self.b.raw.__getitem__, y.tolist())) for u, x, y in zip(raw, ids_a, ids_b)], bool)
            a, b, n_a, n_b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)], n_a * same, n_b * same
        group_a, group_b = aligned(self.length_a[a], self.length_b[b])
        unit_a = np.repeat(np.arange(len(new)), n_a)
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        unit = np.zeros(n_groups, np.int64)
        unit[group_a] = unit_a
        per_unit = np.bincount(unit, minlength=len(new))
        text = self._group_texts(a, group_a, b, group_b, n_groups)
        ends = np.cumsum(per_unit)
        self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.groups += [text[y - 1] if m == 1 else ";".join(text[y - m : y]) for y, m in zip(ends.tolist(), per_unit.tolist())]
        key, times, of = linked(a, group_a, b, group_b, n_groups)
        of = unit[of]
        order = np.lexsort((key, of))
        of, key, times = _summed(of[order], key[order], times[order])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.n = np.concatenate([self.n, [n_a, n_b, per_unit, ~same]], axis=1)
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.bincount(of, minlength=len(new)))])
        self.key, self.times = np.concatenate([self.key, key]), np.concatenate([self.times, times])

    def _group_texts(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n_groups: int) -> list[str]:
        end_a, end_b = (np.searchsorted(g, np.arange(n_groups), side="right").tolist() for g in (group_a, group_b))
        a, b = list(map(self.decimal.__getitem__, a.tolist())), list(map(self.decimal.__getitem__, b.tolist()))
        out = []
        i = j = 0
        for x, y in zip(end_a, end_b):
            out.append(f"{a[i] if x - i == 1 else ','.join(a[i:x])}|{b[j] if y - j == 1 else ','.join(b[j:y])}")
            i, j = x, y
        return out

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE and (cut := self.slice_end(text, at + SLICE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def measure(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each stretch of text the row of four numbers (see ``n``) and its groups; then
        stretch, key and times of all distinct id pairs."""
        split = [self.units_of(t) for t in texts]
        self.learn(set().union(*split))
        known, groups = self.known.__getitem__, self.groups.__getitem__
        index = [list(map(known, s)) for s in split]
        text = [";".join(map(groups, s)) for s in index]
        flat = np.fromiter(chain.from_iterable(index), np.int64)
        self.hits += np.bincount(flat, minlength=len(self.hits))
        row = np.repeat(np.arange(len(texts)), [len(s) for s in index])
        n = np.stack([np.bincount(row, self.n[k][flat], len(texts)).astype(np.int64) for k in range(4)])
        at = self._pairs_of(flat)
        row = np.repeat(row, self.begin[flat + 1] - self.begin[flat])
        key, times = self.key[at], self.times[at]
        order = np.lexsort((key, row))
        return n, text, *_summed(row[order], key[order], times[order])


def aligned(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, from their lengths over the same bytes."""
    if not len(length_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    first = np.searchsorted(end_b, end_a - length_a, side="right")
    after = np.searchsorted(end_b - length_b, end_a, side="left")
    spans = np.zeros(len(length_b) + 1, np.int64)
    np.add.at(spans, first + 1, 1)
    np.add.at(spans, after, -1)
    border = np.cumsum(spans)[: len(length_b)] == 0
    group_b = np.cumsum(border) - 1 + (0 if border[0] else 1)
    return group_b[first], group_b


def _summed(row: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums ``times`` of equal (row, key), which are sorted."""
    if not len(row):
        return row, key, times
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.add.reduceat(times, at)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of ``sizes`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def _counted(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, group))
    return _summed(group[order], ids[order], np.ones(len(ids), np.int64))


def linked(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key (A id, then B id in the low 32 bits), number of links and group of each group's id pairs."""
    g_a, id_a, n_a = _counted(a, group_a)
    g_b, id_b, n_b = _counted(b, group_b)
    per_b = np.bincount(g_b, minlength=n_groups)
    begin_b = np.cumsum(per_b) - per_b
    partners = per_b[g_a]
    left = np.repeat(np.arange(len(g_a)), partners)
    right = np.repeat(begin_b[g_a] - np.cumsum(partners) + partners, partners) + np.arange(int(partners.sum()))
    return id_a[left] << 32 | id_b[right], n_a[left] * n_b[right], g_a[left]


_units: dict[tuple[str, str], Units] = {}


def _of_worker(path_a: str, path_b: str) -> Units:
    if (path_a, path_b) not in _units:
        _units[path_a, path_b] = Units(path_a, path_b)
    return _units[path_a, path_b]


def _documents(units: Units, docs: list[tuple[int, str]]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (doc_id, n_a, n_b, n_groups, n_links, groups_sha256), and the number of the
    document, key and times of all id pairs."""
    total = np.zeros((4, len(docs)), np.int64)
    shas = [hashlib.sha256() for _ in docs]
    found: list[tuple] = []
    held: list[tuple[int, str]] = []

    def flush() -> None:
        n, text, row, key, times = units.measure([t for _, t in held])
        of = np.array([k for k, _ in held])
        for j in range(4):
            np.add.at(total[j], of, n[j])
        begun: set[int] = set()
        for k, t in zip(of.tolist(), text):
            shas[k].update((";" + t if k in open_rows or k in begun else t).encode())
            begun.add(k)
        open_rows.update(begun)
        found.append((of[row], key, times))
        held.clear()

    open_rows: set[int] = set()
    size = 0
    for k, (_, t) in enumerate(docs):
        for s in units.slices(" " + t) if t else ():
            held.append((k, s))
            size += len(s)
            if size >= SLICE:
                flush()
                size = 0
    if held:
        flush()
    row, key, times = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    if len(found) > 1:
        order = np.lexsort((key, row))
        row, key, times = _summed(row[order], key[order], times[order])
    whole = (total[3] == 0) & (total[0] > 0)
    kept = whole[row]
    row, key, times = row[kept], key[kept], times[kept]
    links = np.zeros(len(docs), np.int64)
    np.add.at(links, row, times)
    rows = [(d, *(total[:3, k].tolist() if w else (0, 0, 0)), n, shas[k].hexdigest() if w else "") for k, ((d, _), w, n) in enumerate(zip(docs, whole.tolist(), links.tolist()))]
    return rows, row, key, times


LINKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>, kind string"


def document_links(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of kind ``document``, one for each, with its distinct id pairs (``a``, ``b``) and
    their numbers of links (``times``); and one of kind ``chunk`` for each chunk of documents,
    with its distinct pairs and the numbers of documents that hold them."""
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = _arrow_schema(src, LINKS)

    def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    def rows_of(number: int, held: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        rows, row, key, times = _documents(_of_worker(path_a, path_b), held)
        distinct, n = np.unique(key, return_counts=True)
        own = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()])]
        begin = np.searchsorted(row, np.arange(len(rows) + 1))
        pairs = [lists(x, begin) for x in (key >> 32, key & 0xFFFFFFFF, times)]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), *own, *pairs, pa.array(["document"] * len(rows))], schema=schema)
        edge = np.array([0, len(distinct)])
        pairs = [lists(x, edge) for x in (distinct >> 32, distinct & 0xFFFFFFFF, n)]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.nulls(1, schema.field(k + 1).type) for k in range(6)), *pairs, pa.array(["chunk"])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, str]] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if held and size + len(t or "") > chunk:
                        yield from rows_of(number, held)
                        number, held, size = number + 1, [], 0
                    held.append((d, t or ""))
                    size += len(t or "") + 64
        if held:
            yield from rows_of(number, held)

    return src.mapInArrow(freed(run), LINKS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked) and best (whether no pair of ``a`` has
    a higher one), from a, b, n."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_documents(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """One row for each document: its tokens, groups and links, how many links are the best of
    their A id, the sum of the counts over its links, and the digest of its groups."""
    found = materialize(document_links(docs, path_a, path_b, chunk), "alignment-links", "kind")
    pairs = found.where("kind = 'chunk'").select("chunk", F.explode(F.arrays_zip("a", "b", F.col("times").alias("n"))).alias("p")).select("chunk", "p.a", "p.b", "p.n")
    counts = materialize(pair_counts(pairs), "alignment-counts")
    answers = pairs.join(counts, ["a", "b"]).select(F.col("chunk").alias("of"), (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"), "count", "best")
    texts = found.where("kind = 'document'").drop("kind")
    schema = _arrow_schema(texts, SCORED)

    def scored(docs: pa.Table, asked: pa.Table) -> pa.Table:
        docs, asked = docs.combine_chunks(), asked.combine_chunks()
        key = asked.column("key").to_numpy()
        order = np.argsort(key)
        key, count, best = key[order], asked.column("count").to_numpy()[order], asked.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        a, b, times = (docs.column(c).combine_chunks() for c in ("a", "b", "times"))
        a, b, times = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (a, b, times))
        row = np.repeat(np.arange(docs.num_rows), np.diff(a.offsets.to_numpy()))
        own = a.flatten().to_numpy().astype(np.int64) << 32 | b.flatten().to_numpy()
        n = times.flatten().to_numpy().astype(np.int64)
        at = np.searchsorted(key, own)
        np.add.at(total, row, n * count[at])
        np.add.at(n_best, row, n * best[at])
        out = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        out |= {"n_best": pa.array(n_best), "count_sum": pa.array(total)}
        return pa.Table.from_arrays([out[f.name] for f in schema], schema=schema)

    out = materialize(texts.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(scored, SCORED), "alignment")
    release(found, counts)
    return out
