"""BPE encoding and decoding by tree concatenation.

Texts split at ASCII white space, which no token of the vocabulary spans. Words
are encoded once and kept in a bounded table. A long stretch without white space
is encoded in halves, down to leaves that are encoded in parallel; then windows
around each join are encoded anew and grow until they agree with the left and
with the right half on a token. A BPE sequence is valid exactly when each pair of
neighbouring tokens is, so agreement on one token on either side is enough for
the joined sequence to be the encoding of the whole.

A null text is empty; an empty text has no tokens; null doc_ids are left out;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import freed

#: Bytes of an unsplit stretch above which it is encoded as a tree; bytes of a
#: text, or of a stretch, above which its parts go to tasks of their own.
LEAF, SPREAD = 512, 1 << 16
#: Words kept; beyond these the table starts anew. Fewer where other stages share the worker.
KEPT_WORDS, FEWER_WORDS = 500_000, 200_000
END = "</w>"
#: Words of these characters alone are their own NFC form, and the pattern below
#: splits them, in lower case, as the tokenizer file's does.
PLAIN = re.compile("[\\x21-\\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+").fullmatch
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb5\xba\xb2\xb3\xb9\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u024f]+").findall


class TreeCoder:
    """Encodes and decodes as the tokenizer file says, without special handling.

    ``leaf`` is the longest stretch that is encoded at once.
    """

    def __init__(self, path: str, leaf: int = LEAF, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.kept = leaf, kept
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.length = [len(t.removesuffix(END)) for t in self.token]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {x: bytewise.pre_tokenize_str(chr(x))[0][0] for x in range(0x21, 0x250)}

    # one stretch without white space

    def _model(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _placed(self, ids: list[int], at: int) -> list[tuple[int, int]]:
        out = []
        for i in ids:
            out.append((at, i))
            at += self.length[i]
        return out

    def leaves(self, piece: str, leaf: int) -> list[int]:
        """The bounds of the leaves of a tree of halves."""
        if len(piece) <= leaf:
            return [0, len(piece)]
        bounds, grown = [0, len(piece)], True
        while grown:
            grown, new = False, [0]
            for a, b in zip(bounds, bounds[1:]):
                if b - a > leaf:
                    new.append((a + b) // 2)
                    grown = True
                new.append(b)
            bounds = new
        return bounds

    def join(self, piece: str, left: list[tuple[int, int]], right: list[tuple[int, int]], lo: int, mid: int, hi: int) -> list[tuple[int, int]]:
        """The tokens of piece[lo:hi] from those of piece[lo:mid] and piece[mid:hi].

        The last token of whatever ends before ``hi`` was encoded as if a word
        ended there, so it never counts as agreement.
        """
        width = 16
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            i = len(left)
            while i > 0 and left[i - 1][0] >= a:
                i -= 1
            a = left[i][0] if i < len(left) else mid
            if mid - width <= lo:
                a, i = lo, 0
            window = self._placed(self._model(piece[a:b]), a)
            trusted = window if b == hi else window[:-1]
            begin, end = None, None
            if a == lo:
                begin = (0, 0)
            else:
                at = {t: k for k, t in enumerate(left[:-1]) if t[0] >= a}
                begin = next(((at[t], k) for k, t in enumerate(trusted) if t in at), None)
            if b == hi:
                end = (len(window), len(right))
            elif begin is not None:
                at = {}
                for k, t in enumerate(right[:-1]):
                    if t[0] >= b:
                        break
                    at[t] = k
                end = next(((k, at[t]) for k, t in enumerate(trusted) if t in at and k >= begin[1]), None)
            if begin is not None and end is not None:
                return left[: begin[0]] + window[begin[1] : end[0]] + right[end[1] :]
            width *= 2

    def join_all(self, piece: str, bounds: list[int], parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """Joins neighbours, level by level."""
        while len(parts) > 1:
            new_bounds, new_parts = [0], []
            for k in range(0, len(parts), 2):
                if k + 1 < len(parts):
                    new_parts.append(self.join(piece, parts[k], parts[k + 1], bounds[k], bounds[k + 1], bounds[k + 2]))
                    new_bounds.append(bounds[k + 2])
                else:
                    new_parts.append(parts[k])
                    new_bounds.append(bounds[k + 1])
            bounds, parts = new_bounds, new_parts
        return parts[0]

    def piece(self, piece: str) -> list[int]:
        """One pre-token, in the byte alphabet."""
        if len(piece) <= self.leaf:
            return self._model(piece)
        bounds = self.leaves(piece, self.leaf)
        parts = [self._placed(self._model(piece[a:b]), a) for a, b in zip(bounds, bounds[1:])]
        return [i for _, i in self.join_all(piece, bounds, parts)]

    def pieces(self, word: str) -> Iterator[str | int]:
        """The pre-tokens of a stretch of text, and the ids of control tokens in it."""
        while word:
            at, token = min(((k, t) for t in self.special if (k := word.find(t)) >= 0), default=(len(word), ""))
            if at:
                for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word[:at])):
                    yield p
            if token:
                yield self.special[token]
            word = word[at + len(token) :]

    def long_word(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(word):
            if isinstance(p, int):
                out.append(p)
            else:
                out.extend(self.piece(p))
        return out

    def _plain(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= self.kept // 2:
                self.parts.clear()
            ids = self.parts[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(part.translate(self.alphabet))]).tobytes()
        return ids

    # whole texts

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = (text or "").encode("utf-8", "replace").split()
        known = self.words
        missing = set(words).difference(known)
        if missing:
            if len(known) + len(missing) > self.kept:
                known.clear()
                missing = set(words)
            own: dict[bytes, bytes] = {}
            odd: list[bytes] = []
            for w in missing:
                text = w.decode("utf-8", "replace")
                if len(w) > self.leaf:
                    own[w] = array("I", self.long_word(text)).tobytes()
                elif PLAIN(text) and "<|" not in text:
                    known[w] = b"".join(map(self._plain, SPLIT(text.lower())))
                else:
                    odd.append(w)
            for w, e in zip(odd, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
            if own:
                return b"".join([known[w] if w in known else own[w] for w in words])
        return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> str:
        """As the library decodes: this tokenizer has no decoder, so tokens joined by spaces."""
        return " ".join(map(self.token.__getitem__, array("I", ids)))


_coders: dict[tuple[str, int, int], TreeCoder] = {}


def coder(path: str, leaf: int = LEAF, kept: int = KEPT_WORDS) -> TreeCoder:
    """One coder for each Python worker."""
    if (path, leaf, kept) not in _coders:
        _coders[path, leaf, kept] = TreeCoder(path, leaf, kept)
    return _coders[path, leaf, kept]


Finish = Callable[[TreeCoder, bytes], tuple]


def _finish_ids(c: TreeCoder, ids: bytes) -> tuple:
    return (list(array("I", ids)),)


def encode_documents(docs: DataFrame, path: str, finish: Finish = _finish_ids, fields: str = "ids array<int>", spread: int = SPREAD, leaf: int = LEAF, nameless: bool = False, kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id and what ``finish`` makes of each document's ids, by default the ids.

    Rows without an id are left out, but where ``nameless`` holds. Documents of up to ``spread`` bytes are encoded where they are read. Longer
    ones are cut; their parts are encoded in tasks of their own and joined by
    document.
    """
    docs = (docs if nameless else docs.where("doc_id is not null")).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id long, {fields}"
    arrow = _arrow_schema(docs, schema)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, leaf, kept)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [(d, *finish(c, c.encode(t))) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield _batch(rows, arrow)

    short = docs.where(F.octet_length("text") <= spread).mapInArrow(freed(near), schema)
    long = docs.where(F.octet_length("text") > spread).withColumn("row", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, leaf, kept)
        for batch in batches:
            for d, t, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = [(d, r, k, *x) for k, x in enumerate(parts_of(c, t, spread))]
                yield _batch(rows, parts_arrow)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, leaf, kept)
        for batch in batches:
            rows = []
            for d, r, k, run, kind, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = c.encode(text) if kind == "text" else array("I", [int(text)]).tobytes() if kind == "id" else array("I", c.piece(text)).tobytes()
                rows.append((d, r, k, run, kind, text, ids))
            yield _batch(rows, done_arrow)

    def merged(table: pa.Table) -> pa.Table:
        c = coder(path, leaf, kept)
        rows = sorted(zip(*(table.column(i).to_pylist() for i in (2, 3, 4, 5, 6))))
        return pa.Table.from_batches([_batch([(table.column(0)[0].as_py(), *finish(c, joined_parts(c, rows)))], arrow)])

    parts_schema = "doc_id long, row long, part int, run int, kind string, text string"
    done_schema = f"{parts_schema}, ids binary"
    parts_arrow, done_arrow = _arrow_schema(docs, parts_schema), _arrow_schema(docs, done_schema)
    parts = long.mapInArrow(freed(cut), parts_schema).repartition("doc_id", "row", "part").mapInArrow(freed(encoded), done_schema)
    return short.unionByName(parts.groupBy("doc_id", "row").applyInArrow(merged, schema))


def parts_of(c: TreeCoder, text: str, spread: int) -> Iterator[tuple[int, str, str]]:
    """(run, kind, text): texts cut at white space; leaves of each long pre-token."""
    held: list[bytes] = []
    size, run = 0, 0
    for word in text.encode("utf-8", "replace").split():
        if size + len(word) > spread and held:
            yield run, "text", b" ".join(held).decode()
            held, size = [], 0
        if len(word) <= spread:
            held.append(word)
            size += len(word) + 1
            continue
        for p in c.pieces(word.decode()):
            run += 1
            if isinstance(p, int):
                yield run, "id", str(p)
                continue
            bounds = c.leaves(p, spread)
            for a, b in zip(bounds, bounds[1:]):
                yield run, "leaf", p[a:b]
        run += 1
    if held:
        yield run, "text", b" ".join(held).decode()


def joined_parts(c: TreeCoder, rows: list[tuple]) -> bytes:
    """Rows of (part, run, kind, text, ids), in order."""
    out: list[bytes] = []
    k = 0
    while k < len(rows):
        _, run, kind, _, ids = rows[k]
        m = k + 1
        if kind == "leaf":
            while m < len(rows) and rows[m][1] == run:
                m += 1
            texts, bounds, parts = [r[3] for r in rows[k:m]], [0], []
            for _, _, _, t, i in rows[k:m]:
                parts.append(c._placed(list(array("I", i)), bounds[-1]))
                bounds.append(bounds[-1] + len(t))
            ids = array("I", [i for _, i in c.join_all("".join(texts), bounds, parts)]).tobytes()
        out.append(ids)
        k = m
    return b"".join(out)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of each row's ``ids`` (null: null)."""
    src = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    schema = "doc_id long, text string"
    arrow = _arrow_schema(src, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            yield _batch([(d, None if i is None else " ".join([c.token[x] for x in i])) for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], arrow)

    return src.mapInArrow(freed(run), schema)


def _arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema)], schema=schema)


def _finish_checked(c: TreeCoder, ids: bytes) -> tuple:
    decoded = c.decode(ids)
    return list(array("I", ids)), len(ids) // 4, hashlib.sha256(decoded.encode()).hexdigest()


def encode_with_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and the SHA-256 of the decoded text, of rows without an id too."""
    return encode_documents(docs, path, _finish_checked, "ids array<int>, n_tokens long, decoded_sha256 string", nameless=True, kept=FEWER_WORDS)
