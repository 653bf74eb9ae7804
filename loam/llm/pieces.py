"""SentencePiece (BPE) encoding and decoding by merge rounds in numpy.

The words of a chunk of texts that were not met before are one flat array of symbols. A
round finds the least rank of a pair in each word (a segmented minimum), merges all its
leftmost pairs that do not overlap at once, and closes the gaps; words without a pair that
merges leave. A word ends before a space, around a line end and between a letter and most
signs, which no piece of the model spans; a stretch also ends between any two characters that
no piece holds side by side.

Merging all pairs of one rank at once is what merging them from the left is, unless a merge
makes a pair of a better rank. The pieces for which the vocabulary allows that are known
beforehand; of those a round merges up to the first that made such a pair. Where nothing but
pairs of the last rank is left (runs of spaces here, all of one rank), long words are merged
from the left in one go.

A null text is empty; an empty text has no ids; rows without a doc_id are left out; repeated
rows give repeated results; extra columns are ignored. A text is encoded in slices of about a
million characters, so its length bounds neither rounds nor memory beyond its own ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema, _batch
from loam.llm.common import freed

SPACE = "▁"
#: Characters of texts encoded together; of a slice of a long text; of a word that is kept;
#: of a word in which neighbours that no piece covers part a stretch in every round.
CHUNK, SLICE, KEPT_LENGTH, LONG = 1 << 21, 1 << 20, 64, 64
#: Words of a table; beyond these a new one begins, and the last one is asked first.
KEPT_WORDS = 200_000
NEVER = np.int32(2**31 - 1)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class PieceCoder:
    """Encodes and decodes as the model file says, without begin or end ids."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self._refuse_other_kinds(model)
        self.kept = kept
        kind = np.array([p.type for p in model.pieces])
        text = [p.piece for p in model.pieces]
        self.size = len(text)
        self.ids = {t: i for i, t in enumerate(text) if kind[i] == _NORMAL}
        score = np.array([p.score for p in model.pieces], np.float32)
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        # symbols: pieces, then characters that occur in pieces only
        for x in [c for t in self.ids for c in t if c not in self.ids]:
            self.ids.setdefault(x, self.size + sum(i >= self.size for i in self.ids.values()))
        self.base = np.int64(max(self.ids.values()) + 1)
        self.symbol = np.full(0x110000, -1, np.int32)
        for t, i in self.ids.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        pairs: dict[int, int] = {}
        careful, beside = np.zeros(int(self.base), bool), set()
        self.texts = [t for t, i in self.ids.items() if i < self.size]
        for t in self.texts:
            i = self.ids[t]
            beside.update(self._key(a, b) for a, b in zip(t, t[1:]))
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * int(self.base) + b] = i
                    for part in (a, b):
                        careful[part] |= part < self.size and rank[part] >= rank[i]
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int32)
        self.rank = rank[self.merged]
        self.careful = careful
        self.one_pair = {k: (int(r), int(m)) for k, r, m in zip(self.pair.tolist(), self.rank, self.merged)}
        self.worst = int(self.rank.max())
        self.beside = np.array(sorted(beside), np.int64)
        self._covered: np.ndarray | None = None
        spaced = any(b == SPACE != a for t in self.texts for a, b in zip(t, t[1:]))
        lined = any("\n" in t and len(t) > 1 for t in self.texts)
        # a run of letters also ends before an ASCII sign that no piece holds after a letter
        letter = re.compile(r"[^\W\d_]").fullmatch
        after = {b for t in self.texts for a, b in zip(t, t[1:]) if letter(a)}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
        word = f"▁*[^\\W\\d_]+(?=[{signs}])|" if signs else ""
        self.words_of = (lambda t: [t] if t else []) if spaced or lined else re.compile(f"\n|{word}▁+[^▁\n]*|[^▁\n]+").findall
        self.slice_end = None if spaced or lined else re.compile("(?<=[^▁\n])▁").search
        self.byte = np.zeros(256, np.int32)
        self.raw = [b""] * self.size
        for i, t in enumerate(text):
            if kind[i] == _BYTE:
                self.raw[i] = bytes([int(t[3:5], 16)])
                self.byte[int(t[3:5], 16)] = i
            elif kind[i] == _NORMAL:
                self.raw[i] = t.replace(SPACE, " ").encode()
            elif kind[i] == _UNKNOWN:
                self.raw[i] = model.trainer_spec.unk_surface.encode()
        self.is_byte, self.control = (kind == _BYTE).tolist(), kind == _CONTROL
        self.decimal = list(map(str, range(self.size)))
        self.opens = [kind[i] == _NORMAL and t.startswith(SPACE) for i, t in enumerate(text)]
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @staticmethod
    def _refuse_other_kinds(model) -> None:
        n, t = model.normalizer_spec, model.trainer_spec
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        kinds = {p.type for p in model.pieces}
        if t.model_type != 2 or not t.byte_fallback or t.treat_whitespace_as_suffix or not plain or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only byte-fallback BPE models without normalisation and without user-defined pieces are encoded here")

    def _key(self, left: str, right: str) -> int:
        return self.ids[left] * int(self.base) + self.ids[right]

    def covered(self) -> np.ndarray:
        """Keys of the symbol pairs that lie side by side in some piece; made for the first long word."""
        if self._covered is None:
            found = set()
            for t in self.texts:
                for i in range(len(t)):
                    for j in range(i + 1, len(t)):
                        a = self.ids.get(t[i:j])
                        if a is not None:
                            found.update(a * int(self.base) + b for k in range(j + 1, len(t) + 1) if (b := self.ids.get(t[j:k])) is not None)
            self._covered = np.array(sorted(found), np.int64)
        return self._covered

    # encoding

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER where it does not merge) and what it merges to."""
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        found = self.pair[at] == keys
        return np.where(found, self.rank[at], NEVER), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words written with U+2581 for spaces, one after the other, and where
        each word's ids begin (and the last end)."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        edge = np.cumsum(lengths)
        symbol = self.symbol[code]
        final = np.full(len(code), -2, np.int32)
        self._rounds(symbol, np.arange(len(code)), edge, final, bool(len(words)) and int(lengths.max()) > LONG)
        at = np.flatnonzero(final != -2)
        out = final[at]
        odd = (out < 0) | (out >= self.size)
        n = np.ones(len(out), np.int64)
        if odd.any():
            c = code[at[odd]]
            n[odd] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            fallback = self.byte[np.frombuffer("".join(map(chr, c.tolist())).encode("utf-8", "surrogatepass"), np.uint8)]
            out, odd = np.repeat(out, n), np.repeat(odd, n)
            out[odd] = fallback
        begins = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, np.concatenate([[0], edge]))]
        return out.astype(np.uint32), begins

    def _rounds(self, symbol: np.ndarray, at: np.ndarray, edge: np.ndarray, final: np.ndarray, long: bool) -> None:
        """Puts into ``final`` each symbol that is left, at its first character."""
        n = len(symbol)
        if not n:
            return
        key = symbol[:-1] * self.base + symbol[1:]
        place = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        last = np.ones(n, bool)
        last[:-1] = (self.beside[place] != key) | (symbol[:-1] < 0) | (symbol[1:] < 0)
        last[edge[edge > 0] - 1] = True
        rank, to = np.full(n, NEVER), np.zeros(n, np.int32)
        rank[:-1], to[:-1] = self._look(key)
        rank[last] = NEVER
        while n:
            ends = np.flatnonzero(last)
            starts = np.concatenate([[0], ends[:-1] + 1])
            sizes = ends - starts + 1
            best = np.minimum.reduceat(rank, starts)
            going = np.repeat(best != NEVER, sizes)
            final[at[~going]] = symbol[~going]
            symbol, at, last, rank, to = (x[going] for x in (symbol, at, last, rank, to))
            n = len(symbol)
            if not n:
                return
            sizes, best = sizes[best != NEVER], best[best != NEVER]
            if long and ((best == self.worst) & (sizes > LONG)).any():
                alike = (best == self.worst) & (sizes > LONG)
                for a, m in zip((np.cumsum(sizes) - sizes)[alike].tolist(), sizes[alike].tolist()):
                    self._from_the_left(symbol[a : a + m].tolist(), at[a : a + m].tolist(), final)
                going = np.repeat(~alike, sizes)
                symbol, at, last, rank, to = (x[going] for x in (symbol, at, last, rank, to))
                n = len(symbol)
                continue
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # of neighbouring hits every other one, from the left
            fresh = np.ones(len(hit), bool)
            fresh[1:] = np.diff(hit) != 1
            order = np.arange(len(hit))
            chosen = (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0
            word = np.repeat(np.arange(len(sizes)), sizes)[hit]
            hit, word = hit[chosen], word[chosen]
            if self.careful[to[hit]].any():
                hit = hit[self._undisturbed(hit, word, symbol, last, rank, to)]
            symbol[hit] = to[hit]
            last[hit] = last[hit + 1]
            keep = np.ones(n, bool)
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            symbol, at, last, rank, to = (x[keep] for x in (symbol, at, last, rank, to))
            n = len(symbol)
            beside = np.zeros(n, bool)
            beside[new] = True
            beside[np.maximum(new, 1) - 1] = True
            touched = np.flatnonzero(beside)
            inner = touched[~last[touched]]
            key = symbol[inner] * self.base + symbol[inner + 1]
            rank[touched] = NEVER
            rank[inner], to[inner] = self._look(key)
            if long:  # a piece over both neighbours would hold them side by side
                covered = self.covered()
                place = np.minimum(np.searchsorted(covered, key), len(covered) - 1)
                last[inner[covered[place] != key]] = True

    def _undisturbed(self, hit: np.ndarray, word: np.ndarray, symbol: np.ndarray, last: np.ndarray, rank: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Which pairs merge before a pair of a better or equal rank arises left of them in
        their word: those up to the first merge that makes one with a neighbour."""
        made, now = to[hit], rank[hit]
        before, touching = np.zeros(len(hit), np.int32), np.zeros(len(hit), bool)
        touching[1:] = (hit[1:] == hit[:-1] + 2) & (word[1:] == word[:-1])
        before[1:] = made[:-1]
        before = np.where(touching, before, symbol[np.maximum(hit - 1, 0)])
        has_left, has_right = (hit > 0) & ~last[np.maximum(hit - 1, 0)], ~last[hit + 1]
        after = symbol[np.minimum(hit + 2, len(symbol) - 1)]
        left, right = self._look(before * self.base + made)[0], self._look(made * self.base + after)[0]
        breaks = self.careful[made] & ((has_left & (before >= 0) & (left <= now)) | (has_right & (after >= 0) & (right <= now)))
        earlier = np.cumsum(breaks) - breaks
        first = np.ones(len(hit), bool)
        first[1:] = word[1:] != word[:-1]
        return earlier == np.repeat(earlier[first], np.diff(np.append(np.flatnonzero(first), len(hit))))

    def _from_the_left(self, symbols: list[int], at: list[int], final: np.ndarray) -> None:
        """Merges a word whose pairs all have the last rank: what arises beside a merge goes
        first, the left before the right, else the leftmost."""
        base, pairs, none = int(self.base), self.one_pair, (int(NEVER), -1)
        done, where, k = [symbols[0]], [at[0]], 1
        while True:
            left = pairs.get(done[-2] * base + done[-1], none) if len(done) > 1 else none
            right = pairs.get(done[-1] * base + symbols[k], none) if k < len(symbols) else none
            if left is none and right is none:
                if k == len(symbols):
                    break
                done.append(symbols[k])
                where.append(at[k])
                k += 1
            elif left[0] <= right[0]:
                done[-2:] = [left[1]]
                where.pop()
            else:
                done[-1] = right[1]
                k += 1
        final[where] = done

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE and self.slice_end:
            cut = self.slice_end(text, at + SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodes the words that are not in the table; those too long to be kept are returned."""
        missing = [w for w in words if w not in self.words]
        if len(self.words) + len(missing) > self.kept:
            self.before, self.words = self.words, {}
            missing = list(words)
        if self.before:
            self.words.update((w, self.before[w]) for w in missing if w in self.before)
            missing = [w for w in missing if w not in self.words]
        ids, begins = self.encode_words(missing)
        raw = ids.tobytes()
        own = {}
        for w, a, b in zip(missing, (4 * begins[:-1]).tolist(), (4 * begins[1:]).tolist()):
            (self.words if len(w) <= KEPT_LENGTH else own)[w] = raw[a:b]
        return own

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        k = 0
        while k < len(texts):
            group, size = [], 0
            while k < len(texts) and (not group or size + len(texts[k] or "") <= CHUNK):
                group.append(texts[k])
                size += len(texts[k] or "")
                k += 1
            spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in group]
            if size <= SLICE or len(group) > 1:
                split = [self.words_of(t) for t in spaced]
                own = self.learn({w for s in split for w in s})
                known = self.words
                if own:
                    yield from (b"".join([known[w] if w in known else own[w] for w in s]) for s in split)
                else:
                    yield from (b"".join([known[w] for w in s]) for s in split)
                continue
            parts = []
            for part in self._slices(spaced[0]):
                split = self.words_of(part)
                own = self.learn(set(split))
                parts.append(b"".join([self.words[w] if w in self.words else own[w] for w in split]))
            yield b"".join(parts)

    # decoding

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """As the library: pieces with spaces for U+2581, runs of byte ids as UTF-8 with
        U+FFFD for each byte that is none, control ids as nothing, and no first space of the
        first piece."""
        held = np.asarray(ids, np.int64)
        control = self.control[held]
        apart = bool(control.any())  # those part runs of bytes
        ids = held.tolist()
        first = next((i for i in ids if not self.control[i]), None)
        skip = 1 if first is not None and self.opens[first] else 0
        raw = b"".join(map(self.raw.__getitem__, ids))
        if not apart:
            try:
                return raw.decode()[skip:]
            except UnicodeDecodeError:
                pass
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.raw[i]
                continue
            out.append(_byte_run(run))
            run = b""
            if i is not None:
                out.append(self.raw[i].decode())
        return "".join(out)[skip:]


def _byte_run(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        size = 1 + (run[at] >= 0xC0) + (run[at] >= 0xE0) + (run[at] >= 0xF0)
        try:
            out.append(run[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder for each Python worker."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


Finish = Callable[[PieceCoder, np.ndarray], tuple]


def _finish_ids(c: PieceCoder, ids: np.ndarray) -> tuple:
    return (ids.astype(np.int32),)


def encode_documents(docs: DataFrame, path: str, finish: Finish = _finish_ids, fields: str = "ids array<int>") -> DataFrame:
    """doc_id and what ``finish`` makes of each document's ids, by default the ids."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, {fields}"
    arrow = _arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                encoded = c.encode_many(part.column(1).to_pylist())
                yield _batch([(d, *finish(c, np.frombuffer(e, "<u4"))) for d, e in zip(part.column(0).to_pylist(), encoded)], arrow)

    return docs.mapInArrow(freed(run), schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that each row's ``ids`` stand for (null: null)."""
    src = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    schema = "doc_id long, text string"
    arrow = _arrow_schema(src, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            yield _batch([(d, None if i is None else c.decode(i)) for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], arrow)

    return src.mapInArrow(freed(run), schema)
