"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

A token's probability is that of its class, given the tokens before it, times that
of the token within its class, given the two words before it. The first factor is a
softmax whose logits are sums of rows of a hashed table of weights, one for each n-gram
or skip feature of the history. The second is, for each pair of words that the training
texts have, the discounted relative count of what followed it, and what the discount
leaves goes to the token's smoothed relative count in its class.

1. Token counts of all training texts: one aggregation, as large as the vocabulary.
2. The ``HEAD`` most frequent words (a bound) travel to all tasks. Every text is
   turned into symbols: frequent words, and for other words a bucket by word end.
3. Neighbours of symbols are counted over all training texts, and symbols with
   like neighbours form a class. The sentence end has a class of its own.
4. Weights: the training texts are dealt into ``SHARDS`` parts; for each, tasks
   sum the gradient over all their tokens, rounds of aggregation sum the tasks' blocks,
   and the weights take a step scaled by each feature's curvature.
5. Every text is scored in sparse numpy batches: rows of weights are gathered,
   added up and normalised.
6. What followed each pair of words is counted over all training texts, in a table of hashed
   trigrams that grows with them and is never in one place: chunks of texts send each
   different trigram once to a bucket, which counts, and answers with what the
   trigrams add to each text. The weights of these features have a closed form, so
   no gradient is taken for them.

Counts of the words that did not travel reach the texts by a join on the word, so
base scores are exact for a vocabulary of any size. Words are named by 64-bit hashes.

Null texts are empty: one end token. Null doc_ids are left out. Rows that repeat
an id are scored, and learned from, each. Without training texts all counts are
zero. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema, _batch
from loam.llm.common import freed, materialize, texts_with_hash
from loam.llm.words import as_bytes, mix, words_and_endings

#: Bounds of what all tasks hold: words with their counts; words that are symbols of
#: their own, buckets of the others, neighbours that tell symbols apart; classes;
#: rows of weights.
HEAD, OWN, BUCKETS, NEIGHBOURS, CLASSES, ROWS = 60_000, 4096, 128, 64, 32, 1 << 14
SHARDS, EPOCHS, RATE, FEATURES = 8, 1, 0.7, 4
FLUSH, CHUNK, BLOCKS, BATCH = 500_000, 50_000, 8, 1024
#: Bytes and texts (whose numbers take a byte) of a chunk; tokens of a bucket of trigrams,
#: on average.
CHUNK_BYTES, CHUNK_TEXTS, BUCKET = 500_000, 256, 5 << 17
#: Four weights of this size and a bias stay within what an exponent can take.
LARGEST = 15.0
#: Tables of tasks that are added at once.
FAN = 64
SYMBOLS = 1 + OWN + BUCKETS  # 0 is the end
FOLDS, HELD = 7, 2
#: The word that ends each text.
END = np.uint64(0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD


def _emit(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, by the bytes of their ``text``."""
    for batch in batches:
        size = np.cumsum([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column("text")])
        first = 0
        while first < batch.num_rows:
            before = size[first - 1] if first else 0
            last = min(batch.num_rows, first + CHUNK_TEXTS, max(first + 1, int(np.searchsorted(size, before + CHUNK_BYTES, side="right"))))
            yield batch.slice(first, last - first)
            first = last


def token_counts(docs: DataFrame) -> DataFrame:
    """word (its hash), ending (the bucket of its end), c over all texts given."""
    schema = "word long, ending int, c long"
    arrow = _arrow_schema(docs, schema)

    def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        word, ending, count = (np.concatenate(x) for x in zip(*held))
        words, first, own = np.unique(word, return_index=True, return_inverse=True)
        return words, ending[first], np.bincount(own, count, len(words)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def out() -> pa.RecordBatch:
            words, ending, counts = summed([*held, (np.array([END]), np.zeros(1, np.int32), np.array([texts]))])
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ending), pa.array(counts)], schema=arrow)

        for part in _pieces(batches):
            words, ending, _ = words_and_endings(as_bytes(part.column("text")))
            held.append(summed([(words, (ending % np.uint64(BUCKETS)).astype(np.int32), np.ones(len(words), np.int64))]))
            size, texts = size + len(held[-1][0]), texts + part.num_rows
            if size > FLUSH:
                held = [summed(held)]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield out()
                    held, size, texts = [], 0, 0
        if texts:
            yield out()

    return docs.select("text").mapInArrow(freed(run), schema).groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


class Head:
    """The most frequent words: hashes in order, symbols, counts."""

    def __init__(self, words: np.ndarray, ending: np.ndarray, counts: np.ndarray):
        """In order of falling counts; words after the first ``OWN`` have their end's symbol."""
        rank = np.cumsum(words != END)
        symbol = np.where(words == END, 0, np.where(rank <= OWN, rank, 1 + OWN + ending))
        order = np.argsort(words)
        self.words, self.counts, self.symbol = words[order], counts[order], symbol[order].astype(np.int64)
        self.logs = np.log10(self.counts + 1.0)

    def places(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the table, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def symbols(self, place: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Symbols of words: their own, or that of their end."""
        bucket = 1 + OWN + (ending % np.uint64(BUCKETS)).astype(np.int64)
        return np.where(place >= 0, self.symbol[place], bucket) if len(self.words) else bucket


TOKENS = "uid long, doc_id long, text_hash long, held boolean, n_tokens long, known long, base double, symbols binary, rest array<struct<word:bigint,n:int>>, shard int"


def to_symbols(docs: DataFrame, head: Head) -> DataFrame:
    """Each text's symbols, what its frequent words add to the base score, and its
    other words with their counts."""
    arrow = _arrow_schema(docs, TOKENS)
    shipped = docs.sparkSession.sparkContext.broadcast(head)  # HEAD words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shipped.value
        end = int(head.places(np.array([END]))[0])
        for part in _pieces(batches):
            words, ending, counts = words_and_endings(as_bytes(part.column("text")))
            n = part.num_rows
            doc = np.repeat(np.arange(n), counts)
            place = head.places(words)
            known = place >= 0
            base = np.bincount(doc[known], head.logs[place[known]], n) + (head.logs[end] if end >= 0 else 0.0)
            total = np.bincount(doc[known], minlength=n) + (end >= 0)
            # symbols of each text, and the end
            at = np.arange(len(words)) + doc
            symbols = np.zeros(len(words) + n, "<u2")
            symbols[at] = head.symbols(place, ending)
            edge = np.append(0, np.cumsum(counts + 1)).astype(np.int32) * 2
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edge), pa.py_buffer(symbols)])
            others = np.flatnonzero(~known)
            order = others[np.lexsort((words[others], doc[others]))]
            first = np.flatnonzero(np.append(True, (doc[order[1:]] != doc[order[:-1]]) | (words[order[1:]] != words[order[:-1]]))) if len(order) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(order))).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(words[order[first]].view(np.int64)), pa.array(times)], names=["word", "n"])
            offsets = np.append(0, np.cumsum(np.bincount(doc[order[first]], minlength=n))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), rest).cast(arrow.field("rest").type)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "doc_id", "text_hash", "held")), pa.array(counts + 1, pa.int64()), pa.array(total, pa.int64()), pa.array(base), binary, lists, part.column("shard")], schema=arrow)

    return docs.mapInArrow(freed(run), TOKENS)


def _histories(batches: Iterator[pa.RecordBatch], column: str = "symbols") -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Some rows at a time: the rows, their ranges, symbols, and within-text places."""
    for batch in batches:
        first, size = 0, 0
        raws = batch.column(column)
        lengths = [len(x.as_buffer()) // 2 for x in raws]
        for k in range(batch.num_rows + 1):
            if k == batch.num_rows or size >= CHUNK:
                if k > first:
                    part = batch.slice(first, k - first)
                    symbols = np.frombuffer(b"".join(x.as_py() for x in part.column(column)), "<u2").astype(np.int64)
                    n = np.array(lengths[first:k])
                    end = np.cumsum(n)
                    place = np.arange(len(symbols)) - np.repeat(end - n, n)
                    yield part, list(zip(end - n, end)), symbols, place
                first, size = k, 0
            if k < batch.num_rows:
                size += lengths[k]


def _summed(df: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' tables of one fixed shape, by blocks of rows.

    Tables are added in rounds, a few tasks' at a time, so that no task has those of all.
    """
    schema = "block int, part int, data binary"
    arrow = _arrow_schema(df, schema)
    step = -(-shape[0] // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(batches)
        if total is not None:
            task = TaskContext.get().partitionId()
            yield _emit([(b, task, total[b * step : (b + 1) * step].astype("<f4").tobytes()) for b in range(BLOCKS)], arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(data, "<f4").astype(np.float64)
                sums[b, part] = sums[b, part] + x if (b, part) in sums else x
        if sums:
            yield _emit([(b, part, x.astype("<f4").tobytes()) for (b, part), x in sums.items()], arrow)

    rows, tasks = df.mapInArrow(freed(run), schema), df.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.withColumn("part", F.col("part") % tasks).repartition(BLOCKS * tasks, "block", "part").mapInArrow(freed(add), schema)
    rows = rows.withColumn("part", F.lit(0)).repartition(BLOCKS, "block").mapInArrow(freed(add), schema)
    out = np.zeros(shape)
    for b, _, data in rows.collect():  # BLOCKS rows for a table of one shape
        x = np.frombuffer(data, "<f4").reshape(-1, shape[1])
        out[b * step : b * step + len(x)] += x
    return out


def neighbour_counts(tokens: DataFrame) -> np.ndarray:
    """How often each symbol stands after and before each of the first ones."""
    near = NEIGHBOURS

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((SYMBOLS, 2 * near))
        for _, _, s, place in _histories(batches):
            a, b = s[:-1], s[1:]
            inside = place[1:] > 0
            for own, other, shift in ((b, a, 0), (a, b, near)):
                use = inside & (other < near)
                total += np.bincount(own[use] * 2 * near + other[use] + shift, minlength=total.size).reshape(total.shape)
        return total

    return _summed(tokens.select("symbols"), make, (SYMBOLS, 2 * near))


def classes_of(counts: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A class for each symbol, by the likeness of neighbours; the end has the last."""
    x = np.sqrt(counts)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weight = np.sqrt(counts.sum(axis=1))
    # centres: each the symbol least like those before it, among frequent ones
    order = np.argsort(-weight, kind="stable")[:512]
    picked = [int(order[0])]
    near = x[order] @ x[picked[0]]
    while len(picked) < CLASSES:
        picked.append(int(order[int(np.argmin(near))]))
        near = np.maximum(near, x[order] @ x[picked[-1]])
    centres = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x * weight[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
    own = np.argmax(x @ centres.T, axis=1)
    own[0] = CLASSES
    return own


def features(symbols: np.ndarray, place: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The rows of weights of each token's history: the word before, the one before
    that (skip), both, and the classes of three."""
    none = SYMBOLS
    past = []
    for back in (1, 2, 3):
        p = np.full(len(symbols), none, np.int64)
        p[back:] = np.where(place[back:] >= back, symbols[:-back], none) if back < len(symbols) else p[back:]
        past.append(p)
    k = np.append(own, CLASSES + 1)
    c = [k[p] for p in past]
    mixed = [past[0] * 3 + 1, past[1] * 3 + 2, (past[0] * 8191 + past[1]) * 3 + 7, ((c[0] * 64 + c[1]) * 64 + c[2]) * 3 + 5]
    seeds = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    return np.stack([((m.astype(np.uint64) + s) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(40)).astype(np.int64) & (ROWS - 1) for m, s in zip(mixed, seeds)])


def class_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax over the classes of each token, in blocks that stay in the cache.

    Weights are kept within ``LARGEST``, so no exponent overflows.
    """
    out = np.empty((rows.shape[1], len(bias)), np.float32)
    for k in range(0, len(out), BATCH):
        part = out[k : k + BATCH]
        first, *others = rows[:, k : k + BATCH]
        np.take(weights, first, axis=0, out=part)
        for r in others:
            part += weights[r]
        part += bias
        np.exp(part, out=part)
        part /= part.sum(axis=1, keepdims=True)
    return out


def gradient(tokens: DataFrame, weights: np.ndarray, bias: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Summed over all tokens: for each row of weights what was seen less what was
    expected of each class, and how often the row was used."""
    n = CLASSES + 1
    shipped = tokens.sparkSession.sparkContext.broadcast((weights, bias, own))

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weights, bias, own = shipped.value
        total = np.zeros((ROWS, n + 1))
        for _, _, s, place in _histories(batches):
            rows = features(s, place, own)
            p = class_probabilities(weights, bias, rows)
            p *= -1
            p[np.arange(len(s)), own[s]] += 1
            for r in rows.astype(np.uint16):  # as many bits as a radix sort takes
                order = np.argsort(r, kind="stable")
                at = r[order]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                total[at[first], :n] += np.add.reduceat(p[order], first, axis=0)
                total[at[first], n] += np.diff(np.append(first, len(at)))
        return total

    return _summed(tokens.select("symbols"), make, (ROWS, n + 1))


def train(tokens: DataFrame, own: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from all training texts; ``seen``: tokens of each class."""
    share = (seen + 1) / (seen.sum() + len(seen))
    bias = np.log(share).astype(np.float32)
    weights = np.zeros((ROWS, CLASSES + 1), np.float32)
    for epoch in range(EPOCHS):
        for shard in range(SHARDS):
            g = gradient(tokens.where(F.col("shard") == shard), weights, bias, own)
            used = g[:, -1:]
            # the curvature at the class shares; few uses count less
            curve = used * np.maximum(share * (1 - share), 0.01)[None] + 3.0
            step = RATE / (1 + 0.5 * epoch) / FEATURES * 2
            weights = np.clip(weights + np.clip(step * g[:, :-1] / curve, -2.5, 2.5), -LARGEST, LARGEST).astype(np.float32)
    return weights, bias


_REQUEST = "bucket int, phase int, chunk long, pairs binary, words binary, counts binary, texts binary"
_ANSWER = "chunk long, ids binary, gains binary"


def packed(x: np.ndarray) -> bytes:
    """Counts, as bytes where all fit."""
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else "<u4").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else "<u4")


def _trigrams(src: DataFrame, head: Head, own: np.ndarray, buckets: int) -> DataFrame:
    """Each chunk's trigrams by bucket of their first two words: in phase 0 the different
    ones, with their counts in training texts, in phase 1 in which texts each is.

    A last word is named by its place in ``head``, others by their class.
    """
    arrow = _arrow_schema(src, _REQUEST)
    shipped = src.sparkSession.sparkContext.broadcast((head, own, HEAD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, frequent = shipped.value
        task, number = TaskContext.get().partitionId(), 0
        for part in _pieces(batches):
            held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
            words, ending, counts = words_and_endings(as_bytes(part.column("text")))
            doc = np.repeat(np.arange(part.num_rows), counts)
            place = head.places(words)
            name = np.where(place >= 0, place, frequent + own[head.symbols(place, ending)])
            back = [np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)]
            for k in (1, 2):
                inside = doc[k:] == doc[:-k]
                back[k - 1][k:][inside] = words[:-k][inside]
            pair = mix(back[0] * np.uint64(3) + mix(back[1] + np.uint64(7)))
            order = np.lexsort((name.astype(np.uint16), pair))  # stable, and the texts are in order
            pair, name, doc = pair[order], name[order], doc[order]
            if not len(pair):
                continue
            chunk, number = task << 32 | number, number + 1
            first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (name[1:] != name[:-1])))
            times = np.diff(np.append(first, len(pair)))
            learned = np.add.reduceat((~held[doc]).astype(np.int64), first)
            bucket = ((pair[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            low, names = (pair[first] & np.uint64(0xFFFFFFFF)).astype("<u4"), name[first].astype("<u2")
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            at, texts_at = np.append(edge, len(low)).tolist(), np.append(first[edge], len(pair)).tolist()
            texts = doc.astype(np.uint8)
            ids = np.stack([part.column(c).to_numpy() for c in ("doc_id", "text_hash")]).astype("<i8").tobytes()
            rows = []
            for i, b in enumerate(bucket[edge].tolist()):
                k, t = slice(at[i], at[i + 1]), slice(texts_at[i], texts_at[i + 1])
                rows.append((b, 0, chunk, low[k].tobytes(), names[k].tobytes(), packed(learned[k]), b""))
                rows.append((b, 1, chunk, b"", ids if i == 0 else b"", packed(times[k]), texts[t].tobytes()))
            yield _batch(rows, arrow)

    return src.select("doc_id", "text_hash", "held", "text").mapInArrow(freed(run), _REQUEST)


def discounted(counts: np.ndarray, pair: np.ndarray, share: np.ndarray, of_class: np.ndarray, pairs: int) -> np.ndarray:
    """log10 of how much more likely trigrams are than their last words are in their classes.

    ``counts`` of different trigrams in training texts, ``pair`` and ``of_class`` number their
    first two words and the class of the last, ``share`` is the last word's share of its
    class, or 0 where it is no frequent word. Of each count the discount is left to the
    shares; a pair that no training text has before a frequent word of the class changes
    nothing. For a pair and a class, all words' probabilities add up to one.
    """
    frequent = (share > 0) & (counts > 0)
    context = pair * (CLASSES + 1) + of_class
    size = pairs * (CLASSES + 1)
    total = np.bincount(context[frequent], counts[frequent], size)
    kinds = np.bincount(context[frequent], minlength=size)
    once, twice = int((counts[frequent] == 1).sum()), int((counts[frequent] == 2).sum())
    discount = (once + 1) / (once + 2 * twice + 2)
    left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)[context]
    more = np.where(frequent, (counts - discount) / (np.maximum(total[context], 1) * np.maximum(share, 1e-300)), 0.0)
    return np.log10(np.maximum(left + more, 1e-30))


def trigram_gains(src: DataFrame, head: Head, own: np.ndarray, shares: tuple[np.ndarray, np.ndarray], tokens: int) -> DataFrame:
    """doc_id, text_hash, more: what the trigrams of each text add to its score.

    ``src``: doc_id, text_hash, held, text. ``shares``: of each word of ``head``, its class
    and its share. ``tokens``: about how many the texts have.
    """
    answer = _arrow_schema(src, _ANSWER)
    shipped = src.sparkSession.sparkContext.broadcast((*shares, HEAD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_class, word_share, frequent = shipped.value
        bucket, pieces, at, gains = None, [], {}, None

        def counted() -> np.ndarray:
            pair, name, count = (np.concatenate(x) for x in list(zip(*pieces))[1:])
            both, place = np.unique(pair.astype(np.uint64) << np.uint64(20) | name, return_inverse=True)
            counts = np.bincount(place, count, len(both))
            high = both >> np.uint64(20)  # in order
            of_pair = np.cumsum(np.append(False, high[1:] != high[:-1]))
            word = (both & np.uint64((1 << 20) - 1)).astype(np.int64)
            known = word < frequent
            at = np.where(known, word, 0)
            return discounted(counts, of_pair, np.where(known, word_share[at], 0.0), np.where(known, word_class[at], word - frequent), int(of_pair[-1]) + 1)[place]

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = []
                for b, phase, chunk, pairs, words, counts, texts in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)):
                    if b != bucket:
                        bucket, pieces, at, gains = b, [], {}, None
                    if phase == 0:
                        pair = np.frombuffer(pairs, "<u4")
                        pieces.append((chunk, pair, np.frombuffer(words, "<u2"), unpacked(counts, len(pair))))
                        continue
                    if gains is None:
                        gains, end = counted(), 0
                        for held, p, _, _ in pieces:
                            at[held] = (end, end + len(p))
                            end += len(p)
                    s, e = at[chunk]
                    each = np.repeat(gains[s:e], unpacked(counts, e - s))
                    rows.append((chunk, words, np.bincount(np.frombuffer(texts, np.uint8), each).astype("<f4").tobytes()))
                if rows:
                    yield _batch(rows, answer)

    def summed(table: pa.Table) -> pa.Table:
        ids, total = np.zeros((2, 0), "<i8"), np.zeros(0)
        for _, held, gains in zip(*(table.column(i).to_pylist() for i in range(3))):
            gains = np.frombuffer(gains, "<f4")
            total = np.pad(total, (0, max(0, len(gains) - len(total))))
            total[: len(gains)] += gains
            if held:
                ids = np.frombuffer(held, "<i8").reshape(2, -1)
        return pa.table([pa.array(x[: len(total)]) for x in ids] + [pa.array(total)], names=["doc_id", "text_hash", "more"])

    requests = _trigrams(src, head, own, max(1, -(-tokens // BUCKET)))
    answers = requests.repartition("bucket").sortWithinPartitions("bucket", "phase").mapInArrow(freed(run), _ANSWER)
    each = answers.groupBy("chunk").applyInArrow(summed, "doc_id long, text_hash long, more double")
    # equal rows have equal sums
    return each.groupBy("doc_id", "text_hash").agg(F.max("more").alias("more"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    src = texts_with_hash(docs).withColumn("held", held_out(F.col("doc_id")))
    counts = materialize(token_counts(src.where("not held")), "token-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"], total["v"]
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()
    head = Head(np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["ending"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64))

    of_id = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    shard = F.when(F.col("held"), SHARDS).otherwise(of_id % (FOLDS * SHARDS) / FOLDS).cast("int")
    rows = src.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text_hash", "held", shard.alias("shard"), "text")
    tokens = materialize(to_symbols(rows, head), "symbols", "shard", compression="zstd")
    training = tokens.where(F.col("shard") < SHARDS)

    own = classes_of(neighbour_counts(training))
    shipped = spark.sparkContext.broadcast(head)  # HEAD words at most

    def by_symbol(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        head = shipped.value
        out = np.zeros((SYMBOLS, 2))
        for batch in batches:
            word, ending, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            s = head.symbols(head.places(word.view(np.uint64)), ending.astype(np.uint64))
            out[:, 0] += np.bincount(s, c, SYMBOLS)
            out[:, 1] += np.bincount(s, minlength=SYMBOLS)
        return out

    per = _summed(counts.select("word", "ending", "c"), by_symbol, (SYMBOLS, 2))
    seen, kinds = (np.bincount(own, per[:, k], CLASSES + 1) for k in (0, 1))
    weights, bias = train(training, own, seen)
    # the base's denominator, taken apart by class
    ratio = np.log10(n_all + v_all + 1) - np.log10(seen + kinds + 1)

    schema = "uid long, doc_id long, text_hash long, held boolean, n_tokens long, known long, base double, gain double"
    arrow = _arrow_schema(docs, schema)
    kept = ["uid", "doc_id", "text_hash", "held", "n_tokens", "known", "base"]
    model = spark.sparkContext.broadcast((weights, bias, own, ratio))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, own, ratio = model.value
        for part, ranges, s, place in _histories(batches):
            p = class_probabilities(weights, bias, features(s, place, own))
            c = own[s]
            each = np.log10(np.maximum(p[np.arange(len(s)), c].astype(np.float64), 1e-30)) + ratio[c]
            gain = np.add.reduceat(each, [a for a, _ in ranges])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(gain)], schema=arrow)

    scored = tokens.select(*kept, "symbols").mapInArrow(freed(run), schema)
    rest = tokens.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.n").join(counts, "word", "left")
    rest = rest.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rest_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rest_known"))
    word_class = own[head.symbol] if len(head.words) else np.zeros(1, np.int64)
    word_share = (head.counts + 1) / (seen + kinds + 1)[word_class] if len(head.words) else np.zeros(1)
    more = trigram_gains(src, head, own, (word_class, word_share), n_all)
    base = F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))
    joined = scored.join(rest, "uid", "left").join(more, ["doc_id", "text_hash"], "left")
    score = base + F.col("gain") + F.coalesce("more", F.lit(0.0))
    return joined.select("doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
