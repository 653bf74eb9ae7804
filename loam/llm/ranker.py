"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its text. Each pair of a
preferred (label 1) and another (label 0) training document gives the logistic
loss of the difference of their strengths; the weights minimise the mean over all
pairs. The threshold is the quantile of the training strengths at the share of
label 0, and scores are a logistic function that has its cut value there.

Training takes every labelled document of the training rows, and every pair of them. The
features are written once, in blocks by a hash of doc_id; a step adds up what the blocks give.
What a document's pairs add depends on its strength and on how the other label's strengths lie,
so a pass counts those in ``BINS`` bins of 1/32 (with their means), and a second one adds up each
document's share of the gradient and the curvature, by interpolation between the bins' borders.
The threshold is an order statistic of all strengths, found by counts in ever finer bins. Features: the shares of each
ASCII character and of the rest, and word, line and repetition statistics. Ids,
labels, languages and sources are no features.

A null or empty text has features of zeros, which count nothing; null doc_ids are left
out; labels that are null are left out and one id's differing labels count each;
without two kinds of labels every score is a half. Rows that repeat an id have
their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema
from loam.llm.common import BROADCAST_ROWS, freed, materialize, release

#: Documents of a block, steps at most, and bins of strengths, coarse ones for the curvature.
BLOCK, STEPS, BINS, COARSE = 4096, 25, 4096, 64
PENALTY = 1e-3
CUT = 0.3
#: Characters at which a text's features count half; the shares of a few words say little.
HALF = 60
N_FEATURES = 128 + 12


def features(text: str | None) -> np.ndarray:
    """Shares and statistics of one whole text, and last how much they count."""
    out = np.zeros(N_FEATURES + 1)
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts / len(raw)
    out[:128] = np.sqrt(shares[:128])
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out[-1] = len(raw) / (len(raw) + HALF)
    out[128:-1] = [
        np.sqrt(shares[128:].sum()),
        counts[65:91].sum() / max(1, letters),
        counts[48:58].sum() / len(raw),
        (len(raw) - letters - counts[48:58].sum() - counts[9:14].sum() - counts[32]) / len(raw),
        min(1.0, (len(raw) / n) / 20),
        len(set(words)) / n,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log1p(n) / 12),
        min(1.0, np.log1p(len(raw) / max(1, len(lines))) / 12),
        sum(1 for w in words if w[-1] in b"!|%$#&*@") / n,
        sum(1 for w in words if len(w) == 1) / n,
        min(1.0, n / 20),
    ]
    return out


def _scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (x[:, :-1] - centre) * scale * x[:, -1:]


class Model:
    """Weights on scaled features; ``score`` is ``CUT`` at the threshold."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, steepness: float):
        self.centre, self.scale, self.weights = centre, scale, weights
        self.threshold, self.steepness = threshold, steepness

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _scaled(x, self.centre, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.steepness * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: Adds up (or takes the least of) a function's arrays over all blocks of features and labels.
Combine = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], np.ufunc], np.ndarray]
_EDGES = np.linspace(-64, 64, BINS + 1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


def _spread(strength: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Counts of strengths by label and bin, and their sums."""
    at = label * BINS + np.clip(np.searchsorted(_EDGES, strength, "right") - 1, 0, BINS - 1)
    return np.stack([np.bincount(at, minlength=2 * BINS), np.bincount(at, strength, 2 * BINS)]).astype(float)


def _bins(spread: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each label the shares and the mean strengths of the bins that hold some."""
    counts, sums = (v.reshape(2, BINS) for v in spread.reshape(2, -1))
    return [(n[n > 0] / n.sum(), t[n > 0] / n[n > 0]) for n, t in zip(counts, sums)]


def _pulls(bins: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """At each border, for documents of label 0 and 1: the mean over the other label of the loss's
    slope, and of its curvature."""
    slope, bend = np.zeros((2, BINS + 1)), np.zeros((2, BINS + 1))
    for y in (0, 1):
        share, strength = bins[1 - y]
        for k in range(0, BINS + 1, 256):
            p = _sigmoid((1 - 2 * y) * (_EDGES[k : k + 256, None] - strength))
            slope[y, k : k + 256], bend[y, k : k + 256] = p @ share, (p * (1 - p)) @ share
    return slope, bend


def _loss(bins: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> float:
    (n0, s0), (n1, s1) = bins
    rows = (n1[k : k + 256] @ np.logaddexp(0, s0 - s1[k : k + 256, None]) @ n0 for k in range(0, len(n1), 256))
    return float(sum(rows) + PENALTY / 2 * weights @ weights)


def _weights(combine: Combine, scaled: Callable, n: np.ndarray, dims: int) -> np.ndarray:
    """Newton's steps on the mean loss of all pairs; a step that does not help is halved."""
    spread_of = lambda w: combine(lambda x, y: _spread(scaled(x) @ w, y), np.add)
    weights = np.zeros(dims)
    bins = _bins(spread_of(weights))
    loss = _loss(bins, weights)
    grid = np.linspace(-8, 8, COARSE)
    cross = _sigmoid(grid[:, None] - grid)
    cross = cross * (1 - cross)
    for _ in range(STEPS):
        slope, bend = _pulls(bins)

        def share(x: np.ndarray, y: np.ndarray, w=weights, slope=slope, bend=bend) -> np.ndarray:
            z = scaled(x)
            s = z @ w
            pull, curve = (np.where(y == 1, np.interp(s, _EDGES, t[1]), np.interp(s, _EDGES, t[0])) for t in (slope, bend))
            g = ((np.where(y == 1, -pull / n[1], pull / n[0])) @ z)
            h = (z * (curve / np.where(y == 1, n[1], n[0]))[:, None]).T @ z
            sums = np.zeros((2 * COARSE, dims))
            np.add.at(sums, y * COARSE + np.clip(np.rint((s + 8) * (COARSE - 1) / 16), 0, COARSE - 1).astype(int), z)
            return np.concatenate([g, h.ravel(), sums.ravel()])

        got = combine(share, np.add)
        gradient = got[:dims] + PENALTY * weights
        of0, of1 = got[dims * (dims + 1) :].reshape(2, COARSE, dims)
        both = (of1 / n[1]).T @ cross @ (of0 / n[0])
        values, axes = np.linalg.eigh(got[dims : dims * (dims + 1)].reshape(dims, dims) - both - both.T)
        step = axes @ ((axes.T @ gradient) / (np.maximum(values, 0) + PENALTY))
        for _ in range(8):
            bins = _bins(spread_of(weights - step))
            lower = _loss(bins, weights - step)
            if lower <= loss:
                break
            step = step / 2
        else:
            return weights
        weights, before, loss = weights - step, loss, lower
        if before - loss < 1e-6:
            return weights
    return weights


def _threshold(combine: Combine, strength: Callable, n: np.ndarray, share0: float) -> float:
    """The mean of the strength at which the mass reaches ``share0``, each label weighted as it is
    among all labels, and of the next one. Equals: label 0 first."""
    mass, goal = np.array([share0 / n[0], (1 - share0) / n[1]]), share0 - 1e-12
    least = lambda keep: float(combine(lambda x, y: np.array([np.min(v[keep(v)], initial=np.inf) for v in [strength(x)]]), np.minimum)[0])
    greatest = lambda keep: -float(combine(lambda x, y: np.array([np.min(-v[keep(v)], initial=np.inf) for v in [strength(x)]]), np.minimum)[0])
    low, high, below = least(lambda v: v == v), greatest(lambda v: v == v), np.zeros(2)
    while low < high:  # counts of what lies from low to high
        edges = np.unique(np.linspace(low, high, 257))

        def counts(x: np.ndarray, y: np.ndarray, edges=edges) -> np.ndarray:
            s = strength(x)
            inside = (s >= edges[0]) & (s <= edges[-1])
            at = np.minimum(np.searchsorted(edges, s[inside], "right") - 1, len(edges) - 2)
            return np.bincount(y[inside] * (len(edges) - 1) + at, minlength=2 * (len(edges) - 1)).astype(float)

        held = combine(counts, np.add).reshape(2, -1)
        k = min(int(np.searchsorted(mass @ (below[:, None] + np.cumsum(held, axis=1)), goal)), held.shape[1] - 1)
        below = below + held[:, :k].sum(axis=1)
        inside = lambda v, a=edges[k], b=edges[k + 1], last=k == held.shape[1] - 1: (v >= a) & ((v < b) | (last & (v == b)))
        found = least(inside), greatest(inside)
        if found == (low, high) and len(edges) == 2:  # neighbouring numbers
            low_only = combine(lambda x, y, a=low: np.bincount(y[strength(x) == a], minlength=2).astype(float), np.add)
            if mass @ (below + low_only) >= goal:
                high = low
            else:
                below, low = below + low_only, high
        else:
            low, high = found
    ties = combine(lambda x, y, a=low: np.bincount(y[strength(x) == a], minlength=2).astype(float), np.add)
    last = mass @ (below + ties) - mass[1 if ties[1] else 0] < goal
    if not last:
        return low
    after = least(lambda v: v > low)
    if np.isinf(after):  # the greatest of all: with the one before it
        after = low if ties.sum() > 1 else greatest(lambda v: v < low)
    return (low + after) / 2 if np.isfinite(after) else low


def fitted(combine: Combine, share0: float, width: int) -> Model | None:
    """Bradley-Terry weights and threshold from all rows that ``combine`` goes over; None without
    both labels. ``width``: columns of their features."""
    got = combine(lambda x, y: np.concatenate([np.bincount(y, minlength=2), x[:, :-1].sum(axis=0), (x[:, :-1] ** 2).sum(axis=0)]), np.add)
    n, total, dims = got[:2], got[:2].sum(), width - 1
    if not n.all():
        return None
    centre = got[2 : 2 + dims] / total
    scale = 1 / np.maximum(np.sqrt(np.maximum(got[2 + dims :] / total - centre**2, 0)), 1e-3)
    weights = _weights(combine, lambda x: _scaled(x, centre, scale), n, dims)
    strength = lambda x: _scaled(x, centre, scale) @ weights
    first, second = combine(lambda x, y: np.array([strength(x).sum(), (strength(x) ** 2).sum()]), np.add) / total
    return Model(centre, scale, weights, _threshold(combine, strength, n, share0), 4 / max(1e-6, float(np.sqrt(max(0.0, second - first**2)))))


def fit(x: np.ndarray, label: np.ndarray, share0: float) -> Model | None:
    """As ``train``, of features and labels in hand."""
    return fitted(lambda f, _: f(x, label.astype(np.int64)), share0, x.shape[1])


def training_row(doc_id: Column, folds: int = 5) -> Column:
    """Whether labels of this row may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", x array<double>"
    arrow = _arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(x, type=pa.list_(pa.float64()))], schema=arrow)

    return docs.select(*keep, "text").mapInArrow(freed(run), schema)


def _packed(src: DataFrame, blocks: int) -> DataFrame:
    """block, x, y: features and labels of a block's documents, in order of their ids."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
        x = table.column("x").combine_chunks().flatten().to_numpy().astype(np.float64)
        y = table.column("quality").to_numpy().astype(np.int8)
        return pa.table({"block": table.column("block").slice(0, 1), "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})

    rows = _featured(src, ["doc_id", "quality"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    return rows.groupBy("block").applyInArrow(pack, "block long, x binary, y binary")


def _combine(packed: DataFrame, blocks: int) -> Combine:
    """Over the written blocks, always in the same order; of many blocks, groups are joined first,
    so that the driver gets as many arrays as the root of their number."""
    groups = max(32, int(np.ceil(np.sqrt(blocks))))

    def combine(f: Callable[[np.ndarray, np.ndarray], np.ndarray], join: np.ufunc) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, x, y in zip(batch.column("block").to_pylist(), batch.column("x"), batch.column("y")):
                    label = np.frombuffer(y.as_py(), np.int8).astype(np.int64)
                    v = np.asarray(f(np.frombuffer(x.as_py()).reshape(len(label), -1), label), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([v.tobytes()], pa.binary())], names=["block", "v"])

        def joined(parts: list[tuple[int, bytes]]) -> np.ndarray:
            total = None
            for _, v in sorted(parts):
                total = np.frombuffer(v) if total is None else join(total, np.frombuffer(v))
            return total

        def of_group(table: pa.Table) -> pa.Table:
            got = joined(list(zip(table.column("block").to_pylist(), table.column("v").to_pylist())))
            return pa.table({"block": pa.array([min(table.column("block").to_pylist())]), "v": pa.array([got.tobytes()], pa.binary())})

        parts = packed.mapInArrow(freed(run), "block long, v binary")
        if blocks > groups:
            parts = parts.groupBy(F.pmod("block", F.lit(groups))).applyInArrow(of_group, "block long, v binary")
        return joined([(r["block"], bytes(r["v"])) for r in parts.collect()])

    return combine


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all the training rows' labels."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(training_row(F.col("doc_id"))).distinct()
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    known = F.broadcast(known) if sum(counts.values()) <= BROADCAST_ROWS else known
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(training_row(F.col("doc_id"))).join(known, "doc_id")
    # one text of each id, whatever its repeats: that of the least hash, or none
    src = src.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    blocks = -(-sum(counts.values()) // BLOCK)
    packed = materialize(_packed(src, blocks), "ranker-features")
    try:
        if packed.isEmpty():
            return None
        return fitted(_combine(packed, blocks), counts[0] / sum(counts.values()), N_FEATURES + 1)
    finally:
        release(packed)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_hash, score of every document."""
    text = F.col("text").cast("string")
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    if model is None:
        return src.select("doc_id", "text_hash", F.lit(0.5).alias("score"))
    schema = "doc_id long, text_hash long, score double"
    arrow = _arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = np.stack([features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(model.score(x))], schema=arrow)

    return src.mapInArrow(freed(run), schema)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``CUT`` or more."""
    if model is None:
        return docs
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = np.stack([features(t) for t in part.column(text).to_pylist()])
                yield part.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(freed(run), docs.schema)
