import math
import re
import zlib
from collections import Counter

import numpy as np

from loam.llm import maxent

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]


def check(rows, given):
    train = [t for d, t in given if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(x for t in train for x in tokens(t))
    n, v = counts.total(), len(counts)
    assert len(rows) == len(given)
    want = Counter()
    for d, t in given:
        x = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)
        want[d, zlib.crc32(str(d).encode()) % 7 == 2, len(x), sum(counts[w] > 0 for w in x), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want


def test_beats_the_base_on_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = maxent.score_documents(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in rows if r.held_out and r.n_tokens > 5]
    per = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("gain per held-out token, log10:", per)
    assert per > 0.05
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def test_defined_results(spark):
    given = [(1, ""), (2, None), (3, "a b A"), (3, "a b A"), (9, "É é \n"), (12, "x " * 3000), (15, "zz unknown")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in given] + [(None, "n", "x", 1)], "doc_id long, text string, symbols string, uid int")
    rows = maxent.score_documents(docs).collect()
    check(rows, given)
    assert all(math.isfinite(r.score) for r in rows)
    assert maxent.score_documents(docs.limit(0)).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    s = rng.integers(0, maxent.SYMBOLS, 500)
    rows = maxent.features(s, np.arange(500), rng.integers(0, maxent.CLASSES, maxent.SYMBOLS))
    assert rows.min() >= 0 and rows.max() < maxent.ROWS
    p = maxent.class_probabilities(rng.normal(size=(maxent.ROWS, maxent.CLASSES + 1)).astype(np.float32), np.zeros(maxent.CLASSES + 1, np.float32), rows)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_trigram_probabilities_sum_to_one():
    """Over a class, after any two words: what trigrams take from the shares they give to words."""
    rng = np.random.default_rng(1)
    share = rng.random(6)
    share /= share.sum()
    for counts in ([3, 1, 0, 0, 0, 0], [1, 1, 1, 1, 1, 0], [0] * 6, [2, 0, 9, 0, 1, 0]):
        # words 0 to 4 are frequent; word 5 stands for all others of the class
        frequent = np.append(share[:5], 0)
        log = maxent.discounted(np.array(counts), np.zeros(6, np.int64), frequent, np.zeros(6, np.int64), 1)
        assert math.isclose((share * 10**log).sum(), 1, abs_tol=1e-9) and np.isfinite(log).all()


def hash_of(word):
    if word == "":
        return 0, 0
    h, ending, _ = maxent.words_and_endings([word.encode()])
    return int(h[0]), int(ending[0] % np.uint64(maxent.BUCKETS))


def dense(given, symbol, own, weights, bias, counts):
    """The score restated without Spark: a loop over tokens and whole softmax rows."""
    seen, kinds = np.zeros(maxent.CLASSES + 1), np.zeros(maxent.CLASSES + 1)
    for w in counts:
        seen[own[symbol[w]]] += counts[w]
        kinds[own[symbol[w]]] += 1
    contexts = {}
    for d, t in given:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            w = ["", "", *tokens(t)[:-1]]
            for a, b, x in zip(w, w[1:], w[2:]):
                contexts.setdefault((a, b, own[symbol[x]]), Counter())[x] += 1
    every = Counter(c for x in contexts.values() for c in x.values())
    discount = (every[1] + 1) / (every[1] + 2 * every[2] + 2)
    out = []
    for _, t in given:
        w = tokens(t)
        s = np.array([symbol[x] for x in w])
        rows = maxent.features(s, np.arange(len(s)), own)
        score = 0.0
        for k, x in enumerate(w):
            logits = weights[rows[:, k]].astype(float).sum(axis=0) + bias
            p = np.exp(logits) / np.exp(logits).sum()
            c = own[s[k]]
            share = (counts[x] + 1) / (seen[c] + kinds[c] + 1)
            known = contexts.get((*["", "", *w][k : k + 2], c)) if x else None
            if known:
                share = max(known[x] - discount, 0) / known.total() + discount * len(known) / known.total() * share
            score += math.log10(p[c] * share)
        out.append(score)
    return out


def test_score_agrees_with_a_dense_restatement(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "end."]
    given = [(d, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for d in range(1, 40)]
    given += [(50, given[3][1]), (51, given[3][1])]
    counts = Counter(x for d, t in given if zlib.crc32(str(d).encode()) % 7 != 2 for x in tokens(t))
    assert all(x in counts for _, t in given for x in tokens(t)) and sum(zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in given) > 1
    held = {}
    real = maxent.train
    monkeypatch.setattr(maxent, "train", lambda t, own, seen: held.setdefault("model", (*real(t, own, seen), own))[:2])
    rows = {r.doc_id: r for r in maxent.score_documents(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    named = {w: hash_of(w) for w in counts}
    order = sorted(counts, key=lambda w: (-counts[w], np.uint64(named[w][0]).view(np.int64)))
    head = maxent.Head(np.array([named[w][0] for w in order], np.uint64), np.array([named[w][1] for w in order]), np.array([counts[w] for w in order]))
    symbol = {w: int(head.symbol[np.flatnonzero(head.words == np.uint64(named[w][0]))[0]]) for w in counts}
    weights, bias, own = held["model"]
    want = dense(given, symbol, own, weights, bias, counts)
    assert np.allclose([rows[d].score for d, _ in given], want, rtol=1e-4)
