import math
import re

import numpy as np
from pyspark.sql import functions as F

from loam.operators import evaluation, retrieval
from loam.operators.retrieval import RetrievalConfig


def vectors(spark, n=60, d=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[7] = x[3]  # a tie
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_top_k_agrees_with_numpy(spark, monkeypatch):
    x, corpus = vectors(spark)
    x32 = x.astype(np.float32).astype(float)
    queries = corpus.where("vec_id in (1, 3, 50)").select(F.col("vec_id").alias("query_id"), "embedding")
    for kind in ("dot_product", "cosine", "l2"):
        for block in (4096, 1):
            monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
            rows = retrieval.top_k(corpus.repartition(5), queries, 6, kind).collect()
            for q in (1, 3, 50):
                dot = x32 @ x32[q]
                norm = np.linalg.norm(x32, axis=1)
                d = -dot if kind == "dot_product" else 1 - dot / (norm * norm[q]) if kind == "cosine" else np.linalg.norm(x32 - x32[q], axis=1)
                want = sorted(range(60), key=lambda i: (round(d[i], 9), i))[:6]
                assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] == want, (kind, q)
    expression = corpus.where("vec_id = 5").crossJoin(queries.withColumnRenamed("embedding", "q"))
    for r in expression.select("query_id", retrieval.distance(F.col("embedding"), F.col("q")).alias("d")).collect():
        assert abs(r.d + x32[5] @ x32[r.query_id]) < 1e-9


def test_top_k_odd_rows(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in retrieval.top_k(corpus, q, 5).orderBy("rank").collect()] == [(9, 1), (9, 4)]
    assert retrieval.top_k(corpus, q.limit(0), 5).count() == 0


def greedy(rows, cfg):
    """The choice written out by hand for one query."""
    words = lambda t: {w for w in re.sub(r"[^\w\s]", " ", t.lower()).split() if w.isalpha()}
    over = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    pool, chosen = sorted(rows, key=lambda r: r[5]), []
    while pool and len(chosen) < cfg.max_keep:
        best, top = None, -math.inf
        for r in pool:
            if sum((c[2] or "") == (r[2] or "") for c in chosen) >= cfg.per_doc_cap:
                continue
            s = r[4] if not chosen else cfg.mmr_lambda * r[4] - (1 - cfg.mmr_lambda) * max(over(words(r[3]), words(c[3])) for c in chosen)
            if s > top:
                best, top = r, s
        if best is None:
            break
        chosen.append(best)
        pool.remove(best)
    context, total = [], 0
    for r in sorted(chosen, key=lambda r: -r[4]):
        size = len(r[3].strip().encode())
        extra = 2 if context else 0
        if not size or total + extra + size > cfg.max_bytes:
            continue
        context.append(r[1])
        total += size + extra
        if len(context) >= cfg.max_chunks:
            break
    return [c[1] for c in chosen], context, total


def test_selection_and_packing(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "aeiou"]
    rows = []
    for q in range(6):
        sims = sorted(np.round(rng.random(30), 2), reverse=True)
        for pos, s in enumerate(sims, 1):
            text = " ".join(rng.choice(vocabulary, rng.integers(0, 60)))
            rows.append((q, q * 100 + pos, str(rng.choice(["x", "y", ""])) or None, text, float(s), pos))
    cfg = RetrievalConfig(max_bytes=400, per_doc_cap=3)
    frame = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id string, text string, sim double, pos int")
    found = retrieval.select_and_pack(frame, cfg).collect()
    for q in range(6):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.mmr_rank)
        chosen, context, total = greedy([r for r in rows if r[0] == q], cfg)
        assert [r.chunk_id for r in mine] == chosen
        assert [r.chunk_id for r in sorted((r for r in mine if r.in_context), key=lambda r: r.context_rank)] == context
        assert sum(r.context_bytes for r in mine) == total


def test_decisions_and_gates(spark):
    rows = [(1, False, -0.9, 0.95), (1, False, -0.2, 0.6), (2, False, 0.0, 0.5), (3, True, 0.55, 0.225), (4, False, 0.9, 0.05)]
    d = retrieval.decide(spark.createDataFrame(rows, "query_id long, short boolean, raw_score double, sim double"))
    assert {r.query_id: r.decision_mode for r in d.collect()} == {1: "rag", 2: "hybrid", 3: "hybrid", 4: "fallback"}
    assert abs({r.query_id: r.p90 for r in d.collect()}[1] - (0.6 + 0.9 * 0.35)) < 1e-12
    raw = retrieval.decide(spark.createDataFrame(rows, "query_id long, short boolean, raw_score double, sim double"), RetrievalConfig(score_mode="raw"))
    assert {r.query_id: r.decision_mode for r in raw.collect()}[1] == "rag"
    chosen = spark.createDataFrame([(1, True, 500), (2, False, 0), (3, True, 20)], "query_id long, in_context boolean, context_bytes int")
    gates = {r.query_id: r.gate_failed for r in retrieval.gates(d, chosen).collect()}
    assert gates == {1: None, 2: "min_chunks_gate", 3: "min_similarity_gate", 4: "min_similarity_gate"}


def test_answers_and_evidence(spark):
    t = spark.createDataFrame([("NO_CONTEXT",), (" no_context ",), ("The text Does not mention it",), ("fine",)], "a string")
    assert [r.r for r in t.select(retrieval.no_context_rule(F.col("a")).alias("r")).collect()] == ["exact_token", "exact_token", "regex_phrases:3", None]
    c = spark.createDataFrame([(0.82, 0.25, 0.6, "hybrid"), (0.4, 0.25, 0.6, "hybrid"), (0.1, 0.25, 0.6, "hybrid"), (None, 0.25, 0.6, "hybrid"), (0.9, 0.2, 0.6, "fallback")], "s double, l double, h double, m string")
    got = [r.c for r in c.select(retrieval.confidence(*(F.col(x) for x in "slhm")).alias("c")).collect()]
    assert [g.label for g in got] == ["High", "Medium", "Low", "Unknown", "Low"] and got[0].ratio == 1.0 and got[4].ratio == 0.0
    used = spark.createDataFrame([(1, 0.9), (1, 0.1), (1, None), (2, 0.9)], "query_id int, score double")
    explain = spark.createDataFrame([(1, "hybrid", None, 0.9, 0.25), (2, "hybrid", "min_chunks_gate", 0.9, 0.25)], "query_id int, mode string, gate_failed string, sim_max double, threshold_low double")
    assert sorted((r.query_id, r.score or 0) for r in retrieval.evidence(used, explain).collect()) == [(1, 0), (1, 0.9)]


def test_evaluation(spark):
    golden = spark.createDataFrame([(1, ["a"], ["Some words"], None), (2, ["z"], [], 1), (3, [], None, None)], "query_id int, expect_doc_ids array<string>, expect_phrases array<string>, top_k int")
    results = spark.createDataFrame([(1, 1, "b", None, "x"), (1, 2, "a", None, "has some WORDS in"), (2, 1, "", "q", ""), (2, 2, "z", None, ""), (3, 1, "a", None, "")], "query_id int, rank int, doc_id string, chunk_id string, text string")
    r = evaluation.hit_rate_mrr(golden, results).first()
    assert (r.eligible, r.hits, r.hit_rate, r.mrr) == (2, 1, 0.5, 0.25)
    assert {x.query_id: x.phrase_hit for x in evaluation.phrase_hits(golden, results).collect()} == {1: True, 2: False, 3: False}
    none = evaluation.hit_rate_mrr(golden.limit(0), results).first()
    assert (none.eligible, none.hit_rate, none.mrr) == (0, 0.0, 0.0)
