from pyspark.sql import functions as F

from loam.operators import evaluation
from loam.plans import registry

SF = "/root/testdata/sf0.001"


def test_hit_mrr_looks_up_found_rows_only(spark, monkeypatch):
    seen = []
    rate = evaluation.hit_rate_mrr
    monkeypatch.setattr(evaluation, "hit_rate_mrr", lambda golden, found: (seen.append(golden), rate(golden, found))[1])
    got = registry.eval_hit_mrr(spark, SF).first()
    vectors = {r.vec_id: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ranks = []
    for q in (r for r in vectors.values() if r.vec_id % 20 == 0):
        scored = sorted((-sum(x * y for x, y in zip(q.embedding, r.embedding)), r.vec_id) for r in vectors.values())[:10]
        ranks.append(next((k for k, (_, v) in enumerate(scored, 1) if v != q.vec_id and vectors[v].label == q.label), None))
    hit = [1 / k for k in ranks if k]
    assert (got.eligible, got.hits, got.mrr) == (len(ranks), len(hit), round(sum(hit) / len(ranks), 6))
    assert seen[0].agg(F.max(F.size("expect_doc_ids"))).first()[0] <= 10
