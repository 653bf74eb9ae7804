import pytest
from pyspark.sql import functions as F

from loam.functions import config
from loam.operators import analytics, dedup, display, jobs
from loam.plans import ingest, registry
from loam.sources import sinks


def test_display(spark):
    t = spark.createDataFrame([("", None, " x "), (None, "b", "c"), (None, " ", None)], "a string, b string, c string")
    got = [tuple(r.s) for r in t.select(display.selected_answer(*(F.col(c) for c in "abc")).alias("s")).collect()]
    assert got == [(" x ", "answer3"), ("b", "answer2"), (None, "none")]
    raw = spark.createDataFrame([('{"answer": "x", "mode": "rag"}',), ('{"response": {"answer": "y"}}',), ('{"response": "plain words"}',), ("just text",), ('{"mode": "m"}',)], "r string")
    assert [(r.c.answer, r.c.mode) for r in raw.select(display.coerced_response(F.col("r")).alias("c")).collect()] == [("x", "rag"), ("y", None), ("plain words", None), ("just text", None), ("", "m")]
    a = spark.createDataFrame([("t1 [FIGURE: f1 ]t2[FIGURE:f2]",), ("none",), (None,)], "a string")
    assert [[tuple(p) for p in r.p] for r in a.select(display.split_by_figures(F.col("a")).alias("p")).collect()] == [[("text", "t1 "), ("figure", "f1"), ("text", "t2"), ("figure", "f2")], [("text", "none")], []]
    code = spark.createDataFrame([("a```x\ny```b",)], "a string").select(display.split_fenced(F.col("a")).alias("p")).first().p
    assert [tuple(p) for p in code] == [("text", "a"), ("code", "```x\ny```"), ("text", "b")]
    label = spark.createDataFrame([("one\nFigure(s):\nf1\nf2\n\ntwo\nsee image: z",)], "a string").select(display.without_figure_labels(F.col("a")).alias("t")).first().t
    assert label == "one\ntwo"
    m = spark.createDataFrame([([("figure", "f1", "a.png"), ("figure", "f1", "b.png"), ("text", None, None), ("figure", "f2", "/abs.png"), ("Figure", "f3", " a.png ")],)], "m array<struct<chunk_type:string,figure_id:string,image_ref:string>>")
    r = m.select(display.image_refs(F.col("m")).alias("refs"), display.figure_map(F.col("m")).alias("map")).first()
    assert r.refs == ["a.png", "b.png"] and r.map == {"f1": "a.png", "f3": "a.png"}


def test_jobs(spark):
    assert jobs.next_state(None, "queued") == "queued" and jobs.next_state("running", "failed") == "failed"
    with pytest.raises(ValueError):
        jobs.next_state("succeeded", "running")
    assert jobs.resolve_profile(None, ["a"], ["b"]) == "a" and jobs.resolve_profile(None, [], ["b"], "b") == "b" and jobs.resolve_profile("b", ["a"], ["b"]) == "b"
    for wrong in (("x", ["a"], []), (None, [], [])):
        with pytest.raises(ValueError):
            jobs.resolve_profile(*wrong)
    j = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:00:08", 20), ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 20)], "started_at string, finished_at string, chunks_total long")
    assert [(r.duration_sec, r.throughput_chunks_per_s) for r in jobs.metrics(j).collect()] == [(8.0, 2.5), (0.0, 0.0)]


def test_feedback(spark):
    rows = [(1, 7, "abcdefghij", 1, " hi ", '{"question": " Q? ", "mode": "RAG", "client": "web", "ui_version": "2"}'), (2, None, None, 5, None, "{bad"), (3, 8, "", -1, "", None), (4, 9, "s", None, "x" * 100, '{"mode": " ", "ui_version": "3"}')]
    d = analytics.derive_feedback(spark.createDataFrame(rows, "id int, user_id int, session_id string, rating int, comment string, metadata_json string"))
    got = {r.id: r for r in d.collect()}
    assert (got[1].question, got[1].mode_normalized, got[1].client_tag, got[1].user_display, got[1].rating_label, got[1].comment) == ("Q?", "rag", "web@2", "7 | abcdefgh", "like", "hi")
    assert got[2].metadata_error and got[2].user_display == "anonymous" and got[2].rating_label == "dislike" and got[2].mode == "n/a"
    assert got[4].client_tag == "@3" and got[4].comment_truncated == "x" * 77 + "..." and not got[3].metadata_error
    k = analytics.feedback_kpis(d).first()
    assert (k.likes, k.dislikes, k.mode_rag, k.mode_none, k.like_pct) == (1, 3, 1, 3, 25.0)
    zero = analytics.feedback_kpis(d.limit(0)).first()
    assert (zero.likes, zero.like_pct) == (0, 0.0)
    assert [r.id for r in analytics.filter_derived(d, rating="like", mode="rag", user="ABCD".lower(), search="q?").collect()] == [1]
    signs = spark.createDataFrame([(x,) for x in ("like", "+1", "7", "dislike", "-3", "all", "", "0", "odd", None)], "r string")
    assert [r.s for r in signs.select(analytics.rating_sign(F.col("r")).alias("s")).collect()] == [1, 1, 1, -1, -1, None, None, None, None, None]
    with pytest.raises(ValueError):
        analytics.page(d, [F.col("id")], 0)
    assert analytics.page_info(30, 10, 20) == {"total": 30, "has_prev": True, "has_next": False}
    assert d.select(*sinks.EXPORT[:1]).count() == 4


def test_dedup(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "id int, h string")
    assert sorted(r.id for r in dedup.first_of_each(rows, "h", ["id"]).collect()) == [1, 2, 4, 5]
    target = spark.createDataFrame([("b",), (None,)], "h string")
    assert sorted(r.id for r in dedup.upsert(rows, target, "h", ["id"]).collect()) == [1, 2, 4]
    assert tuple(dedup.upsert_counts(rows, target, "h", ["id"]).first()) == (3, 2)
    assert tuple(dedup.upsert_counts(rows, target, "h", ["id"], dry_run=True).first()) == (0, 3)
    users = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, status string")
    merged = analytics.merge_users(users, spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string"))
    assert sorted(map(tuple, merged.collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", None)]
    ids = dedup.with_next_ids(spark.createDataFrame([("p",), ("q",)], "n string"), users, "n")
    assert sorted((r.n, r.id) for r in ids.collect()) == [("p", 3), ("q", 4)]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "k int, embedding array<double>")
    assert {r.k: r.embedding for r in dedup.mean_pool(v, ["k"]).collect()} == {1: [2.0, 3.0], 2: [5.0, 5.0]}


def test_means_that_round_to_zero_keep_their_sign(spark, tmp_path):
    import duckdb

    rows = [(1, [-0.000004, 0.000004, 0.0, 0.000005, -0.25] + [1.5] * 59, 7), (2, [-0.000002, 0.000002, 0.0, 0.000005, -0.75] + [2.5] * 59, 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["mean_pool"](spark, str(tmp_path)).first().embedding
    sql = registry.ORACLE_SQL["mean_pool"].replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = duckdb.connect().execute(sql).fetchone()[1]
    assert repr(got) == repr(want) and repr(got[:3]) == "[-0.0, 0.0, 0.0]"


def test_ingest(spark):
    items = spark.createDataFrame([("d1", 0, "Some text of enough letters. " * 200, "text/plain", "s"), ("d2", 0, "Some text of enough letters. " * 200, "text/plain", "s"), ("d3", 0, "x", "odd/kind", "s"), ("d4", 0, "A mail to a.b@ex.org goes here", "text/plain", "s")], "doc_id string, item_idx int, text string, content_type string, source string")
    chunks = ingest.chunk_items(items)
    rows = ingest.ingest(items)
    got = rows.collect()
    assert len({r.hash_norm for r in got}) == len(got) and {r.doc_id for r in got} == {"d1", "d4"}
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in got)
    assert any("[EMAIL]" in r.text for r in got)
    s = ingest.summary(items, chunks, rows).first()
    assert s.errors == 1 and s.docs == 4 and s.skipped == s.chunks - s.inserted > 0

    calls = []

    def failing(texts):
        calls.append(1)
        raise RuntimeError("down")

    assert ingest.embed(chunks, failing).where("embedding is not null").count() == 0


def test_config():
    assert config.resolve_env({"a": ["x${H}y", 3], "b": "${NONE}"}, {"H": "1"}) == {"a": ["x1y", 3], "b": ""}
    assert config.clamp_parameters({"temperature": 3, "top_k": -2, "max_tokens": 0}, {"LLM_TOP_P": "1.5"}) == {"temperature": 2.0, "top_k": 0, "max_tokens": 1, "top_p": 1.0}
