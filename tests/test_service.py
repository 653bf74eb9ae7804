"""Operators of the service: models, metadata, writes, uploads, numbers of headings."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loam.functions import scalars, text
from loam.operators import analytics, dedup, retrieval
from loam.plans import models
from loam.sources import manifest, sinks


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, c {kind}")
    return [r.x for r in df.select("k", f(F.col("c")).alias("x")).orderBy("k").collect()]


def test_numbers_of_headings(spark):
    assert [tuple(x) if x else None for x in col(spark, ["SOP 12: Start up", " sop7", "Stop 1", None], text.sop_heading)] == [("12", "Start up"), ("7", None), None, None]
    assert col(spark, ["4. Scope", "4.1 Part", " 12) x", "a 1", "7"], text.integer_major) == ["4", "4", "12", None, "7"]
    assert col(spark, ["4. Scope", "4 - Scope", "5 Other", " 4) x"], lambda c: text.without_major(c, F.lit("4"))) == ["Scope", "Scope", "5 Other", "x"]
    assert col(spark, ["4.1.2. Part one", "4: Two", "Three", None], text.without_number) == ["Part one", "Two", "Three", ""]
    assert col(spark, ["4.1.2", "4", "4.1"], text.display_number) == ["4.1", "4", "4.1"]
    entries = col(spark, ["1 Intro ........ 3", "2.1\tThe  part – two\t14", "3. End", "no number 4", "5 7"], text.toc_entry)
    assert [tuple(e) if e else None for e in entries] == [("1", "Intro", 1), ("2.1", "The part - two", 2), ("3", "End", 1), None, ("5", "7", 1)]


def test_scalars(spark):
    row = spark.sql("select map('a','1','b','2') as low, map('b','3') as high, cast(null as map<string,string>) as none, '{\"x\": 1}' as j, map('e', 1) as n").select(
        scalars.overlaid(F.col("low"), F.col("high")).alias("both"), scalars.overlaid(F.col("none"), F.col("high")).alias("one"), scalars.json_map(F.col("j")).alias("json"),
        scalars.incremented(F.col("n"), F.lit("e")).alias("up"), scalars.incremented(F.col("n"), F.lit("f"), 2).alias("new"),
    ).first()
    assert (row.both, row.one, row.json, row.up, row.new) == ({"a": "1", "b": "3"}, {"b": "3"}, {"x": "1"}, {"e": 2}, {"e": 1, "f": 2})
    assert col(spark, ["word/../media/a%20b.png", "/x//./y+z", "../..", "100%"], scalars.normal_path) == ["media/a b.png", "x/y+z", "", "100%"]
    assert col(spark, ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05.9", "no"], lambda c: scalars.utc_seconds(scalars.parsed_utc(c))) == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z", None]
    ids = col(spark, ["2024-01-02", "2024-01-02"], lambda c: scalars.job_id(c.cast("date")))
    assert all(__import__("re").fullmatch(r"emb-20240102-[0-9a-f]{6}", i) for i in ids)
    df = spark.createDataFrame([("a", "2024"), ("b", None), ("c", "2025")], "k string, at string")
    assert [r.k for r in df.orderBy(scalars.newest_first(F.col("at"))).collect()] == ["c", "a", "b"]


def test_metadata_and_aliases(spark):
    df = spark.createDataFrame([("1", '{"chunk_id": "c9", "source": "s", "lang": "en"}', {"source": "doc.pdf"}), ("2", "broken", {"doc_id": "d7"}), ("3", '{"source": ""}', None)], "id string, meta string, doc map<string,string>")
    rows = df.select("id", retrieval.merged_metadata(scalars.json_map(F.col("meta")), F.col("doc"), F.col("id")).alias("m")).orderBy("id").collect()
    assert [r.m for r in rows] == [{"chunk_id": "c9", "source": "doc.pdf", "lang": "en"}, {"doc_id": "d7", "source": "d7", "chunk_id": "2"}, {"source": "", "chunk_id": "3"}]
    q = spark.createDataFrame([("hr",), ("it",)], "domain string")
    assert {r.alias for r in retrieval.with_alias(q, {"hr": "v_hr", "it": "v_it"}).collect()} == {"v_hr", "v_it"}
    with pytest.raises(Exception, match="unknown domain: it"):
        retrieval.with_alias(q, {"hr": "v_hr"}).collect()
    selected = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, mmr_rank int")
    figures = spark.createDataFrame([(1, "f1", 0.2, 9), (1, "f2", 0.8, 10), (2, "f3", 0.1, 1)], "query_id int, chunk_id string, sim double, pos int")
    placed = retrieval.with_excluded(selected, figures, retrieval.RetrievalConfig(max_keep=3)).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.chunk_id, r.figure) for r in placed] == [(1, "a", False), (1, "b", False), (1, "f2", True), (2, "f3", True)]


class Flaky:
    """Answers by a script of errors, then one-element vectors of the texts' lengths."""

    def __init__(self, *errors):
        self.errors, self.sizes = list(errors), []

    def __call__(self, texts):
        self.sizes.append(len(texts))
        if self.errors and (e := self.errors.pop(0)):
            raise e
        return [[float(len(t))] for t in texts]


def test_calls_and_waits():
    waits = []
    call = lambda f, n=4, batch=4: models.called(f, ["x" * k for k in range(1, n + 1)], batch, sleep=waits.append)
    assert call(Flaky()) == ([[1.0], [2.0], [3.0], [4.0]], 0) and waits == []
    asked = Flaky(models.RateLimited(3), models.RateLimited(1))
    assert call(asked) == ([[1.0], [2.0], [3.0], [4.0]], 0) and waits == [3] and asked.sizes == [4, 4, 2, 2]
    waits.clear()
    assert call(Flaky(models.Unavailable(), models.Unavailable()))[1] == 0 and 0.5 <= waits[0] <= 1 and 1 <= waits[1] <= 2
    assert call(Flaky(*[models.Unavailable()] * 3)) == ([None] * 4, 1)
    bad = Flaky(None, ValueError("400"))
    assert call(bad, batch=2) == ([[1.0], [2.0], None, None], 1) and bad.sizes == [2, 2]
    assert models.waiting(9, draw=lambda: 1) == 8 and models.waiting(9, draw=lambda: 0) == 4 and models.waiting(1, 0.5) == 0.5
    assert models.parts_within("aa bb cc", 1) == ["aa", "bb", "cc"] and models.parts_within("abcdefghij", 1) == ["abcd", "efgh", "ij"] and models.parts_within("", 1) == [""]
    assert models.pooled([[1.0, 3.0], None, [3.0, 5.0]]) == [2.0, 4.0] and models.pooled([None]) is None


def test_models(spark):
    rows = spark.createDataFrame([(1, "abcd efgh"), (2, ""), (3, None), (4, "ab")], "id int, text string")
    out = models.embed_texts(rows.coalesce(1), Flaky(), max_tokens=1).orderBy("id").collect()
    assert [(r.embedding, r.n_parts) for r in out] == [([4.0], 2), (None, 0), (None, 0), ([2.0], 1)]
    assert tuple(models.embed_counters(models.embed_texts(rows, Flaky())).first()) == (4, 2, 2, 0)
    said = models.generated(spark.createDataFrame([(1, "hi"), (2, "none"), (3, "")], "id int, prompt string"), lambda p: [" yes " if x == "hi" else "" for x in p], lambda p: ["other" if x else None for x in p]).orderBy("id").collect()
    assert [(r.answer, r.answered_by) for r in said] == [("yes", "primary"), ("other", "fallback"), ("", None)]
    store = models.VectorStore(spark.createDataFrame([(1, [1.0]), (2, [3.0])], "vec_id int, embedding array<double>"), Flaky(), view="v")
    found = store.similarity_search_with_score(spark.createDataFrame([(7, "q"), (8, "")], "query_id int, question string"), 1).collect()
    assert [(r.query_id, r.vec_id, r.target_view) for r in found] == [(7, 2, "v")]
    items = spark.createDataFrame([("application/pdf",), ("text/plain",), (None,)], "content_type string")
    assert [r.route for r in models.routed(items, "structured_pdf").collect()] == ["structured_pdf", "char", "char"]
    assert {r.route for r in models.routed(items, "tokens").collect()} == {"tokens"}
    with pytest.raises(ValueError, match="unknown chunker"):
        models.routed(items, "other")
    assert col(spark, ["a b c"], models.chunker_of("tokens", max_tokens=2)) == [["a b", "c"]]


def test_ties_of_vectors(spark):
    corpus = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(500)], "vec_id int, embedding array<double>").repartition(3)
    found = retrieval.top_k(corpus, spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>"), 5).collect()
    assert sorted(r.vec_id for r in found) == [0, 1, 2, 3, 4]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "users")
    assert sinks.read_snapshot(spark, path, "id int").count() == 0
    for n in (1, 2, 3):
        sinks.replace_snapshot(spark.range(n).select(F.col("id").cast("int")), path)
        assert sinks.read_snapshot(spark, path, "id int").count() == n
    # a snapshot made from the one before it
    sinks.replace_snapshot(sinks.read_snapshot(spark, path, "id int").where("id > 0"), path)
    assert {r.id for r in sinks.read_snapshot(spark, path, "id int").collect()} == {1, 2}
    assert sum(p.name.startswith("v-") for p in (tmp_path / "users").iterdir()) == 2


def test_writes(spark, tmp_path):
    spark.sql("CREATE TABLE feedback_rows (id INT, user_id INT, comment STRING, metadata_json STRING, created_at TIMESTAMP) USING parquet")
    spark.sql("CREATE TABLE usage_rows (session_id STRING, latency_ms INT, cost DOUBLE) USING parquet")
    try:
        rows = spark.createDataFrame([(1, 5, "mail a@b.co", {"mode": "rag"}, None)], "id int, user_id int, comment string, metadata map<string,string>, created_at timestamp")
        sinks.append_feedback(rows, "feedback_rows")
        r = spark.table("feedback_rows").first()
        assert (r.comment, r.metadata_json, r.created_at is not None) == ("mail [EMAIL]", '{"mode":"rag"}', True)
        sinks.append_usage(spark.createDataFrame([("s", 12)], "session_id string, latency_ms int"), "usage_rows")
        assert tuple(spark.table("usage_rows").first()) == ("s", 12, None)
    finally:
        spark.sql("DROP TABLE feedback_rows")
        spark.sql("DROP TABLE usage_rows")
    out = spark.createDataFrame([tuple("x" for _ in sinks.EXPORT)], ", ".join(f"{c} string" for c in sinks.EXPORT))
    sinks.export_csv(out, str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,")


def test_alias_moves_last(spark):
    seen = []
    assert not sinks.swap_alias_after(spark, "a", "t", ensured=0, evaluate=lambda: seen.append(1))
    assert not sinks.swap_alias_after(spark, "a", "t", ensured=1, dry_run=True) and not sinks.swap_alias_after(spark, "a", "t", ensured=1, wanted=False)
    assert seen == [1]


def zipped(name, body="x"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.xml", "see word/ and xl/ here")
        z.writestr(name, body)
    return out.getvalue()


def test_uploads(spark):
    files = [("../My file?.docx", zipped("word/document.xml")), ("a.zip", zipped("notes.txt")), ("b\\c.txt", b"plain words"), ("empty.txt", b""), ("big.txt", b"x" * 600), ("??", b"plain")]
    df = spark.createDataFrame([(n, bytearray(b), None, "a, b", "EN", "2024-05-06 01:02:03") for n, b in files], "name string, content binary, source string, tags string, lang string, at string").withColumn("at", F.col("at").cast("timestamp"))
    good, bad = sinks.staged_uploads(df, [dedup.MEDIA_TYPES["docx"], dedup.MEDIA_TYPES["txt"]], 500)
    rows = {r.filename: r for r in good.collect()}
    assert set(rows) == {"My_file_.docx", "c.txt", "upload"} and rows["c.txt"].tags == ["a", "b"] and rows["c.txt"].lang_hint == "en" and rows["c.txt"].source == "manual-upload"
    assert rows["c.txt"].checksum_sha256 == __import__("hashlib").sha256(b"plain words").hexdigest()
    assert __import__("re").fullmatch(r"staging/2024/05/06/[0-9a-f-]{36}/c\.txt", rows["c.txt"].storage_path)
    assert sorted((r.name, r.reason) for r in bad.collect()) == [("a.zip", "type not allowed"), ("big.txt", "too large"), ("empty.txt", "empty")]
    kinds = spark.createDataFrame([(bytearray(zipped(n)),) for n in ("xl/workbook.xml", "ppt/x.xml", "text.xml")], "c binary").select(manifest.sniffed_type(F.col("c"), F.lit("f")).alias("t"))
    assert [r.t for r in kinds.collect()] == [dedup.MEDIA_TYPES["xlsx"], dedup.MEDIA_TYPES["pptx"], "application/zip"]


def test_users_and_runs(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "B@x")], "id int, email string")
    assert [r.id for r in analytics.hard_delete(users, spark.createDataFrame([(1,), (1,)], "id int")).collect()] == [2]
    assert analytics.checked_users(users).count() == 2
    with pytest.raises(ValueError, match="b@x is taken"):
        analytics.checked_users(users.union(spark.createDataFrame([(3, "b@X")], "id int, email string")))
    at = lambda s: F.lit(s).cast("timestamp")
    started = analytics.sync_started(spark.createDataFrame([("s1",), ("s2",)], "sync_id string"), at("2024-01-01 00:00:00"))
    later = analytics.sync_started(spark.createDataFrame([("s3",)], "sync_id string"), at("2024-01-03 00:00:00"))
    done = analytics.sync_finished(started, spark.createDataFrame([("s1", None), ("s2", "lost")], "sync_id string, error string"), at("2024-01-02 00:00:00"))
    states = dedup.latest_state(started.union(later).union(done), "sync_id", "changed_at")
    assert {r.sync_id: r.status for r in states.collect()} == {"s1": "succeeded", "s2": "failed", "s3": "running"}
    assert [r.sync_id for r in analytics.latest_runs(states, 1).collect()] == ["s3"]
