"""Physical plans that must hold at scale."""

import io
from contextlib import redirect_stdout

from loam.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_no_cross_joins_and_pruned_scans(spark):
    for name in ("retrieval_topk", "hash_dedup", "conflict_jobs", "users_by_group", "knn_label_vote", "upsert_antijoin"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    text = plan(registry.QUERIES["feedback_page"](spark, SF))
    assert "PushedFilters: [IsNotNull(user_id)" in text
    text = plan(registry.QUERIES["session_upsert"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_equal_texts_are_met_once_by_phrases(spark):
    """Rows of joins grow with copies, not with their square."""
    from loam.operators import evaluation

    def joined(copies):
        texts = spark.createDataFrame([("one two three four five six",)] * copies + [("other words",)], "text string")
        phrases = spark.createDataFrame([(1, "two three four five six"), (2, "no such phrase in here at all")], "query_id int, phrase string")
        assert {r.query_id: r.phrase_hit for r in evaluation.phrases_in(phrases, texts).collect()} == {1: True, 2: False}
        t = texts.groupBy("text").count()
        return t.count()

    assert joined(50) == joined(200) == 2


def test_ascii_texts_do_not_cross_to_python(spark):
    from pyspark.sql import functions as F

    from loam.functions import text

    frame = spark.createDataFrame([(None,), ("plain",), ("e\u0301",)], "t string")
    assert [r.t for r in frame.select(text.nfc(F.col("t")).alias("t")).collect()] == [None, "plain", "\u00e9"]
    shown = plan(frame.select(text.nfc(F.col("t")).alias("t")))
    assert "ArrowEvalPython" in shown and "CASE WHEN RLIKE" in shown.split("ArrowEvalPython")[-1]


def test_expressions_stay_in_the_jvm(spark):
    for name in ("chunk_char", "chunk_tokens", "repeated_lines", "clean_lines", "feedback_derived", "retrieval_decision", "legacy_pack", "heading_path"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "PythonUDF" not in text and "Pandas" not in text and "ArrowEval" not in text, name


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
