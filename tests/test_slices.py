"""What Python workers hold at once is bounded by a slice, not by a batch of the table."""

import pyarrow as pa
from pyspark.sql import functions as F

from loam.functions import sanitize, slices, text
from loam.operators import structured
from loam.plans import models


def test_a_function_gets_a_slice_of_a_batch(spark):
    many = slices.column_of(lambda values: [len(values)] * len(values), "int", pa.int32())
    rows = spark.range(0, 5000, 1, 1).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("café "), "id")).alias("t"))
    assert 1 < rows.select(F.max(many("t"))).first()[0] <= slices.SLICE
    long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 400_000).alias("t"))
    assert long.select(F.max(many("t"))).first()[0] <= 2


def test_cleaning_and_redaction_run_on_slices(spark):
    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("café of many letters, mail a"), "id", F.lit("@ex.org"))).alias("text"))
    done = sanitize.sanitize(text.nonempty(rows, text.cleaned(F.col("text"))))
    got = {r.id: r for r in done.collect()}
    assert len(got) == 857 and 7 not in got
    assert got[8].sanitized == "café of many letters, mail [EMAIL]" and got[8].redactions == {"email": 1}


def test_embedding_runs_on_slices(spark):
    def failing(texts):
        raise RuntimeError("down")

    rows = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("text "), "id").alias("text"))
    first = models.embed_texts(rows, failing, batch=1000).where("failed_batches > 0")
    assert first.count() == -(-1000 // slices.SLICE)
    ok = models.embed_texts(rows, lambda texts: [[float(len(t))] for t in texts]).collect()
    assert len(ok) == 1000 and all(r.embedding == [float(len(r.text))] and r.n_parts == 1 and r.failed_batches == 0 for r in ok)


def test_documents_are_filled_many_to_a_task(spark):
    rows = [(d, 0, f"Confident words of text {d}\nmore of them\n\n1.1 Part of {d}\nits words", 1) for d in range(600)]
    items = spark.createDataFrame([*rows, (None, 0, "1. Without an id\nwords", 1)], "doc_id long, item_idx int, text string, page int")
    for cut in (structured.chunk_docx(items, 64), structured.chunk_pdf(items, 64)):
        assert "FlatMapGroupsInPandas" not in cut._jdf.queryExecution().executedPlan().toString()
        got = cut.collect()
        by = {}
        for r in sorted(got, key=lambda r: r.chunk_seq):
            by.setdefault(r.doc_id, []).append(r)
        assert set(by) - {None} == set(range(600)) and all([r.chunk_seq for r in x] == list(range(1, len(x) + 1)) for x in by.values())
        assert all(f"of {d}" in " ".join(r.text for r in x) for d, x in by.items() if d is not None)
