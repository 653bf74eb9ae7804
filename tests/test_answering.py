"""The answer job with models that answer by rule and count their calls."""

import os
import uuid

from loam.operators import vector_index
from loam.operators.retrieval import RetrievalConfig
from loam.plans.answering import Corpus, answer_questions

TOPICS = ["pump", "valve", "motor", "cable"]


def embedder(texts):
    out = []
    for t in texts:
        v = [float(t.lower().count(w)) for w in TOPICS]
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else None)
    return out


def counting(folder, answer):
    def model(prompts, folder=str(folder), answer=answer):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(p.replace("\n", " ") for p in prompts) + "\n" if prompts else "")
        return [answer(p) for p in prompts]

    return model


def calls(folder):
    return sorted(line for p in folder.iterdir() for line in p.read_text().splitlines())


def corpus(spark):
    rows = []
    for k in range(40):
        w = TOPICS[k % 4]
        text = f"About the {w}: part {k} of the {w} handbook tells how a {w} is kept in order, step by step, all year round."
        rows.append((k, f"doc{k % 8}", f"{w}.pdf", text, "figure" if k == 39 else "text", "paragraph", embedder([text])[0]))
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, source string, text string, chunk_type string, block_type string, embedding array<double>")


def test_each_model_is_asked_where_it_is_needed(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    asked = [(1, "how is the pump kept in order over the year"), (2, "what does the valve handbook say about order"), (3, "something else entirely"), (4, "which motor steps are there in the handbook"), (5, None)]
    questions = spark.createDataFrame(asked, "query_id long, question string")
    # the primary finds nothing for the valve, and says nothing of the motor
    primary = counting(first, lambda p: "NO_CONTEXT" if "valve handbook say" in p else " " if "motor steps" in p else f"From {p.count('About the pump')} parts.")
    fallback = counting(second, lambda p: f"Sorry: {p}")
    cfg = RetrievalConfig(gate_bytes=50)
    frame = corpus(spark)
    rows = {r.query_id: r for r in answer_questions(questions, Corpus(frame), embedder, primary, fallback, cfg).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert (rows[1].mode, rows[1].sources_used) == ("hybrid", "partial") and rows[1].answer.startswith("From ") and rows[1].answer != "From 0 parts."
    assert all("pump" in c.source for c in rows[1].used_chunks if c.score > 0.9)
    assert (rows[2].mode, rows[2].answer, rows[2].decision_explain.no_context_rule) == ("fallback", "Sorry: what does the valve handbook say about order", "exact_token")
    assert (rows[3].mode, rows[3].answer, rows[3].decision_explain) == ("fallback", "Sorry: something else entirely", None)
    assert rows[4].answer == "Sorry: which motor steps are there in the handbook"
    assert rows[5].mode == "fallback"
    assert len(calls(first)) == 3  # 1, 2 and 4, once each
    assert len(calls(second)) == 4 and not any("pump" in c for c in calls(second))


def test_with_an_index_and_without_questions(spark, tmp_path):
    frame = corpus(spark)
    index = vector_index.build(frame, 4, id_col="chunk_id")
    one = spark.createDataFrame([(1, "how is the pump kept in order over the year")], "query_id long, question string")
    say = lambda ps: ["yes" for _ in ps]
    row = answer_questions(one, Corpus(frame, index, 4), embedder, say, say, RetrievalConfig(gate_bytes=50)).first()
    plain = answer_questions(one, Corpus(frame), embedder, say, say, RetrievalConfig(gate_bytes=50)).first()
    assert row.answer == "yes" and [c.chunk_id for c in row.used_chunks] == [c.chunk_id for c in plain.used_chunks]
    assert answer_questions(one.limit(0), Corpus(frame), embedder, say, say).count() == 0
