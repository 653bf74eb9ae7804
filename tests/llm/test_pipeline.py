import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loam.llm import queries, ranker
from loam.llm.common import materialize
from tests.llm.test_native import brute_contamination
from tests.llm.test_simhash import grouped, shingles
from tests.llm.test_substring import brute

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        kept.append(docs.collect())
        if name != "bpe":
            assert docs.columns == columns
    good, one, cut, clean, ids = kept
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scored = {r.doc_id: r.predicted for r in queries.op10_pairwise_quality(spark, SF).collect()}
    assert {r.doc_id for r in good} == {d for d, p in scored.items() if p}
    assert all(r == source[r.doc_id] for r in good + one)

    sets = {r.doc_id: set(shingles(r.text, 5)) for r in good}
    order = sorted(sets)
    alike = [(a, b) for i, a in enumerate(order) for b in order[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in one} == set(grouped(order, alike).values())

    want = {d: (n, gone, text) for d, n, gone, text in brute([(r.doc_id, r.text) for r in one], 50)}
    assert {r.doc_id: " ".join(WORD.findall(r.text)) for r in cut} == {d: x[2] for d, x in want.items()}
    assert all(r.n_chars == len(r.text) for r in cut)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute_contamination([(r.doc_id, r.text) for r in cut], bench) if x[-1]}
    assert {r.doc_id for r in clean} == {r.doc_id for r in cut} - bad

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    for r in ids:
        text = next(x.text for x in clean if x.doc_id == r.doc_id)
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(ids) == len(clean)


def test_stages_with_odd_rows(spark):
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (3, "a b c " * 60, "en", "s", 1), (3, "a b c " * 60, "en", "s", 1), (4, "x", "en", "s", 1), (None, "no id here", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = materialize(stage(spark, frame, SF), name)
            frame.count()
    assert ranker.keep_good(docs, None).count() == 6
