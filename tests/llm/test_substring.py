import hashlib
import random
import re

from pyspark.sql import functions as F

from loam.llm import substring

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, window):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), " ".join(kept)))
    return sorted(out)


def corpus(seed, window):
    rng = random.Random(seed)
    vocabulary = ["été", "a", "b", "c,", "the", "of", "x"] + [f"w{k}" for k in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = [say(window + rng.randrange(3 * window)) for _ in range(4)]
    docs = [(1, ""), (2, None), (3, " \n "), (4, "w1 " * (5 * window)), (5, "w1 " * (3 * window)), (6, "a b " * 200)]
    for d in range(10, 60):
        w = say(rng.randrange(2 * window))
        for _ in range(rng.randrange(3)):
            c = rng.choice(common)
            a = rng.randrange(len(c))
            w += rng.choice([c, c[a:], c[:a], c[: len(c) // 2] + ["odd"] + c[len(c) // 2 :]]) + say(rng.randrange(window))
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(70, docs[20][1]), (71, docs[20][1]), (5, docs[4][1]), (12, "w9 " * window)]
    return docs


def test_agrees_with_brute_force(spark):
    for seed, window in [(1, 50), (2, 5), (3, 2), (4, 13)]:
        given = corpus(seed, window)
        docs = spark.createDataFrame([(d, t, "x", 1) for d, t in given] + [(None, "a b c", "x", 1)], "doc_id long, text string, start string, edges int")
        out = substring.remove_repeats(docs, window).collect()
        found = sorted((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in out)
        assert found == brute(given, window)
        assert all(r.text is None for r in out if r.doc_id == 2)


def test_empty_and_plain(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    assert [tuple(r)[2:] for r in substring.remove_repeats(docs).collect()] == [("one two", 2, 0)]


def test_long_texts_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 200)
    given = corpus(9, 10)
    docs = spark.createDataFrame(given, "doc_id long, text string")
    found = sorted((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in substring.remove_repeats(docs, 10).collect())
    assert found == brute(given, 10)


def test_query(spark):
    from loam.llm import queries

    docs = spark.createDataFrame([(1, " a  b\n"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in queries.substring_digests(docs).collect()}
    assert rows[1].kept_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert rows[2].kept_sha256 == rows[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_repeated_rows_count_once(spark):
    """Equal rows add no spans, however many there are."""
    half = " ".join(f"h{k}" for k in range(400))
    given = [(1, half + " own words of one")] + [(2, half + " b" * 30)] * 400 + [(3, "c " * 30 + half)] * 400
    docs = spark.createDataFrame(given, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in substring.repeated_spans(docs).collect()}
    assert set(spans) == {2, 3} and all(len(s) < 60 for s in spans.values())
    out = substring.remove_repeats(docs)
    assert out.count() == 801
    assert {(r.doc_id, r.n_removed) for r in out.select("doc_id", "n_removed").distinct().collect()} == {(1, 0), (2, 400), (3, 400)}


def test_nonbranching_paths_become_one_chain(spark):
    """Copies of a long text have one path in common, and one span that was verified."""
    words = " ".join(f"w{k}" for k in range(3000))
    docs = spark.createDataFrame([(1, words), (2, "x y z " + words), (3, words + " end")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in substring.repeated_spans(docs).collect()}
    inner = max(spans[3], key=lambda s: s["end"] - s["begin"])
    assert inner["checksum"] is not None and inner["end"] - inner["begin"] > 2800
    assert all(sum(s["checksum"] is not None for s in spans[d]) <= 3 for d in (2, 3))


def test_a_span_with_another_checksum_stays():
    text = " ".join(f"w{k}" for k in range(60))
    good = int(substring.checksums(text.encode().split(), substring.np.array([3]), substring.np.array([55]))[0])
    assert substring.cut(text, [{"begin": 3, "end": 55, "checksum": good}])[2] == 52
    assert substring.cut(text, [{"begin": 3, "end": 55, "checksum": good + 1}]) == (text, 60, 0)


def test_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b", {"k": 1}, 5), (None, "c", None, None), (1, "a b", {"k": 1}, 5)], "doc_id long, text string, text_hash map<string,int>, spans int")
    out = substring.remove_repeats(docs, 2, keep=("text_hash", "spans"))
    assert [(r.text, r.row.text_hash, r.row.spans) for r in out.collect()] == [("a b", {"k": 1}, 5)] * 2
