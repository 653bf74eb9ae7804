import hashlib
import random
import re

from pyspark.sql import functions as F

from loam.llm import common, decontaminate, merkle, queries

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def tokens(t):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contamination(docs, items):
    windows = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "É", "x1"] + [f"w{k}" for k in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [say(rng.choice([13, 14, 20, 40])) for _ in range(12)] + [say(n) for n in (1, 2, 5, 6, 6, 12)] + [["odd"] * 30]
    items = [(k, rng.choice([" ", ", "]).join(t).upper() if k % 3 else " ".join(t)) for k, t in enumerate(texts)]
    items += [(100, ""), (101, None), (102, items[0][1]), (103, " ".join(texts[1][3:]))]
    docs = [(1, ""), (2, None), (3, "...,"), (4, "odd " * 60), (5, "w1")]
    for d in range(10, 70):
        w = say(rng.randrange(120))
        for _ in range(rng.randrange(3)):
            t = rng.choice(texts)
            a, b = sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)))
            w += rng.choice([t, t, t[a:b], t[: len(t) // 2] + ["zz"] + t[len(t) // 2 :]]) + say(rng.randrange(20))
        docs.append((d, rng.choice([" ", "\n", "-"]).join(w)))
    docs.append(docs[20])
    docs.append((docs[20][0], docs[21][1]))
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs] + [(None, "w1", "x", 1)], "doc_id long, text string, hash string, length int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items] + [(None, "w1 w2", 1)], "item_id long, text string, doc_id int")
    want = brute_contamination(docs, items)
    assert sorted(map(tuple, queries.contamination_digests(frame, bench).collect())) == want
    long = [x for x in items if len(tokens(x[1])) >= 13]
    assert sorted(map(tuple, queries.contamination_digests(frame, bench.where("length(text) > 60")).collect())) != []
    only = spark.createDataFrame(long, "item_id long, text string")
    assert sorted(map(tuple, queries.contamination_digests(frame, only).collect())) == brute_contamination(docs, long)


def test_contamination_beyond_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "SHORT_LITERALS", 0)
    docs = [(1, "a b c d e f g h i j k l m n o"), (2, "q r s"), (3, "z")]
    items = [(1, "B C D E F G H I J K L M N"), (2, "r, s"), (3, "Q")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, queries.contamination_digests(*frames).collect())) == brute_contamination(docs, items)


def test_contamination_empty(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in queries.contamination_digests(docs, items).collect()] == [(1, 1, 0, 0)]
    assert queries.contamination_digests(docs.limit(0), items).count() == 0


def tree(t):
    return sha("".join(sha("".join(sha(p) for p in s.split("\n"))) for s in t.split("\n\n")))


def test_merkle(spark):
    texts = ["", None, "é" * 200, "a\nb\n\nc", "a\nb\n\nC", "\n\n\n", "one two three four. " * 40, "x"] + [f"line {k}\nof text {k % 3}\n" * (k % 7) for k in range(40)]
    given = [(2 * k, t) for k, t in enumerate(texts)] + [(4, "again")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in given] + [(None, "no", "x")], "doc_id long, text string, leaves string")
    order = sorted(((d, t or "") for d, t in given), reverse=True)
    want = []
    leaf = lambda t: {("l", x) for x in re.findall("[^\n]{0,46}?[esdnt] |[^\n]{1,48}", t)} | {("p", p) for p in t.split("\n")} | {("s", x) for x in t.split("\n\n")}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (d, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + other[:half]
        want.append((d, len(t), sha(e), tree(t), tree(e), round(like(leaf(t), leaf(e)), 9), round(like(leaf(t), leaf(other)), 9)))
    found = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in queries.merkle_digests(docs).collect()]
    assert sorted(found) == sorted(want)
    assert queries.merkle_digests(docs.limit(0)).count() == 0
    assert queries.merkle_digests(docs.where("doc_id = 6")).count() == 1


def test_branches_locate_edits(spark):
    a = spark.createDataFrame([(1, "a\nb\n\nc"), (2, "same"), (3, "x\ny\nx\nz"), (4, "p\nq")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a\nB\n\nc\n\nnew\nlast"), (2, "same"), (3, "new\nx\ny\nx\nz\nx"), (4, "q\np")], "doc_id long, text string")
    found = merkle.differing_branches(*(merkle.fingerprint_documents(x) for x in (a, b))).collect()
    # an inserted paragraph is the one difference, whatever it moves
    assert sorted((r.doc_id, r.side, r.section, r.paragraphs) for r in found) == [(1, "a", 0, [1]), (1, "b", 0, [1]), (1, "b", 2, [0, 1]), (3, "b", 0, [0, 5])]


def test_short_edits_keep_most_nodes(spark):
    """A character at the start of a one-line text, or a half that stays, leaves leaves alone."""
    line = "the words of one long paragraph stand side by side and none of them is strange " * 4
    line = " ".join(f"{w}{k}" if k % 3 else w for k, w in enumerate(line.split()))
    df = spark.createDataFrame([(line, "X" + line), ("short text of a few good words here", "short text of a few")], "a string, b string")
    likes = [r.x for r in df.select(merkle.likeness(merkle.nodes(F.col("a")), merkle.nodes(F.col("b"))).alias("x")).collect()]
    assert likes[0] > 0.6 and likes[1] >= 0.2


def test_a_passage_of_many_items(spark):
    """Equal passages of items meet documents as one class; every item is reported."""
    passage = " ".join(f"w{k}" for k in range(40))
    items = [(k, passage) for k in range(60)] + [(100 + k, f"own{k} " + passage) for k in range(5)]
    docs = [(k, f"x{k} {passage} y{k}") for k in range(40)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, queries.contamination_digests(*frames).collect())) == brute_contamination(docs, items)


def test_clean_rows_keep_their_columns(spark):
    rows = [(1, "a b c", "h", 3), (2, "q", "h", 3), (None, "a b c", "h", 3), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string, text_hash int")
    items = spark.createDataFrame([(1, "A b, C")], "item_id long, text string")
    out = decontaminate.keep_clean(docs, items)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == set(rows[1:])
    assert decontaminate.keep_clean(docs.limit(0), items).count() == 0
