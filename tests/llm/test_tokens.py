import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loam.llm import bpe, token_store

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids int, segment string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def rows():
    rng = random.Random(5)
    texts = ["", None, " \n\t ", "Hello  World's end", "a" * 5000, "thein" * 900 + "!?" * 700, "<|endoftext|> x<|startoftext|>", "café ÉÀ ﬁ é İ Σς 漢字", "b " * 2000, "\x1c\x85 x\xa0y"]
    texts += ["".join(rng.choice("abcdeé!'s 0\n") for _ in range(rng.choice([5, 50, 4000]))) for _ in range(30)]
    texts += [texts[3], texts[4]]
    out = [(3 * k - 7, t, 1, "x") for k, t in enumerate(texts)]
    return out + [(None, "no id", 1, "x")]


def test_tree_joins_agree_with_the_library(library):
    rng = random.Random(1)
    c = bpe.TreeCoder(PATH, leaf=20)
    for alphabet in ["abcdefghinotrs", "aaab", "thein", "!?'s", "éàñ", "0a!'", "漢字ｶ", "á²³½A,<|endoftext|>"]:
        for n in [0, 1, 19, 20, 21, 80, 700]:
            text = "".join(rng.choice(alphabet) for _ in range(n))
            want = library.encode(text, add_special_tokens=False).ids
            assert list(array("I", c.encode(text))) == want, text
            parts = []
            for k, (run, kind, t) in enumerate(bpe.parts_of(c, text, 33)):
                ids = c.encode(t) if kind == "text" else array("I", [int(t)]).tobytes() if kind == "id" else array("I", c.piece(t)).tobytes()
                parts.append((k, run, kind, t, ids))
            assert list(array("I", bpe.joined_parts(c, parts))) == want, text


def test_encode_and_decode_whole_tables(spark, library):
    given = [r for r in rows() if r[0] is not None]
    docs = spark.createDataFrame(rows(), DOCS)
    found = {r.doc_id: list(r.ids) for r in bpe.encode_documents(docs, PATH, spread=1000, leaf=100).collect()}
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t, *_ in given}
    assert found == want
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    assert back == {d: library.decode(i, skip_special_tokens=False) for d, i in want.items()}
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000, 65536])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32 if n == 1000 else 50000, n).astype("<u4")
    assert (token_store.from_planes(token_store.to_planes(ids, planes), n) == ids).all()


def test_crc_of_both():
    for a, b in [(b"", b"x"), (b"abc", b""), (b"abc" * 50, b"hello" * 99)]:
        assert token_store.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store_reads_back(spark, library, tmp_path, monkeypatch):
    given = sorted((r for r in rows() if r[0] is not None), key=lambda r: r[0])
    given.append((given[-1][0], given[-1][1], 1, "x"))  # a row that repeats
    docs = spark.createDataFrame(given + [(None, "no id", 1, "x")], DOCS)
    path = str(tmp_path / "store")
    token_store.write_token_store(docs, path, PATH, ranges=3)
    want, start = [], 0
    for d, t, *_ in given:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    found = sorted(tuple(r) for r in token_store.read_digests(spark, path).collect())
    assert found == sorted(want)
    empty = str(tmp_path / "empty")
    token_store.write_token_store(docs.limit(0), empty, PATH)
    assert token_store.read_digests(spark, empty).count() == 0


def test_documents_span_chunks(spark, library, tmp_path):
    long = "thing and other " * 60_000  # 180,000 ids: over three blocks
    docs = spark.createDataFrame([(1, "x"), (2, long), (3, "y")], "doc_id long, text string")
    path = str(tmp_path / "s")
    token_store.write_token_store(docs, path, PATH, ranges=1)
    assert token_store.read_chunks(spark, path).count() >= 3
    ids = library.encode(long, add_special_tokens=False).ids + [2]
    found = {r.doc_id: r for r in token_store.read_digests(spark, path).collect()}
    assert found[2].ids_crc32 == zlib.crc32(array("I", ids).tobytes()) and found[2].n_tokens == len(ids)
    assert found[3].start == found[2].start + len(ids)


def test_query_digests(library):
    from loam.llm import queries

    c = bpe.coder(PATH)
    ids = library.encode("Hello, it's me", add_special_tokens=False).ids
    n, a, b = queries._digests(c, array("I", ids).tobytes())
    assert n == len(ids)
    assert a == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert b == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
