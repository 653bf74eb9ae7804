"""Pieces, alignment and phrases against the libraries and plain restatements."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import alignment, phrases, pieces, queries

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a  b ", "\n\n", "a\x00b", "a▁b", "▁", "<s>", "<0x41>", "<|endoftext|> x", "Ünï 漢字 🙂 é́", "x\r\ny;\r", "ottotto otto", " " * 500, "ab" * 3000, "it's 1,234.5\t　e"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def random_texts(coder, n, seed):
    r = random.Random(seed)
    careful = [t for t in coder.texts if coder.careful[coder.ids[t]]]
    letters = "abcdefghinorst  \n<>0x41é漢🙂́\r\t\x00\x85\xa0otto'sll;"
    made = []
    for k in range(n):
        pool = [letters, coder.texts, careful][k % 3]
        made.append("".join(r.choice(pool).replace("▁", r.choice(["▁", " ", ""]) if k % 2 else " ") for _ in range(r.randint(0, 120))))
    return made


def test_encodes_and_decodes_as_the_library(library):
    coder = pieces.PieceCoder(PIECES)
    texts = ODD + random_texts(coder, 600, 1)
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode_many(texts)]
    assert got == [library.encode(t or "") for t in texts]
    assert [coder.decode(g) for g in got] == [library.decode(g) for g in got]


def test_decodes_any_ids_as_the_library(library):
    coder, r = pieces.PieceCoder(PIECES), random.Random(2)
    for _ in range(1500):
        ids = [r.choice([r.randrange(32000), r.randrange(262), 0, 1, 2, 259]) for _ in range(r.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_slices_small_tables_and_long_words(library, monkeypatch):
    coder = pieces.PieceCoder(PIECES, kept=50)
    monkeypatch.setattr(pieces, "SLICE", 200)
    monkeypatch.setattr(pieces, "CHUNK", 300)
    texts = random_texts(coder, 200, 3) + [" ".join(random_texts(coder, 50, 4))]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_many(texts)] == [library.encode(t) for t in texts]
    for t in ["".join(random.Random(5).choice("abcdefgh") for _ in range(200_000)), " " * 200_000, "otto" * 50_000]:
        began = time.perf_counter()
        assert np.frombuffer(next(coder.encode_many([t])), "<u4").tolist() == library.encode(t)
        assert time.perf_counter() - began < 20


def odd_documents(spark, extra=()):
    rows = [(k, t, "x") for k, t in enumerate([*ODD, *extra])] + [(None, "no id", "x"), (3, "  ", "x"), (3, "  ", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_round_trip_of_documents(spark, library):
    docs = odd_documents(spark)
    encoded = pieces.encode_documents(docs, PIECES)
    rows = pieces.decode_documents(encoded, PIECES).collect()
    assert len(rows) == len(ODD) + 2
    assert {r.doc_id: r.text for r in rows} == {k: library.decode(library.encode(t or "")) for k, t in enumerate(ODD)}
    assert pieces.encode_documents(docs.limit(0), PIECES).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode_documents(null, PIECES).collect()[0].text is None


def test_query_of_pieces(spark, library, sf_dir=SMALL):
    rows = queries.op13_piece_round_trip(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())


# alignment


def plain_links(a, library, text):
    """n_a, n_b, n_groups, digest of the groups, links as a Counter."""
    if not text:
        return 0, 0, 0, "", Counter()
    of_byte = {c: b for b, c in zip(list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256)), map(chr, list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))))}
    of_byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in of_byte)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
    parts_a = [bytes(of_byte[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return 0, 0, 0, "", Counter()
    ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
    groups, links, i, j = [], Counter(), 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
        links.update((p, q) for p in ids_a[i:x] for q in ids_b[j:y])
        i, j = x, y
    return len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def plain_alignment(texts, library):
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    found = [(d, *plain_links(a, library, t)) for d, t in texts]
    count = Counter(p for *_, links in found for p in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted((d, na, nb, ng, sum(k.values()), sum(n for p, n in k.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in k.items()), sha) for d, na, nb, ng, sha, k in found)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("chunk", [150, alignment.CHUNK])
def test_alignment_of_odd_documents(spark, library, chunk):
    docs = odd_documents(spark, random_texts(pieces.PieceCoder(PIECES), 60, 6))
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    assert as_rows(alignment.align_documents(docs, BYTES, PIECES, chunk)) == plain_alignment(texts, library)
    assert alignment.align_documents(docs.limit(0), BYTES, PIECES).count() == 0


def test_alignment_slices_a_long_text(spark, library, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 100)
    units = alignment.Units(BYTES, PIECES)
    texts = [" ".join(random_texts(units.b, 20, 7)), "short", ""]
    rows, row, key, times = alignment._documents(units, list(enumerate(texts)))
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    for k, t in enumerate(texts):
        n_a, n_b, n_groups, sha, links = plain_links(a, library, t)
        assert rows[k] == (k, n_a, n_b, n_groups, sum(links.values()), sha)
        assert dict(zip(key[row == k].tolist(), times[row == k].tolist())) == {p << 32 | q: n for (p, q), n in links.items()}


def test_query_of_alignment(spark, library, sf_dir=SMALL):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(queries.op11_token_alignment(spark, sf_dir)) == plain_alignment(texts, library)


# phrases


def plain_collocations(rows, longest, least, percent, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, longer in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * longer >= percent * f[p[i : i + m]]:
                        dropped.add(p[i : i + m])
        scored = []
        for p, a in candidates.items():
            if p in dropped:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("longest", "chunk", "bits"), [(3, phrases.CHUNK, phrases.MOST_BITS), (4, 120, phrases.MOST_BITS), (3, 90, 1), (2, 70, phrases.MOST_BITS)])
def test_collocations_against_plain(spark, monkeypatch, longest, chunk, bits):
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    r = random.Random(8)
    words = ["New", "york", "City", "É", "the", "of", "a\x00", "\xa0b", "A.b", "x,y"]
    rows = [("".join(r.choice(words) + r.choice([" ", "  ", "\t", ". ", "\n", " "]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [("new york city " * 100, "en"), (None, "en"), ("", None), ("w" * 200 + " the of " * 9, "de"), ("new york", "fr")]
    docs = spark.createDataFrame([(k, *x, "extra") for k, x in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(3)
    got = phrases.collocations(docs, longest, least=3, percent=50, top=7, chunk=chunk)
    assert phrase_rows(got) == plain_collocations(rows, longest, 3, 50, 7)


def test_scores_beyond_64_bits(spark):
    tables = [spark.createDataFrame(x, "lang string, phrase string, f long") for x in ([("en", "p", 4_000_000_019), ("en", "q", 3_999_999_979)], [("en", "p q", 3_999_999_971)])]
    row = phrases.cut_scores(tables).collect()[0]
    assert row.score == 1_000_000 * 3_999_999_971**2 // (4_000_000_019 * 3_999_999_979)


def test_empty_documents_have_no_phrases(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_filter_finds_what_spark_set(spark):
    level = spark.createDataFrame([("en", "new york"), ("und", "é")], "lang string, phrase string")
    held = phrases._Filter(phrases.bitmap(level))
    assert held.holds(b"en", pa.array([b"new york"])).all() and held.holds(b"und", pa.array(["é".encode()])).all()
    assert not held.holds(b"de", pa.array([b"new york"])).any()
    assert level.select(F.count("*")).first()[0] == 2
