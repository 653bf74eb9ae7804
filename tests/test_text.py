import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import sanitize, text


def cleaned(spark, values, **kw):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, text string")
    return [r.text for r in text.with_clean_text(df, **kw).orderBy("k").collect()]


# text, cleaned, cleaned where it holds tables (None: the same)
CASES = [
    ("", "", None),
    (None, "", None),
    ("e\u0301te\u0301 is a summer word", "\u00e9t\u00e9 is a summer word", None),
    ("soft\u00adhyphen and zero\u200bwidth and\u00a0space", "softhyphen and zerowidth and space", None),
    ("\ufb01nd the \ufb02ow of it", "find the flow of it", None),
    ("exam-\nple of a word-\ncut here-\nafter that", "example\n of a wordcut\n hereafter\n that", "exam-\nple of a word-\ncut here-\nafter that"),
    ("Big-\nOne is kept and a-\nbc too", "Big-\nOne is kept and a-\nbc too", None),
    ("aa-\nbbCC-\nddee and more words", "aabb\nCCddee\n and more words", "aa-\nbbCC-\nddee and more words"),
    ("Head\nbody one here\nHead\nbody two here\nHead\nbody three", "body one here\nbody two here\nbody three", None),
    ("Twice\nbody one here\nTwice\nbody two here", "Twice\nbody one here\nTwice\nbody two here", None),
    ("12 34\n\nTITLE LINE\n\nA Proper Title\n\nxx\n\nlong enough block of text", "12 34\n\nTITLE LINE\n\nA Proper Title\n\nlong enough block of text", None),
    ("a\r\nb\rc  d\t\te trailing   \nlines of words", "a\nb\nc d e trailing\nlines of words", None),
    ("   \n\n  ", "", None),
    ("x" + " " * 200_000 + "y and eight letters", "x y and eight letters", None),
    (" " * 200_000 + "\n" + "words enough for a block" + "\t" * 200_000, "words enough for a block", None),
]


def test_clean_text(spark):
    given = [c for c, _, _ in CASES]
    assert cleaned(spark, given) == [want for _, want, _ in CASES]
    assert cleaned(spark, given, tables=F.lit(True)) == [want if other is None else other for _, want, other in CASES]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab A.-\n\t\u00e9 ", max_size=120), min_size=1, max_size=30))
def test_properties_of_clean_text(spark, values):
    for before, after in zip(values, cleaned(spark, values)):
        assert after == after.strip() and "\t" not in after and "  " not in after and not re.search(r"[^\S\n]\n", after)
        assert not re.search(r"[A-Za-z]{2,}-\n[a-z]{2,}", after)
        left = re.sub(r"[\s-]", "", after)
        assert sum(c.isalpha() for c in left) <= sum(c.isalpha() for c in before)


def test_steps_are_computed_once(spark):
    from tests.test_plans import plan

    df = spark.createDataFrame([("some text",)], "text string")
    shown = plan(text.nonempty(df, text.cleaned(F.col("text"))))
    assert shown.count("BatchEvalPython") + shown.count("ArrowEvalPython") <= 4  # one node, named in the tree and in its details
    assert len(shown) < 20_000


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["imsi", "IMS\u0130", "im\u0131ei", "imei", "m\u017fisdn", "msisdn", "to\u212aen", "token", "=", ":", "-", " ", "\u00a0", "\u2003", "\n", "214011234567890", "490154203237518", "\u0662\u0661\u0664\u0660\u0661\u0661", "a@b.co", "8934071234567890123", "abcdefghij0123456789", "password", "hunter22", "+34 600 123 456", "cell", "table"]), max_size=12))
def test_shortcuts_change_nothing(words):
    pack = sanitize.Pack()
    bare = sanitize.Pack(tuple(sanitize.Rule(r.label, r.patterns, r.validator) for r in pack.rules))
    t = "".join(words)
    assert pack.apply(t) == bare.apply(t)


def test_unicode_spaces_and_digits(spark):
    given = ["imsi\u00a0214011234567890", "imsi \u0662\u0661\u0664\u0660\u0661\u0661", "phone:\u2003+34\u00a0600 123 456."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, text string")
    rows = sanitize.sanitize(df).orderBy("k").collect()
    assert [r.sanitized for r in rows] == ["imsi\u00a0[IMSI]", "imsi [IMSI]", "phone:\u2003[PHONE]."]
    assert [r.redactions for r in rows] == [{"imsi": 1}, {"imsi": 1}, {"phone": 1}]


def test_rule_files(spark, tmp_path):
    spec = {
        "placeholder": {"format": "<{TYPE}>", "format_pseudonym": "<{TYPE}#{HASH}>"},
        "allowlist": {"tokens": ["KEEP"]},
        "pii": {
            "ticket": {"enabled": True, "pattern": r"tick-(\d+)", "flags": "i", "group_value": 1, "patterns": [{"pattern": r"t\d{3}\b"}]},
            "off": {"enabled": False, "pattern": "word"},
            "empty": None,
            "line": {"enabled": True, "patterns": [{"pattern": r"^x .* y$", "flags": "m"}]},
        },
    }
    pack = sanitize.pack_of(__import__("json").dumps(spec))
    assert [r.label for r in pack.rules] == ["ticket", "ticket", "line"]
    assert pack.apply("TICK-12 t345 word\nx 1 y\nx KEEP y") == ("TICK-<TICKET> <TICKET> word\n<LINE>\nx KEEP y", {"ticket": 2, "line": 1})
    named = sanitize.pack_of(spec, pseudonyms=True, salt="s").apply("tick-1 tick-1")[0]
    assert re.fullmatch(r"tick-(<TICKET#[0-9a-f]{10}>) tick-\1", named)
    df = spark.createDataFrame([(1, "tick-7"), (2, "clean")], "doc_id int, text string")
    rows = sanitize.audit_rows(sanitize.sanitize(df, mode="shadow", pack=pack), "p", "shadow")
    sanitize.write_audit(rows, str(tmp_path / "log"))
    sanitize.write_audit(rows, str(tmp_path / "log"))
    (tmp_path / "log" / "part-broken.json").write_text("not json\n")
    assert [(r.doc_id, r.redactions) for r in sanitize.read_audit(spark, str(tmp_path / "log")).collect()] == [("1", {"ticket": 1})] * 2


def test_document_redactor(spark):
    cases = [
        ("at 10.0.0.1 and 2.1.4.1", "at [ip] and 2.1.4.1"),
        ("address 2.1.4.1 and 999.1.1.1", "address [ip] and 999.1.1.1"),
        ("see 172.16.0.9, 172.40.0.9, 26.1.1.1, 8.8.8.8", "see [ip], [ip], [ip], 8.8.8.8"),
        ("mail a.b@ex.org http://x.y/z " + "ab12" * 8, "mail [email] [url] [key]"),
        ("fe80:0:0:0:1:2:3:4 in ACME town", "[ipv6] in [customer] town"),
        (None, None),
    ]
    df = spark.createDataFrame([(k, c, "heading" if k == 9 else "paragraph") for k, (c, _) in enumerate(cases)] + [(9, "10.0.0.1", "heading")], "k int, text string, block_type string")
    done = sanitize.redact_paragraphs(df, terms={"customer": ["Acme"], "location": []}).orderBy("k").collect()
    assert [r.text for r in done] == [w for _, w in cases] + ["10.0.0.1"]


def test_sanitizer(spark):
    texts = ["mail a.b@ex.org now", "imei: 490154203237518 ok", "imei: 490154203237519 bad", "phone: +34 600 123 456.", "token=abcdefghij0123456789 x", "password: hunter22, then", "<password>\nx</password>", "see table@b.co", None, "", "imsi 214011234567890", "8934071234567890123", "msisdn: 34600123456"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    pack = sanitize.Pack()
    rows = sanitize.sanitize(df).orderBy("doc_id").collect()
    assert [(r.sanitized, r.redactions) for r in rows] == [pack.apply(t) if t is not None else (None, {}) for t in texts]
    assert rows[0].sanitized == "mail [EMAIL] now" and rows[1].redactions == {"imei": 1} and rows[2].redactions == {}
    assert rows[4].sanitized == "token=[API_KEY] x" and rows[5].sanitized == "password: [PASSWORD], then"
    shadow = sanitize.sanitize(df, mode="shadow").orderBy("doc_id").collect()
    assert [r.sanitized for r in shadow] == texts and shadow[0].redactions == {"email": 1}
    again = sanitize.sanitize(spark.createDataFrame([(k, r.sanitized) for k, r in enumerate(rows)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.sanitized for r in again] == [r.sanitized for r in rows]
    assert {r.doc_id for r in sanitize.audit_rows(sanitize.sanitize(df, mode="shadow"), "p", "shadow").collect()} == {"0", "1", "3", "4", "5", "6", "10", "11", "12"}
    named = sanitize.Pack(pseudonyms=True, salt="s").apply("a@b.co and a@b.co")[0]
    assert re.fullmatch(r"(\[EMAIL:[0-9a-f]{10}\]) and \1", named)


def test_lines_and_numbers(spark):
    df = spark.createDataFrame([("Contents\nOne .... 3\nTwo\t\t4\nReal Heading\nbody 5",), ("no toc here 7",)], "t string")
    assert [r.t for r in df.select(text.strip_toc(F.col("t")).alias("t")).collect()] == ["Real Heading\nbody 5", "no toc here 7"]
    n = spark.createDataFrame([("A", 1), ("Z", 26), ("AA", 27), ("BC", 55)], "c string, n int")
    assert all(r.x == r.n for r in n.select("n", text.column_number(F.col("c")).alias("x")).collect())
    s = spark.createDataFrame([(10,), (2048,), (3 << 20,)], "n long").select(text.human_size(F.col("n")).alias("s"))
    assert [r.s for r in s.collect()] == ["10 B", "2.0 KB", "3.00 MB"]
    t = spark.createDataFrame([("Héllo, wörld x1 a_b ñ!",)], "t string").select(text.alphabetic_tokens(F.col("t")).alias("t")).first().t
    assert t == ["héllo", "wörld", "ñ"]
