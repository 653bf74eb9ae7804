"""Text cleaning as Column expressions; Unicode composition is the one Arrow hop."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.slices import column_of

SPACE = r"(?U)\s"
#: What that pattern matches, as Unicode has it.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip_ws(c: Column) -> Column:
    """Without white space (as Unicode has it) at either end."""
    return F.btrim(c, F.lit(SPACES))


_composed = column_of(lambda texts: [None if t is None else unicodedata.normalize("NFC", t) for t in texts], "string", pa.string())


def nfc(c: Column) -> Column:
    """Unicode NFC. Texts of ASCII alone are in that form: nulls cross to Python in their place."""
    return F.coalesce(_composed(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strip_invisible(c: Column) -> Column:
    return F.translate(c, "\u00a0\u00ad\u200b\u200c\u200d", " ")


def ligatures(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))


def normalize_lines(c: Column) -> Column:
    """Line ends as line feeds, lines without trailing space, single blanks."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]++(?=\n|\z)", "")
    return strip_ws(F.regexp_replace(c, r"[ \t]+", " "))


def drop_repeated_lines(c: Column, longest: int = 60, least: int = 3, share: float = 0.05) -> Column:
    """Without short lines that occur ``least`` times or more and make up over ``share``."""
    def repeated(lines: Column) -> Column:
        many = F.greatest(F.lit(least), (F.floor(F.size(lines) * share) + 1).cast("int"))
        # sorted, a line that occurs n times stands n - 1 places after itself
        return bound(many, lambda m: bound(F.array_sort(F.filter(lines, lambda x: (x != "") & (F.char_length(x) <= longest))), lambda o: bound(F.slice(o, m, F.greatest(F.size(o) - m + 1, F.lit(0))), lambda later: F.array_distinct(F.filter(F.zip_with(F.slice(o, F.lit(1), F.size(later)), later, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())))))

    kept = lambda lines: bound(repeated(lines), lambda drop: F.when(F.size(drop) > 0, F.array_join(F.filter(lines, lambda x: ~F.array_contains(drop, x)), "\n")))
    return bound(c, lambda t: F.coalesce(bound(F.split(t, "\n", -1), kept), t))


def dehyphenate(c: Column) -> Column:
    """Joins words that a hyphen splits at a line's end.

    One pass is all: what it writes ends in a line feed after letters, so it makes no
    new hyphen at a line's end, and what follows begins with no small letter.
    """
    # fixed value: letters on either side
    return F.regexp_replace(c, r"([A-Za-z]{2,})-\n([a-z]{2,})", "$1$2\n")


def heading_like(c: Column) -> Column:
    short = (F.char_length(c) <= 60) & (c != "")
    # fixed values: lines of capitals, and words that begin with one
    return short & (c.rlike(r"^[A-Z0-9 ,.:;()\-/]+\z") | c.rlike(r"^[A-Z][a-z]+( [A-Z][a-z]+)*\z"))


def drop_noise(c: Column, least: int = 10) -> Column:
    """Blocks (between empty lines) with ten letters, or that look like headings."""
    letters = lambda b: F.char_length(F.regexp_replace(b, r"[^\p{L}]+", ""))
    kept = lambda b: (letters(b) >= least) | bound(strip_ws(b), heading_like)
    return strip_ws(F.array_join(F.filter(F.split(c, "\n\n", -1), kept), "\n\n"))


def cleaned(c: Column, tables: Column | None = None) -> Column:
    """The text after all steps of cleaning; null: empty. Where ``tables`` holds,
    hyphens at line ends stay. Each step's result is computed once."""

    def joined(t: Column) -> Column:
        return dehyphenate(t) if tables is None else F.when(F.coalesce(tables, F.lit(False)), t).otherwise(dehyphenate(t))

    steps = lambda t: drop_noise(joined(drop_repeated_lines(normalize_lines(ligatures(strip_invisible(t))))))
    return bound(nfc(F.coalesce(c, F.lit(""))), steps)


def with_clean_text(df: DataFrame, text: str = "text", tables: Column | None = None) -> DataFrame:
    """``df`` with the column cleaned; null and empty become empty."""
    return df.withColumn(text, cleaned(F.col(text), tables))


def nonempty(df: DataFrame, text: Column, name: str = "text") -> DataFrame:
    """``df`` with the column ``name``, without the rows in which it is empty.

    The text passes a generator, so the filter runs on what was computed and not, pushed
    down, on the expression once more.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    rows = df.select(*others, F.explode_outer(F.array(text)).alias(name)).where(F.col(name) != "")
    return rows.select(*(df.columns if name in df.columns else [*df.columns, name]))


def collapse_ws(c: Column) -> Column:
    return strip_ws(F.regexp_replace(c, rf"{SPACE}+", " "))


def hash_norm(c: Column) -> Column:
    return F.sha2(F.lower(strip_ws(c)), 256)


def pseudonym(c: Column, salt: str = "") -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, 10)


def truncated(c: Column, length: int = 80) -> Column:
    return F.when(F.char_length(c) <= length, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, max(0, length - 3)), rf"{SPACE}+\z", ""), F.lit("...")))


def alphabetic_tokens(c: Column) -> Column:
    """Lower-case words, punctuation as space, of letters alone; repeats stay."""
    words = F.split(strip_ws(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")), rf"{SPACE}+")
    return F.filter(words, lambda w: w.rlike(r"^\p{L}+\z"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def human_size(c: Column) -> Column:
    """Bytes, kilobytes to one digit or megabytes to two, half to even."""
    kb, mb = 1024, 1024 * 1024
    return F.when(c < kb, F.concat(c.cast("string"), F.lit(" B"))).when(c < mb, F.concat(F.format_string("%.1f", F.bround(c / kb, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", F.bround(c / mb, 2)), F.lit(" MB")))


def column_number(letters: Column) -> Column:
    """Spreadsheet column letters as a number."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))


# predicates over lines of tables of contents and headings


def is_toc_anchor(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("table of contents") | (strip_ws(low) == "contents")


def is_toc_like(c: Column) -> Column:
    # fixed values: what counts as a line of a table of contents
    patterns = [r"\.{3,}\s*\d{1,4}\s*$", r"(?:\t+|\s{4,})\d{1,4}\s*$", r"^\s*\d+(\.\d+)*\s*[A-Za-z][^0-9]{0,80}?\d{1,4}\s*$", r"(?i)^\s*Appendix[^0-9]{0,20}?\d{1,4}\s*$"]
    s = strip_ws(c)
    out = F.lit(False)
    for p in patterns:
        out = out | s.rlike(p)
    return out


# fixed values: lines of tables of contents, and entries within a line
TOC_LEADER, TOC_TAB, TOC_NUMBERED = r"\.{3,}\s*\d+$", r"\t+\s*\d+$", r"^\s*\d+(\.\d+)*\s+.+\s+\d{1,4}$"
TOC_ENTRY = r"\b\d+(?:\.\d+)*\s*[A-Za-z][^0-9]{0,80}?\s*\d{1,4}\b"
TOC_SHORTEST, TOC_LONGEST = 4, 160


def is_toc_line(c: Column) -> Column:
    """Dotted leaders and a page number at the end."""
    return c.rlike(TOC_LEADER)


def is_toc_strict(c: Column) -> Column:
    """Leaders, a tab, or a numbered heading, before a page number at the end."""
    return (F.char_length(c) >= TOC_SHORTEST) & (c.rlike(TOC_LEADER) | c.rlike(TOC_TAB) | c.rlike(TOC_NUMBERED))


def is_toc_candidate(c: Column) -> Column:
    """A line of some length that looks like one of a table of contents."""
    return (F.char_length(c) <= TOC_LONGEST) & is_toc_like(c)


def toc_entries(c: Column) -> Column:
    """How many entries a line holds, where several were run together."""
    return F.size(F.regexp_extract_all(c, F.lit(TOC_ENTRY), F.lit(0)))


def is_heading_line(c: Column) -> Column:
    """Up to 80 characters, no digit last, 70 % letters and space."""
    # fixed values: the length, and the share
    kept = F.char_length(F.regexp_replace(c, r"(?U)[^\p{L}\s]", ""))
    return (c != "") & (F.char_length(c) <= 80) & ~strip_ws(c).rlike(r"\d\z") & (kept >= F.char_length(c) * 0.7)


TOC_STATE = "struct<inside:boolean,drop:boolean>"


def toc_step(inside: Column, line: Column, stop_on_heading: bool = True) -> Column:
    """(inside, drop) after a line, given whether a table of contents was open before it."""

    def step(heading: Column) -> Column:
        toc = is_toc_like(line) | (strip_ws(line).rlike(r"\d{1,4}\s*\z") & ~heading)
        anchor = ~inside & is_toc_anchor(line)
        ends = inside & heading & F.lit(stop_on_heading)
        return F.struct((anchor | (inside & ~ends)).alias("inside"), (anchor | (inside & ~ends & toc)).alias("drop"))

    return bound(is_heading_line(line), step)


def strip_toc(c: Column, stop_on_heading: bool = True) -> Column:
    """Without the region that an anchor line opens: an ordered fold over the lines.

    The fold carries the text so far as pieces of a string, never a growing array.
    """
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("inside"))

    def step(s: Column, line: Column) -> Column:
        return bound(toc_step(s["inside"], line, stop_on_heading), lambda t: F.struct(F.when(t["drop"], s["kept"]).otherwise(F.concat(s["kept"], F.lit("\n"), line)).alias("kept"), t["inside"].alias("inside")))

    return F.aggregate(F.split(c, "\n", -1), start, step, lambda s: F.substr(s["kept"], F.lit(2)))


def is_bullet(c: Column) -> Column:
    return c.rlike(r"^\s*[-*•–·]\s+")


def is_numbered(c: Column) -> Column:
    return c.rlike(r"^\s*\d+(\.\d+)*[.)]?\s+\S")  # fixed value


def numeric_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)*)", 1), F.lit(""))


def current_heading(section_heading: Column, heading_path: Column) -> Column:
    return F.coalesce(F.nullif(strip_ws(section_heading), F.lit("")), F.try_element_at(heading_path, F.lit(-1)))


# numbers before headings


def sop_heading(c: Column) -> Column:
    """struct<number, title> of a line that begins with SOP and a number, or null."""
    pattern = r"(?i)^\s*sop\s*(\d+)\s*[:\-]?\s*(.*)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("number"), F.nullif(strip_ws(F.regexp_extract(c, pattern, 2)), F.lit("")).alias("title")))


def integer_major(c: Column) -> Column:
    """The whole number that a line begins with, or null."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+)(?:\b|[.)-])", 1), F.lit(""))


def without_major(c: Column, major: Column) -> Column:
    """A heading without the number ``major`` (and a sign after it) at its start."""
    body = strip_ws(c)
    rest = F.regexp_replace(F.substr(body, F.char_length(major) + 1), r"^\s*[.)-]?\s*", "")
    return F.when(F.coalesce(major, F.lit("")) == "", body).when(body.startswith(major), strip_ws(rest)).otherwise(body)


def without_number(c: Column) -> Column:
    """A heading without the dotted number at its start."""
    return strip_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*\d+(?:\.\d+)*\s*[).\-:]?\s*", ""))


def display_number(prefix: Column) -> Column:
    """A dotted number's first two parts."""
    return F.array_join(F.slice(F.split(prefix, r"\."), 1, 2), ".")


def toc_entry(c: Column) -> Column:
    """struct<prefix, title, level> of a numbered line of a table of contents, or null.

    Leaders of dots and a page number at the end are no part of the title.
    """
    plain = collapse_ws(F.regexp_replace(F.translate(c, "\t–—", " --"), r"\.{3,}", " "))

    def entry(line: Column) -> Column:
        prefix = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.? (.*)$", 1)
        title = strip_ws(F.regexp_replace(F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.? (.*)$", 2), r" \d{1,4}$", ""))
        return F.when((prefix != "") & (title != ""), F.struct(prefix.alias("prefix"), title.alias("title"), F.size(F.split(prefix, r"\.")).alias("level")))

    return bound(plain, entry)
