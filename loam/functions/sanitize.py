"""Redaction of personal data by an ordered pack of rules.

Rules run one after the other over the text that the one before left. The matches of
a rule are collected first; those that hold a token of the allow-list, or whose value
(a group of the match, or all of it) a validator refuses, are left alone. The text is
then put together once, with a placeholder for each value that is left.

The rules are Python patterns (their digits, spaces and words are Unicode's), and they
alone decide, in one Arrow hop.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.slices import column_of


@dataclass(frozen=True)
class Rule:
    """``needs``: literals, lower case, of which a text holds one wherever a pattern
    matches; only a shortcut, none means that every text is searched."""

    label: str
    patterns: tuple[tuple[str, int], ...]  # pattern and the group that is its value
    validator: str | None = None
    needs: tuple[str, ...] = ()


# Labels, patterns, value groups and the allow-list of the default pack.
DEFAULT_RULES = (
    Rule("email", ((r"\b[a-zA-Z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0),), needs=("@",)),
    Rule("msisdn", ((r"(?i)\bmsisdn\b\s*[:=\-]?\s*(\+?[1-9][0-9\-\s]{6,18})\b", 1),), needs=("msisdn",)),
    Rule("phone", ((r"(?i)\b(?:phone|tel|telefono|m[óo]vil|mobile|cell|contact)\s*[:=\-]?\s*(\+?[1-9][0-9\-\s]{6,18})\b", 1),), needs=("phone", "tel", "vil", "mobile", "cell", "contact")),
    Rule("imsi", ((r"(?i)\bimsi-?\s*(\d{5,15})\b", 1),), needs=("imsi",)),
    Rule("imei", ((r"(?i)\bimei\s*[:=\-]?\s*(\d{15})\b", 1),), "luhn", needs=("imei",)),
    Rule("iccid", ((r"\b89\d{17,19}\b", 0),), needs=("89",)),
    Rule("api_key", ((r"(?i)(api[_-]?key|token|secret)\s*[:=]\s*([A-Za-z0-9_\-]{16,})", 2),), needs=("api", "token", "secret")),
    Rule("password", ((r"(?i)password\s*[:=]\s*([^\s,;]{4,})", 1), (r"(?is)<password>.*?<\/password>", 0)), needs=("password",)),
)
DEFAULT_ALLOW = ("chapter", "table", "figure", "release", "7.4.1", "OCA", "ASAP")
# letters that ignoring case takes for i, s and k
_FOLDED = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


def luhn(value: str) -> bool:
    digits = [int(x) for x in value if x.isdigit()]
    if not digits:
        return False
    doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def luhn_valid(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return (digits != "") & F.call_function("luhn_check", digits)


VALIDATORS: dict[str, Callable[[str], bool]] = {"luhn": luhn}


@dataclass(frozen=True)
class Pack:
    rules: tuple[Rule, ...] = DEFAULT_RULES
    allow: tuple[str, ...] = DEFAULT_ALLOW
    pseudonyms: bool = False
    salt: str = ""
    plain: str = "[{TYPE}]"
    pseudonym: str = "[{TYPE}:{HASH}]"

    def placeholder(self, label: str, value: str) -> str:
        named = (self.pseudonym if self.pseudonyms else self.plain).replace("{TYPE}", label.upper())
        return named.replace("{HASH}", hashlib.sha256((self.salt + value).encode()).hexdigest()[:10]) if self.pseudonyms else named

    def values(self, rule: Rule, pattern: str, group: int, text: str) -> Iterator[tuple[int, int]]:
        """Where the values of a pattern lie that are to go."""
        valid = VALIDATORS.get(rule.validator or "", bool)
        for found in re.finditer(pattern, text):
            begin, end = found.span(group)
            if begin >= 0 and not any(token in found[0] for token in self.allow) and (not rule.validator or valid(found[group])):
                yield begin, end

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        """The redacted text, and how many values of each label went."""
        counts: dict[str, int] = {}
        folded = text.translate(_FOLDED).lower()
        for rule in self.rules:
            if rule.needs and not any(n in folded for n in rule.needs):
                continue
            for pattern, group in rule.patterns:
                spans = list(self.values(rule, pattern, group, text))
                if not spans:
                    continue
                counts[rule.label] = counts.get(rule.label, 0) + len(spans)
                kept = [text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)])]
                named = [self.placeholder(rule.label, text[a:b]) for a, b in spans]
                text = "".join(x for pair in zip(kept, [*named, ""]) for x in pair)
        return text, counts


def pack_of(spec: dict | str, pseudonyms: bool = False, salt: str = "") -> Pack:
    """A pack from a rule file's contents: its enabled rules in the file's order, of each
    ``pattern`` before ``patterns``, with the flags i, m, s and x."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    rules = []
    for label, rule in (spec.get("pii") or {}).items():
        if not (rule or {}).get("enabled", False):
            continue
        for item in ([rule] if "pattern" in rule else []) + (rule.get("patterns") or []):
            flags = "".join(sorted(set(item.get("flags") or "") & set("imsx")))
            pattern = f"(?{flags}){item['pattern']}" if flags else item["pattern"]
            rules.append(Rule(label, ((pattern, item.get("group_value") or 0),), item.get("validator")))
    shown = spec.get("placeholder") or {}
    allowed = tuple((spec.get("allowlist") or {}).get("tokens") or ())
    return Pack(tuple(rules), allowed, pseudonyms, salt, shown.get("format", "[{TYPE}]"), shown.get("format_pseudonym", "[{TYPE}:{HASH}]"))


def sanitize(df: DataFrame, text: str = "text", mode: str = "on", pack: Pack = Pack()) -> DataFrame:
    """Adds ``sanitized`` and ``redactions`` (label to count).

    mode ``off``: the text, no counts; ``shadow``: the text, with counts; ``on``:
    the redacted text. A null text gives null and no counts.
    """
    none = F.create_map().cast("map<string,int>")
    if mode == "off":
        return df.withColumn("sanitized", F.col(text)).withColumn("redactions", none)

    def applied(texts: list) -> list:
        return [{"text": t, "counts": list(counts.items())} for t, counts in (pack.apply(t) if t is not None else (None, {}) for t in texts)]

    arrow = pa.struct([("text", pa.string()), ("counts", pa.map_(pa.string(), pa.int32()))])
    done = column_of(applied, "struct<text:string,counts:map<string,int>>", arrow)(F.col(text))
    # the same call twice is one evaluation
    return df.withColumns({"sanitized": done["text"] if mode == "on" else F.col(text), "redactions": done["counts"]})


def audit_rows(sanitized: DataFrame, profile: str, mode: str, key: str = "doc_id") -> DataFrame:
    """One row for each document with redactions: doc_id, profile, mode, redactions."""
    return sanitized.where(F.size("redactions") > 0).select(F.col(key).cast("string").alias("doc_id"), F.lit(profile).alias("profile"), F.lit(mode).alias("mode"), "redactions")


AUDIT = "doc_id string, profile string, mode string, redactions map<string,int>"


def write_audit(rows: DataFrame, path: str) -> None:
    """Appends audit rows to a log of JSON lines."""
    rows.select("doc_id", "profile", "mode", "redactions").write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log's rows; lines that are no JSON are left out."""
    rows = spark.read.schema(f"{AUDIT}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("doc_id is not null").drop("_broken")


# Patterns of the document redactor, and the words that tell an address
# from a section number.
_EMAIL, _URL, _KEY = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"https?://[^\s)>\"]+", r"\b[A-Fa-f0-9]{32,}\b"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_PRIVATE = rf"\b(?:(?:10|127|192)(?:\.{_OCTET}){{3}}|172\.(?:1[6-9]|2\d|3[01])(?:\.{_OCTET}){{2}})\b"
_HIGH = rf"\b(?:2[6-9]|[3-9]\d|1\d\d|2[0-4]\d|25[0-5])(?:\.{_OCTET}){{3}}\b"
_ANY = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"
_ADDRESS_WORDS = r"(?i)\b(?:ip|ipv4|ipv6|address|addr|subnet|gateway|gw|dns)\b"


def redact_document(c: Column, context: Column | None = None, terms: dict[str, list[str]] | None = None) -> Column:
    """E-mail addresses, URLs, hexadecimal keys, terms and IP addresses as placeholders.

    ``terms``: words to hide by the name of their placeholder. An IPv4 address whose
    first number is 25 at most and that is not of a private range looks like a section
    number, and goes only where ``context`` (by default the text) speaks of addresses.
    """
    context = c if context is None else context
    c = F.regexp_replace(c, _EMAIL, "[email]")
    c = F.regexp_replace(c, _URL, "[url]")
    c = F.regexp_replace(c, _KEY, "[key]")
    for name, words in (terms or {}).items():
        if words:
            c = F.regexp_replace(c, "(?i)\\b(?:" + "|".join(re.escape(w) for w in words) + ")\\b", f"[{name}]")
    c = F.regexp_replace(c, r"\b(?=[0-9A-Fa-f:]{6,}\b)(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b", "[ipv6]")
    sure = F.regexp_replace(F.regexp_replace(c, _PRIVATE, "[ip]"), _HIGH, "[ip]")
    return F.when(context.rlike(_ADDRESS_WORDS), F.regexp_replace(c, _ANY, "[ip]")).otherwise(sure)


def redact_paragraphs(blocks: DataFrame, text: str = "text", kind: str = "block_type", terms: dict[str, list[str]] | None = None) -> DataFrame:
    """Blocks with their texts redacted; headings stay as they are."""
    heading = F.coalesce(F.col(kind) == "heading", F.lit(False))
    return blocks.withColumn(text, F.when(heading, F.col(text)).otherwise(redact_document(F.col(text), terms=terms)))
