"""Text functions as column expressions; all but the digest of JSON are JVM-side."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code point ranges that count as CJK.
CJK = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF\\uFF00-\\uFFEF\\x{20000}-\\x{2FA1F}"
CHARS_PER_TOKEN = 4
CJK_TOKENS_PER_CHAR = 1.25

#: Sections whose chunks are left out of retrieval by default.
BIBLIOGRAPHY_SECTIONS = ("references", "bibliography", "REFERENCES", "BIBLIOGRAPHY", "References", "Bibliography")
NOISE_SECTION = "^(references?|bibliography|acknowledg|appendix)"


def terms(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def cjk_terms(text: Column) -> Column:
    """Words as above, but runs of CJK characters as overlapping pairs (a lone character as itself)."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), F.lit(0))
    pairs = lambda run: F.when(
        run.rlike(f"^[{CJK}]{{2,}}$"),
        F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substr(run, i, F.lit(2))),
    ).otherwise(F.array(run))
    return F.flatten(F.transform(runs, pairs))


def index_terms(text: Column) -> Column:
    """The terms under which a text is found: cjk_terms, worked out only where it has CJK characters."""
    return F.when(text.rlike(f"[{CJK}]"), cjk_terms(text)).otherwise(terms(text))


_CJK_SIGNS = CJK.replace("\\x{20000}-\\x{2FA1F}", "\U00020000-\U0002FA1F")
_RUNS = re.compile(f"([{_CJK_SIGNS}]+)|[^\\W_{_CJK_SIGNS}]+")


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, as index_terms gives them for texts, sorted."""
    found: set[str] = set()
    for run in _RUNS.finditer(query.lower()):
        text = run[0]
        found.update([text[k : k + 2] for k in range(len(text) - 1)] if run[1] and len(text) > 1 else [text])
    return sorted(found)


def estimate_tokens(text: Column) -> Column:
    """A quarter token a character and 1.25 a CJK character, cut to a whole number, 1 at least; 0 for empty."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.char_length(F.regexp_replace(t, f"[^{CJK}]+", ""))
    tokens = (F.char_length(t) - cjk) / CHARS_PER_TOKEN + cjk * CJK_TOKENS_PER_CHAR
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.floor(tokens))).cast("int")


def truncate_text(text: Column, limit: int) -> Column:
    """Trimmed; if longer than limit, cut there, right-trimmed and marked with three dots."""
    t = F.regexp_replace(text, "^\\s+|\\s+$", "")
    return F.when(F.char_length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), "\\s+$", ""), F.lit("..."))).otherwise(t)


def strip_control_chars(text: Column) -> Column:
    """Without C0 controls but tab and newline, and without DEL."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")


def normalize_page_text(text: Column) -> Column:
    """Unix line ends, no controls, trimmed lines, runs of blank lines as one."""
    t = strip_control_chars(F.regexp_replace(text, "\\r\\n?", "\n"))
    t = F.regexp_replace(t, "(?m)^[^\\S\\n]+|[^\\S\\n]+$", "")
    return F.regexp_replace(F.regexp_replace(t, "\\n{2,}", "\n\n"), "^\\n+|\\n+$", "")


#: Spaces that become plain ones, and signs without width that go.
EXOTIC_SPACES, ZERO_WIDTH = "\u00a0\u2007\u202f\u2009", "\u200b\ufeff"


def normalize_markdown(text: Column) -> Column:
    """Unix line ends, entities decoded, no controls, plain spaces, single spaces, trimmed lines, single blank lines between."""
    from quire.functions.fields import decoded

    t = strip_control_chars(decoded(F.regexp_replace(text, "\\r\\n?", "\n")))
    t = F.regexp_replace(F.translate(t, EXOTIC_SPACES, " " * len(EXOTIC_SPACES)), f"[{ZERO_WIDTH}]", "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "\t", " ")), " {2,}", " ")), lambda x: x.isNotNull())
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(joined, "\\n{3,}", "\n\n"), "^\\n+|\\n+$", "")


def whole_ms(took: Column) -> Column:
    """A duration in whole milliseconds, halves up."""
    return F.round(took.cast("double"), 0).cast("long")


def word_and(haystacks: list[Column], query: str) -> Column:
    """Each word of the query (parted at white space and hyphens) is inside one of the haystacks."""
    words = [w.lower() for w in re.split(r"[\s\-]+", query.strip()) if w]
    out = F.lit(True)
    for w in words:
        inside = F.lit(False)
        for h in haystacks:
            inside = inside | F.coalesce(F.contains(F.lower(h), F.lit(w)), F.lit(False))
        out = out & inside
    return out


def occurrences(text: Column, word: str) -> Column:
    """How often a word occurs as a substring, by the length that replacing it takes away."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.char_length(low) - F.char_length(F.replace(low, F.lit(word), F.lit("")))) / len(word)


def lenient_int(value: Column) -> Column:
    """A whole number from text or numbers; null for blanks and garbage. Fractions are cut."""
    return F.trim(value.cast("string")).try_cast("double").try_cast("int")


def lenient_bool(value: Column) -> Column:
    """True only for true, 1 and yes."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def redact_secrets(text: Column) -> Column:
    """Log text with the values of keys, tokens and passwords masked."""
    t = F.regexp_replace(text, "(?i)(authorization:\\s*(?:bearer|basic)\\s+)\\S+", "$1***")
    return F.regexp_replace(t, "(?i)((?:api[_-]?key|token|secret|password)\\s*[=:]\\s*)[^\\s,;&]+", "$1***")


def is_bibliography(section: Column) -> Column:
    """Exact section names only; a missing section is not one."""
    return F.coalesce(section.isin(*BIBLIOGRAPHY_SECTIONS), F.lit(False))


def is_noise(text: Column, section: Column, section_title: Column) -> Column:
    """Too short for evidence, or from a section of references or the like."""
    name = F.lower(F.concat_ws(" ", F.coalesce(section, F.lit("")), F.coalesce(section_title, F.lit(""))))
    return (F.char_length(F.trim(text)) < 200) | F.trim(name).rlike(NOISE_SECTION)


def title_overlap(a: Column, b: Column) -> Column:
    """Shared words of three characters or more, as a share of the smaller set; 0 if one is empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.char_length(w) >= 3))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


@F.pandas_udf(T.StringType())
def record_digest(values: pd.Series) -> pd.Series:
    """SHA-256 of a JSON object with its keys in order, whatever order and spacing it came in; null for what is no JSON."""

    def one(value: str) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(value), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        except ValueError:
            return None

    return values.map(one, na_action="ignore")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """Tags, scripts, styles and comments dropped, common entities decoded, white space as single spaces."""
    t = F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?</\\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(t, "\\s+", " "))
