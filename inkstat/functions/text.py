"""Normalising and cutting text, as Column builders.

Java's `\\b` knows Unicode letters while `\\w` does not, so ASCII word boundaries
are written as look-arounds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def alternatives(terms) -> str:
    return "(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"


def bounded(pattern: str) -> str:
    return LEFT + pattern + RIGHT


def count(text, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_chars(text, chars: str) -> Column:
    """Occurrences of any of these characters, without a pattern."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def count_literal(text, term: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def if_there(text, term: str, value: Column, otherwise=0) -> Column:
    """value where the text holds the literal, which is far cheaper to look for."""
    return F.when(F.contains(text, F.lit(term)), value).otherwise(otherwise)


def per(n, words, scale: int) -> Column:
    """n in `scale` words; 0 without words."""
    return F.when(words > 0, n * float(scale) / words).otherwise(F.lit(0.0))


def split_words(text) -> Column:
    """Runs between ASCII white space that are not empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_split(text) -> Column:
    """Words cut at white space, empty ones at the ends included: never below 1."""
    return F.size(F.split(F.lower(text), r"\s+")).cast("long")


def count_words(text) -> Column:
    return F.size(split_words(text)).cast("long")


def count_runs(text) -> Column:
    """Runs of ASCII letters, digits and underscores."""
    return count(text, r"\w+")


def paragraphs(text) -> Column:
    """Parts between two or more newlines that are not blank."""
    return F.filter(F.split(text, r"\n\n+"), lambda p: F.trim(F.translate(p, "\n\t\r", "   ")) != "")


def sentences(text) -> Column:
    """Cut after `.`, `!`, `?` and white space; blank ones are left out."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?]+)\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(F.translate(s, "\n\t\r", "   ")) != "")


def ngrams(words, n: int) -> Column:
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(F.array().cast("array<string>"))


# Steps of prose extraction after the front matter, in order.
PROSE_STEPS = (
    (r"(?md)^import\s+.*$", ""),
    (r"(?md)^export\s+.*$", ""),
    (r"(?md)^(`{3,}|~{3,})[^\n]*\n[\s\S]*?\n\1\s*$", ""),
    (r"(?md)^\s*<[A-Z][a-zA-Z]*\b[^>]*/>\s*$", ""),
    (r"(?md)^\s*<[A-Z][a-zA-Z]*\b[^>]*>\s*$", ""),
    (r"(?md)^\s*</[A-Z][a-zA-Z]*>\s*$", ""),
    (r"(?md)^\s*</?\w+[^>]*>\s*$", ""),
    (r"(?md)^#{1,6}\s+", ""),
    (r"(?md)^>\s?", ""),
    (r"`[^`\n]+`", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\n{3,}", "\n\n"),
)


def strip(text) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def prose(text) -> Column:
    """Markdown and MDX without front matter, imports, code, tags and marks; the words stay."""
    end = F.locate("\n---", text, 4)
    out = F.when(F.startswith(text, F.lit("---")) & (end > 0), F.substring(text, end + 4, F.length(text))).otherwise(text)
    for pattern, new in PROSE_STEPS:
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def plain_html(html) -> Column:
    """The text of an HTML page: scripts, styles, comments and tags away, basic entities resolved, white space single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->|<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def syllables(word) -> Column:
    """Vowel groups, one less for a final e, one more for a consonant and le; at least 1."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = F.endswith(w, F.lit("e")).cast("int")
    le = w.rlike("[^aeiouy]le$").cast("int")
    return F.greatest(F.lit(1), groups - silent + le).cast("long")
