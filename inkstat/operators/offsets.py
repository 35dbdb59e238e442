"""Where things lie in a text: paragraphs and sentences with offsets, lines, context, protected ranges, blanking, corrections.

Offsets count characters from 0, ends are exclusive.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Front matter, fenced code, inline code of one or two backticks.
PROTECTED = re.compile(r"\A---\n[\s\S]*?\n---|^(`{3,}|~{3,})[^\n]*\n[\s\S]*?\n\1[ \t]*$|``[^`\n]+``|`[^`\n]+`", re.M)
RANGES = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))

# Categories of corrections that may be applied unseen.
SAFE = ["TYPOS", "TYPOGRAPHY", "PUNCTUATION", "CASING", "COMPOUNDING", "WHITESPACE", "REDUNDANCY"]


def _pieces(docs: DataFrame, separator: str, mark: str) -> DataFrame:
    """doc_id, i, piece, start: the text cut before and behind each separator, nothing lost."""
    parts = F.split(F.regexp_replace("text", f"({separator})", f"{mark}$1{mark}"), mark)
    rows = docs.select("doc_id", F.posexplode_outer(parts).alias("i", "piece")).where("piece is not null")
    ahead = F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(ahead, F.lit(0)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), start, end: parts between blank lines (which may hold white space) that are not blank."""
    rows = _pieces(docs, r"\n\s*\n", "\u0003").where(F.col("piece").rlike(r"\S"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1
    return rows.select("doc_id", number.cast("long").alias("paragraph"), "start", (F.col("start") + F.length("piece")).alias("end"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_id (from 1), start, end, sentence: cut after `.`, `!`, `?` and white space, and at blank lines; without the white space around."""
    rows = _pieces(docs, r"\n\s*\n|(?<=[.!?])\s+", "\u0003").where(F.col("piece").rlike(r"\S"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    bare = F.regexp_replace("piece", r"^\s+|\s+$", "")
    rows = rows.select("doc_id", number.cast("long").alias("sentence_id"), (F.col("start") + F.length(F.regexp_extract("piece", r"^\s*", 0))).alias("start"), bare.alias("sentence"))
    return rows.select("doc_id", "sentence_id", "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence")


def paragraph_bounds(sentences_: DataFrame, paragraphs_: DataFrame) -> DataFrame:
    """doc_id, paragraph, first and last sentence of each paragraph: a range join within the document."""
    s, p = sentences_.alias("s"), paragraphs_.alias("p")
    inside = (F.col("s.doc_id") == F.col("p.doc_id")) & (F.col("s.start") >= F.col("p.start")) & (F.col("s.start") < F.col("p.end"))
    return s.join(p, inside).groupBy(F.col("p.doc_id").alias("doc_id"), "paragraph").agg(F.min("sentence_id").alias("first"), F.max("sentence_id").alias("last"))


def line_at(text: Column, offset: Column) -> Column:
    """The line, from 1, that an offset lies in."""
    ahead = F.substring(text, F.lit(1), offset)
    return (1 + F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit("")))).cast("long")


def context(text: Column, offset: Column, length: Column, pad: int = 30) -> Column:
    """What stands around, newlines shown as \\n, dots where more follows."""
    start = F.greatest(F.lit(0), offset - pad)
    end = F.least(F.length(text), offset + length + pad)
    cut = F.replace(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise(""))


def _found(text: str) -> list[dict]:
    if "`" not in text and "~~~" not in text and not text.startswith("---"):
        return []
    return [{"start": m.start(), "end": m.end()} for m in PROTECTED.finditer(text)]


@F.pandas_udf(RANGES)
def protected_ranges(texts: pd.Series) -> pd.Series:
    """Ranges that no edit may touch, in order; a fence is closed by what opened it, which no pattern of the JVM's finds with its place."""
    return texts.map(lambda t: _found(t or ""))


def is_protected(ranges: Column, offset: Column) -> Column:
    return F.exists(ranges, lambda r: (offset >= r["start"]) & (offset < r["end"]))


_BLANKED = [
    (re.compile(r"^(`{3,})[^\n]*\n[\s\S]*?\n\1\s*$", re.M), None), (re.compile(r"^#{1,6}\s+.*$", re.M), None), (re.compile(r"^>\s?", re.M), None), (re.compile(r"`[^`\n]+`"), None),
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), 1), (re.compile(r"(?<!!)\[([^\]]*)\]\([^)]*\)"), 1),
]


def _blank(text: str) -> str:
    def spaces(m: re.Match, keep: int | None) -> str:
        if keep is None:
            return " " * len(m[0])
        a, b = m.start(keep) - m.start(), m.end(keep) - m.start()
        return " " * a + m[keep] + " " * (len(m[0]) - b)

    if text.startswith("---") and (end := text.find("\n---", 3)) >= 0:
        text = " " * (end + 4) + text[end + 4 :]
    for pattern, keep in _BLANKED:
        text = pattern.sub(lambda m, keep=keep: spaces(m, keep), text)
    return text


@F.pandas_udf(StringType())
def blanked(texts: pd.Series) -> pd.Series:
    """The text with front matter, code, headings and marks as spaces of the same length, so that offsets stay; labels of links stay too."""
    return texts.map(lambda t: _blank(t or ""))


def checked_corrections(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections (doc_id, offset, length, category, replacements) with line, before, after, context, applied.

    Applied are those of a safe category with a replacement that changes something,
    outside of protected ranges, and not overlapping an applied one behind them.
    """
    rows = corrections.join(docs.select("doc_id", "text", protected_ranges("text").alias("ranges")), "doc_id")
    t, at, n = F.col("text"), F.col("offset").cast("int"), F.col("length").cast("int")
    rows = rows.select("doc_id", "offset", "length", "category", "ranges", line_at(t, at).alias("line"), F.substring(t, at + 1, n).alias("before"), F.get("replacements", F.lit(0)).alias("after"), context(t, at, n).alias("context"))
    fit = F.col("category").isin(SAFE) & F.col("after").isNotNull() & (F.col("after") != F.col("before")) & ~is_protected(F.col("ranges"), F.col("offset"))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    behind = Window.partitionBy("doc_id", "fit").orderBy("offset", "length", "category").rowsBetween(1, Window.unboundedFollowing)
    clear = F.coalesce(F.col("offset") + F.col("length") <= F.min("offset").over(behind), F.lit(True))
    return rows.withColumn("applied", F.col("fit") & clear).drop("ranges", "fit")


def corrected(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """doc_id, text with the corrections applied from the end backwards, applied, skipped; documents without any stay."""
    rows = checked_corrections(docs, corrections)
    found = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("applied"), F.struct("offset", "length", "after"))), asc=False).alias("c"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped"))
    rows = docs.select("doc_id", "text").join(found, "doc_id", "left")
    none = F.coalesce("c", F.array().cast("array<struct<offset:long,length:long,after:string>>"))
    put = lambda t, c: F.concat(F.substring(t, F.lit(1), c["offset"].cast("int")), c["after"], F.substring(t, (c["offset"] + c["length"] + 1).cast("int"), F.length(t)))
    return rows.select("doc_id", F.aggregate(none, F.col("text"), put).alias("text"), F.coalesce("applied", F.lit(0)).alias("applied"), F.coalesce("skipped", F.lit(0)).alias("skipped"))
