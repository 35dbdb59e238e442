"""Punctuation to change, sentence by sentence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count, count_words
from .editing import sentence_table

# What makes a sentence fit to take a dash: points, pattern, least number of words.
FIT = [
    (3, r"(?i),\s*(which|especially|particularly|specifically|notably)\s", 8), (3, r"(?i),\s*(a|an|the)\s+\w+(\s+\w+)?,", 8), (2, r"\([^)]{5,}\)", 8), (2, r"(?i),\s*(but|yet)\s", 12), (1, r"(?i)not\s+(just\s+)?\w+", 10),
    (1, ":", 12),
]
#: A sentence that could take a semicolon.
JOINED = r"(?i),\s*(and|but|so|yet|however|therefore)\s"


def dash_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_id (from 1), paragraph (from 0), dashes, semicolon, joined, fit, words, all_words of the document."""
    s = F.col("sentence")
    rows = sentence_table(docs, count_words(F.col("text")).alias("all_words")).withColumn("words", F.size(F.split(s, r"\s+")))
    n = F.col("words")
    points = sum((F.when(s.rlike(p) & (n >= least), v).otherwise(0) for v, p, least in FIT), F.when(n >= 15, 1).otherwise(0) + F.when(n >= 25, 1).otherwise(0))
    return rows.select(
        "doc_id", "sentence_id", "paragraph", count(s, "—").alias("dashes"), F.contains(s, F.lit(";")).alias("semicolon"), ((F.length(s) > 50) & s.rlike(JOINED)).alias("joined"), F.when(n < 8, 0).otherwise(points).cast("long").alias("fit"), "all_words",
    )


def punctuation_issues(marked: DataFrame, target: float = 1.5, least: float = 1.0) -> DataFrame:
    """doc_id, issue, sentence_id over dash_sentences(): what to change where.

    em_dash_density: above target dashes in 1000 words, sentences with several
    first.  low_em_dash_density: below `least` in over 500 words, the fittest
    sentence of each paragraph, then the other fit ones.  em_dash_stacking: of
    two paragraphs in a row with dashes the one with fewer such sentences.
    low_semicolon_density: below 2 in over 500 words.  em_dash_semicolon_ratio:
    dashes without any semicolon, the first three sentences.
    """
    c, doc = F.col, Window.partitionBy("doc_id")
    dashed, fits = c("dashes") > 0, (c("dashes") == 0) & ~c("semicolon") & (c("fit") > 0)
    last = lambda test: (~test).cast("int")  # noqa: E731  rows of the test come first and are numbered among themselves
    place = lambda *order: F.row_number().over(doc.orderBy(*order))
    around = lambda k: F.count_if(dashed).over(doc.orderBy("paragraph").rangeBetween(k, k))
    rows = marked.select(
        "*", F.sum("dashes").over(doc).alias("all_dashes"), F.count_if("semicolon").over(doc).alias("all_semicolons"), F.count_if(c("dashes") > 1).over(doc).alias("several"), around(0).alias("here"), around(1).alias("ahead"), around(-1).alias("behind"),
        place(last(dashed), "sentence_id").alias("dash_place"), place(last(dashed), (c("dashes") == 1).cast("int"), "sentence_id").alias("dense_place"),
        F.least(F.row_number().over(Window.partitionBy("doc_id", "paragraph").orderBy(last(fits), F.desc("fit"), "sentence_id")), F.lit(2)).alias("turn"),
    )
    rows = rows.withColumn("fit_place", place(last(fits), "turn", F.desc("fit"), "sentence_id"))
    per_mille = lambda n: c(n) * 1000.0 / c("all_words")
    excess = c("all_dashes") - F.floor(F.lit(target) * c("all_words") / 1000)
    needed = F.greatest(F.ceil(F.lit(least) * c("all_words") / 1000), F.ceil(F.lit(target * 0.5) * c("all_words") / 1000)) - c("all_dashes")
    long = c("all_words") > 500
    tests = {
        "em_dash_density": dashed & (per_mille("all_dashes") > target) & (c("dense_place") <= F.greatest(excess, "several")),
        "low_em_dash_density": fits & long & (per_mille("all_dashes") < least) & (c("fit_place") <= needed),
        "em_dash_stacking": dashed & (((c("ahead") > 0) & (c("here") <= c("ahead"))) | ((c("behind") > 0) & (c("here") < c("behind")))),
        "low_semicolon_density": long & (per_mille("all_semicolons") < 2) & ~c("semicolon") & c("joined"),
        "em_dash_semicolon_ratio": dashed & (c("all_semicolons") == 0) & (c("dash_place") <= 3),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(issue)) for issue, test in tests.items())))
    return rows.where(reduce(lambda a, b: a | b, tests.values())).select("doc_id", F.explode(found).alias("issue"), "sentence_id")
