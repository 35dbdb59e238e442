"""Findings with their places, overlap with other texts and corpora, measures of trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import lexicons as L
from ..functions.text import LEFT, alternatives, bounded
from . import ngrams
from .syntax import CLAUSES

# Invisible characters.
INVISIBLE = {
    "\u200b": "Zero-Width Space", "\u200c": "Zero-Width Non-Joiner", "\u200d": "Zero-Width Joiner", "\u202f": "Narrow No-Break Space", "\u2060": "Word Joiner", "\u00ad": "Soft Hyphen", "\ufeff": "Byte Order Mark",
}
# What the overlap of n-grams of each length counts.
WEIGHTS = {3: 0.1, 4: 0.2, 5: 0.3, 6: 0.4}


def places(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, found, start (characters, from 0) of every match; ids tell documents apart.

    Only matches are shuffled, with the lengths of what lies between them.  A null
    text has none.
    """
    rows = docs.select("doc_id", F.transform(F.split("text", pattern), F.length).alias("before"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))
    rows = rows.select("doc_id", F.posexplode_outer(F.arrays_zip("before", "found")).alias("i", "z")).where("z.found is not null").select("doc_id", "i", "z.*")
    ahead = F.sum(F.col("before") + F.length("found")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("doc_id", "found", (F.coalesce(ahead, F.lit(0)) + F.col("before")).cast("long").alias("start"))


def _by(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id", name).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("start")).alias("positions"))


def marker_positions(docs: DataFrame) -> DataFrame:
    """doc_id, marker, n, positions, multiplier, severity, contribution (n times the multiplier): a row a document and vocabulary marker in it."""
    rows = _by(places(docs, "(?i)" + bounded(alternatives(L.MARKERS))).withColumn("marker", F.lower("found")), "marker")
    spec = rows.sparkSession.createDataFrame([(k, m, s) for k, (m, s) in L.MARKERS.items()], "marker string, multiplier double, severity string")
    return rows.join(F.broadcast(spec), "marker").withColumn("contribution", F.col("n") * F.col("multiplier"))  # a fixed list


def invisible_positions(docs: DataFrame) -> DataFrame:
    """doc_id, name, n, positions: a row a document and invisible character in it."""
    names = F.create_map(*(F.lit(x) for pair in INVISIBLE.items() for x in pair))
    return _by(places(docs, "[" + "".join(INVISIBLE) + "]").withColumn("name", F.element_at(names, F.col("found"))), "name")


def formulas(docs: DataFrame) -> DataFrame:
    """doc_id, openings, closings: each formula's first match, cut at 50 characters, in order of formulas; a null text has none."""
    text = F.coalesce("text", F.lit(""))
    first = lambda patterns: F.filter(F.array(*(F.substring(F.regexp_extract(text, f"(?i){LEFT}{p}", 0), 1, 50) for p in patterns)), lambda m: m != "")
    return docs.select("doc_id", first(L.OPENINGS).alias("openings"), first(L.CLOSINGS).alias("closings"))


def _grams(words: str, n: int) -> Column:
    """Hashes of the distinct n-grams."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, n))))).otherwise(F.array().cast("array<long>"))


def weighted_overlap(pairs: DataFrame, other: str = "other", weights: dict[int, float] = WEIGHTS) -> DataFrame:
    """doc_id, overlap_n (share of the text's distinct n-grams that the other text has), jaccard_n, and aggregate, their weighted sum.

    Within the row.  Lengths of which a text has no n-gram are null and count
    nothing; without any, aggregate is null too.  A null other text shares nothing.
    """
    rows = pairs.select("doc_id", ngrams.tokens(F.coalesce("text", F.lit(""))).alias("a"), ngrams.tokens(F.coalesce(other, F.lit(""))).alias("b"))
    rows = rows.withColumns({f"{side}_{n}": _grams(side, n) for n in weights for side in "ab"})
    rows = rows.withColumns({f"size_{n}": F.size(f"a_{n}") for n in weights} | {f"both_{n}": F.size(F.array_intersect(f"a_{n}", f"b_{n}")) for n in weights} | {f"other_{n}": F.size(f"b_{n}") for n in weights})
    c = F.col
    rows = rows.select(
        "doc_id", *(F.round(F.try_divide(c(f"both_{n}"), c(f"size_{n}")), 4).alias(f"overlap_{n}") for n in weights),
        *(F.when(c(f"size_{n}") > 0, F.round(c(f"both_{n}") / (c(f"size_{n}") + c(f"other_{n}") - c(f"both_{n}")), 4)).alias(f"jaccard_{n}") for n in weights),
    )
    sum_ = sum((F.coalesce(c(f"overlap_{n}"), F.lit(0.0)) * w for n, w in weights.items()), F.lit(0.0))
    return rows.withColumn("aggregate", F.when(F.coalesce(*(c(f"overlap_{n}") for n in weights)).isNotNull(), F.round(sum_, 4)))


def baseline(docs: DataFrame, corpus: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, grams, in_vocabulary (share of distinct n-grams that the corpus has), rank_divergence (mean difference of ranks by frequency over those; null without any).

    n-grams of equal frequency share their mean rank, so that no order among them
    matters.  The corpus's ranks come from the number of n-grams at each frequency:
    one row a frequency reaches the window that all of them share.  Documents
    without n-grams are left out.
    """
    known = ngrams.counted(corpus, n).groupBy("gram").agg(F.sum("n").alias("times"))
    levels = known.groupBy("times").agg(F.count("*").alias("many"))
    above = F.coalesce(F.sum("many").over(Window.orderBy(F.desc("times")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = known.join(levels.select("times", (above + (F.col("many") - 1) / 2).alias("corpus_rank")), "times").select("gram", "corpus_rank")
    ties = F.count("*").over(Window.partitionBy("doc_id", "n"))
    own = ngrams.counted(docs, n)
    own = own.select("doc_id", "gram", (F.rank().over(Window.partitionBy("doc_id").orderBy(F.desc("n"))) - 1 + (ties - 1) / 2).alias("rank"))
    rows = own.join(ranked, "gram", "left").groupBy("doc_id").agg(F.count("*").alias("grams"), F.count("corpus_rank").alias("shared"), F.avg(F.abs(F.col("rank") - F.col("corpus_rank"))).alias("apart"))
    return rows.select("doc_id", "grams", F.round(F.col("shared") / F.col("grams"), 4).alias("in_vocabulary"), F.round("apart", 2).alias("rank_divergence"))


@F.pandas_udf(StructType([StructField("yngve", DoubleType()), StructField("frazier", DoubleType()), StructField("dependency_length", LongType())]))
def _trees(heads: pd.Series, clauses: pd.Series) -> pd.DataFrame:
    sizes = heads.map(len).to_numpy()
    yngve, frazier, distance = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        size = sizes[some]
        first = np.cumsum(size) - size
        up = np.concatenate(heads.to_numpy()[some]).astype(np.int64) + np.repeat(first, size)
        at = np.arange(len(up))
        root = up == at
        kids = np.flatnonzero(~root)
        kids = kids[np.argsort(up[kids], kind="stable")]
        many = np.bincount(up[kids], minlength=len(up))
        place = np.arange(len(kids)) - (np.cumsum(many) - many)[up[kids]]
        right, leftmost = np.zeros(len(up)), np.zeros(len(up), bool)
        right[kids], leftmost[kids] = many[up[kids]] - place - 1, place == 0
        weight = np.where(np.concatenate(clauses.to_numpy()[some]).astype(bool) | root, 1.5, 1.0)
        # paths to the root, and paths as long as they lead up from first children, in all sentences at once
        end = len(up)
        long, above = right, up
        short, ahead = np.append(weight, 0.0), np.append(np.where(leftmost, up, end), end)
        for _ in range(int(size.max()).bit_length()):
            long, above = long + long[above], above[above]
            short, ahead = short + short[ahead], ahead[ahead]
        total = np.concatenate([[0.0], np.cumsum(short[:-1])])
        three = total[np.minimum(at + 3, np.repeat(first + size, size))] - total[at]
        yngve[some], frazier[some], distance[some] = np.add.reduceat(long, first) / size, np.maximum.reduceat(three, first), np.add.reduceat(np.abs(at - up), first)
    return pd.DataFrame({"yngve": yngve, "frazier": frazier, "dependency_length": distance})


def tree_measures(parsed: DataFrame) -> DataFrame:
    """doc_id, sentence_id, yngve, frazier, dependency_length of each sentence's tree; zeros without tokens.

    A dependency parse has no phrases: a token's path goes through its heads.  yngve
    is the mean over tokens of the siblings to the right of all on the path; frazier
    sums 1 (1.5 for clauses and the root) along the path until the first that is not
    its head's first child, the largest sum of three neighbours counts.
    """
    heads = F.transform("tokens", lambda t: t["head"])
    clauses = F.transform("tokens", lambda t: F.coalesce(t["dep"].isin(CLAUSES), F.lit(False)))
    return parsed.select("doc_id", "sentence_id", _trees(heads, clauses).alias("m")).select("doc_id", "sentence_id", "m.*")
