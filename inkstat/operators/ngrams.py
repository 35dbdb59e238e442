"""n-gram profiles and lexical diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import metrics as M
from ..functions.text import ngrams
from . import verdicts

#: Words, contractions and single signs, lower-cased.
TOKEN = r"[a-z0-9\x{80}-\x{10ffff}]+|'[a-z]+|[^\sa-z0-9\x{80}-\x{10ffff}]"


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def with_tokens(rows: DataFrame, key: str) -> DataFrame:
    """key and t, the tokens as a column of its own: n-grams must not cut the text once each."""
    return rows.select(key, tokens("text").alias("t"))


def counted(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, gram, n: counts within each document, combined before the shuffle."""
    rows = with_tokens(docs, "doc_id").select("doc_id", F.explode(ngrams(F.col("t"), n)).alias("gram"))
    return rows.groupBy("doc_id", "gram").agg(F.count("*").alias("n"))


#: Token hashes that a Python worker counts at once.
HASHES = 1 << 22


def _runs(batch: pa.RecordBatch, name: str):
    """Parts of a batch of at most about HASHES list items, with those, each row's first and number."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(lengths, dtype=np.int64) // HASHES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            n = lengths[a:b].astype(np.int64)
            yield batch.slice(a, b - a), batch.column(name).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.cumsum(n) - n, n


def _counted(hashes: np.ndarray, first: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of every distinct n-gram of every row."""
    many = np.maximum(size - n + 1, 0)
    owner = np.repeat(np.arange(len(size)), many)
    if not len(owner):
        return owner, owner.astype(np.uint64), owner
    at = np.arange(len(owner)) + np.repeat(first - np.cumsum(many) + many, many)
    gram = np.zeros(len(at), np.uint64)
    for k in range(n):
        gram = (gram ^ hashes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], gram[new], np.diff(np.append(new, len(gram)))


def counts(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """rows with total_n, unique_n, once_n and twice_n for each n in sizes instead of h, within the row: no shuffle.

    h: each token's 64-bit hash, in order; n-grams are told apart by hashes of
    them.  A null or empty array has no n-grams.
    """
    rows = rows.select(*(c for c in rows.columns if c != "h"), "h")
    names = [f"{c}_{n}" for n in sizes for c in ("total", "unique", "once", "twice")]

    def run(batches):
        for batch in batches:
            for part, h, first, size in _runs(batch, "h"):
                made = []
                for n in sizes:
                    owner, _, times = _counted(h, first, size, n)
                    made += [np.maximum(size - n + 1, 0), *(np.bincount(owner, w, len(size)).astype(np.int64) for w in (None, times == 1, times == 2))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, made)], [*part.schema.names[:-1], *names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *(StructField(c, LongType()) for c in names)]))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shares(n: int) -> dict[str, Column]:
    """ttr, hapax and repetition of counts(); null without n-grams."""
    total, unique, once = (F.col(f"{c}_{n}") for c in ("total", "unique", "once"))
    return {"ttr": F.try_divide(unique, total), "hapax": F.try_divide(once, unique), "repetition": F.try_divide(total - unique, total)}


def with_hashes(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, more, h: the tokens' hashes; the text is cut once."""
    return docs.select("doc_id", *more, tokens("text").alias("h")).withColumn("h", hashed(F.col("h")))


def profile(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, total, unique, ttr, hapax, repetition for documents that have n-grams."""
    rows = counts(with_hashes(docs), (n,)).where(F.col(f"total_{n}") > 0)
    return rows.select("doc_id", F.col(f"total_{n}").alias("total"), F.col(f"unique_{n}").alias("unique"), *(v.alias(k) for k, v in shares(n).items()))


def top(docs: DataFrame, n: int, k: int = 10) -> DataFrame:
    """Each document's k most frequent n-grams, ties in order of text."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "gram")
    return counted(docs, n).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, patterns, rep4, ttr5, rep6, ttr6, hapax6: one pass over the text."""
    rows = counts(with_hashes(docs, M.phrase_patterns(F.col("text")).alias("patterns")), (4, 5, 6))
    return rows.select(
        "doc_id", "patterns", shares(4)["repetition"].alias("rep4"), shares(5)["ttr"].alias("ttr5"), shares(6)["repetition"].alias("rep6"), shares(6)["ttr"].alias("ttr6"), shares(6)["hapax"].alias("hapax6")
    )


def verdict(docs: DataFrame, rules) -> DataFrame:
    rows = measured(docs)
    m = {c: F.col(c) for c in rows.columns}
    classification, confidence = verdicts.ngram(m, rules)
    return rows.select("*", classification.alias("classification"), confidence.alias("confidence"), verdicts.named(verdicts.ngram_flags(m, rules), verdicts.NGRAM_SIGNALS).alias("signals"))


def diversity(docs: DataFrame) -> DataFrame:
    """Type-token family over runs of letters; documents without any are left out."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc_id", F.size("w").cast("double").alias("n"), F.size(F.array_distinct("w")).cast("double").alias("v"))
    return rows.select("doc_id", (F.col("v") / F.col("n")).alias("ttr"), (F.col("v") / F.sqrt("n")).alias("rttr"), (F.col("v") / F.sqrt(2 * F.col("n"))).alias("cttr"), F.when(F.col("n") > 1, F.log("v") / F.log("n")).alias("log_ttr"))


def _letters(docs: DataFrame) -> DataFrame:
    """doc_id, h: hashes of the runs of letters."""
    rows = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("h"))
    return rows.withColumn("h", hashed(F.col("h")))


def hapaxes(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, types, once, twice of documents that have words."""
    rows = counts(_letters(docs), (1,)).where("total_1 > 0")
    return rows.select("doc_id", F.col("total_1").alias("tokens"), F.col("unique_1").alias("types"), F.col("once_1").alias("once"), F.col("twice_1").alias("twice"))


def mattr(docs: DataFrame, window: int = 50) -> DataFrame:
    """Mean type-token ratio of sliding windows; shorter documents: their own ratio.

    A word counts in the windows that hold it and not its last occurrence before.
    """

    def run(batches):
        for batch in batches:
            for part, h, first, size in _runs(batch, "h"):
                owner = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(h)) - first[owner]
                order = np.lexsort((place, h, owner))
                same = np.zeros(len(h), bool)
                same[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                before = np.full(len(h), -1)
                before[order[1:]] = np.where(same[1:], place[order][:-1], -1)
                wide = np.minimum(window, size)
                begins = np.maximum(np.maximum(0, place - wide[owner] + 1), before + 1)
                ends = np.minimum(place, (size - wide)[owner])
                total = np.bincount(owner, np.maximum(0, ends - begins + 1), len(size))
                some = size > 0
                mean = np.divide(total, (size - wide + 1) * wide, out=np.zeros(len(size)), where=some)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(some)), pa.array(mean[some])], ["doc_id", "mattr"])

    return _letters(docs).select(F.col("doc_id").cast("long"), "h").mapInArrow(run, "doc_id long, mattr double")


def zipf(docs: DataFrame) -> DataFrame:
    """Slope and fit of log frequency over log rank, per language."""
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    # ranks from the number of words at each frequency: one row a frequency, not a word, reaches the window
    levels = counts.groupBy("lang", "n").agg(F.count("*").alias("words"))
    above = F.sum("words").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    rows = levels.select("lang", "n", "words", (F.coalesce(above, F.lit(0)) + (F.col("words") + 1) / 2).alias("rank"))
    rows = rows.select("lang", F.log("rank").alias("x"), F.log("n").alias("y"))
    return rows.groupBy("lang").agg(F.count("*").alias("levels"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"))


def overlap(docs: DataFrame, benchmark: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, item_id, shared, jaccard of distinct n-grams, for pairs that share any: a join on n-grams, not on pairs.

    Both sides are cut once and n-grams are told apart by 64-bit hashes.  Rows that
    share an id are taken for one document if their numbers of n-grams agree.
    """
    def grams(rows, key):
        def run(batches):
            for batch in batches:
                for part, h, first, size in _runs(batch, "h"):
                    owner, gram, _ = _counted(h, first, size, n)
                    cuts = np.searchsorted(owner, np.arange(len(size) + 1))
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(gram.view(np.int64)))], ["key", "n", "g"])

        cut = rows.select(F.col(key).cast("long").alias("key"), tokens("text").alias("h")).withColumn("h", hashed(F.col("h"))).mapInArrow(run, "key long, n long, g array<long>")
        return cut.select(F.col("key").alias(key), F.col("n").alias(f"n_{key}"), F.explode("g").alias("gram"))

    a, b = grams(docs, "doc_id"), grams(benchmark, "item_id")
    rows = a.join(b, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.first("n_doc_id").alias("a"), F.first("n_item_id").alias("b"))
    return rows.select("doc_id", "item_id", "shared", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("jaccard"))


def mtld(docs: DataFrame, limit: float = 0.72) -> DataFrame:
    """Measure of textual lexical diversity, both directions, with a partial last factor; a fold, in Arrow batches."""
    def one(words: list[str]) -> float:
        factors, types, n = 0.0, set(), 0
        for w in words:
            types.add(w)
            n += 1
            if len(types) / n <= limit:
                factors, types, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(types) / n) / (1 - limit)
        return len(words) / factors if factors else float(len(words))

    @F.pandas_udf("double")
    def both(words: pd.Series) -> pd.Series:
        return words.map(lambda w: (one(list(w)) + one(list(w)[::-1])) / 2 if len(w) else None)

    return docs.select("doc_id", both(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("mtld"))
