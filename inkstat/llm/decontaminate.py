"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents.  Its words become numbers: those that no
benchmark item holds part the text into runs, and runs shorter than the shortest
phrase are left out.  Every phrase is searched backwards in the shard's index,
its occurrences are located by sampled suffix positions, checked word by word
through their hashes, and merged into spans of words to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import ALNUM, column, put_back, set_aside, slices, staged, text_bytes, word_hashes, words
from .fm_index import FmIndex

WINDOW = 13
#: Benchmark text that one pass searches for; a larger benchmark takes more passes.
PASS_BYTES = 4 << 20
#: Text of one shard, which gets an index of its own; one longer document is a shard alone.
SHARD_BYTES = 8 << 20
_EXTRA = [StructField("__words", LongType()), StructField("__spans", ArrayType(LongType())), StructField("__items", ArrayType(StringType()))]


class Phrases:
    """Distinct windows of the items and who holds them; words are numbered from 1 in order of their hashes."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = words(data, offsets, ALNUM)
        h = word_hashes(data, starts, ends)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h) + 1
        owners: dict[tuple, set] = {}
        for (name, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist()):
            for k in range(a, max(b - window, a) + 1 if b > a else a):
                owners.setdefault(tuple(ids[k : min(k + window, b)].tolist()), set()).add(name)
        self.patterns = np.full((len(owners), window), -1, np.int64)
        self.size = np.array([len(p) for p in owners], np.int64)
        for row, p in zip(self.patterns, owners):
            row[window - len(p) :] = p
        self.owners = [sorted(o for o in s if o is not None) for s in owners.values()]

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in documents whose words' hashes are given: (place of the first word, window)."""
        none = np.zeros(0, np.int64)
        if not len(hashes) or not len(self.size):
            return none, none
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        symbol = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        new = symbol == 0
        new[first[:-1][first[:-1] < len(new)]] = True  # a run begins here, or this word parts runs
        begin = np.flatnonzero(new)
        begin = np.concatenate([[0], begin]) if not len(begin) or begin[0] else begin
        length = np.diff(np.append(begin, len(symbol)))
        parts = symbol[begin] == 0
        run_at, run_n = begin + parts, length - parts
        keep = run_n >= self.size.min()
        run_at, run_n = run_at[keep], run_n[keep]
        if not len(run_at):
            return none, none
        base = np.cumsum(run_n + 1) - run_n  # a 0 before each run
        source = np.repeat(run_at - base, run_n) + (place := np.repeat(base, run_n) + np.arange(run_n.sum()) - np.repeat(np.cumsum(run_n) - run_n, run_n))
        text = np.zeros(int(run_n.sum()) + len(run_n), np.int64)
        text[place] = symbol[source]
        index = FmIndex(text, len(self.vocabulary))
        low, high = index.search(self.patterns)
        hits = high - low
        which = np.repeat(np.arange(len(hits)), hits)
        rows = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        spots = index.locate(rows)
        run = np.searchsorted(base, spots, "right") - 1
        return run_at[run] + spots - base[run], which


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs plus __words (their number), __spans (begin, end, begin, ...: merged hit words) and __items (ids of items with hits).

    A null text has no words.  Items without words are ignored; a null item_id
    hits but is not listed.  Rows are marked one by one, whatever their ids.
    Columns of docs that have one of the three names give way.
    """
    return put_back(_marked(set_aside(docs, "text"), benchmark, window, pass_bytes), docs, *(f.name for f in _EXTRA))


def _marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(size // pass_bytes) + 1
    names = [f.name for f in docs.schema.fields]
    schema = StructType([*docs.schema.fields, *_EXTRA])
    for k in range(passes):
        chosen = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        phrases = spark.sparkContext.broadcast(Phrases([(r["item_id"], r["text"]) for r in chosen.collect()], window))  # about pass_bytes

        def run(batches, phrases=phrases, k=k):
            for batch in (shard for whole in batches for shard in slices(whole, most=SHARD_BYTES)):
                hashes, counts = [], []
                for part in slices(batch):
                    data, offsets = text_bytes(column(part, "text"))
                    starts, ends, first = words(data, offsets, ALNUM)
                    hashes.append(word_hashes(data, starts, ends))
                    counts.append(np.diff(first))
                if not hashes:
                    continue
                count = np.concatenate(counts)
                first = np.concatenate([[0], np.cumsum(count)])
                at, which = phrases.value.find(np.concatenate(hashes), first)
                spans = [[] for _ in range(len(batch))] if not k else [list(zip(s[::2], s[1::2])) for s in column(batch, "__spans").to_pylist()]
                found = [set() for _ in range(len(batch))] if not k else [set(x) for x in column(batch, "__items").to_pylist()]
                owner = np.searchsorted(first, at, "right") - 1
                for d, a, w in zip(owner.tolist(), (at - first[owner]).tolist(), which.tolist()):
                    spans[d].append((a, a + int(phrases.value.size[w])))
                    found[d].update(phrases.value.owners[w])
                flat = pa.array([[x for s in _merge(v) for x in s] for v in spans], pa.list_(pa.int64()))
                listed = pa.array([sorted(v) for v in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(count.astype(np.int64)), flat, listed], [*names, "__words", "__spans", "__items"])

        docs = docs.mapInArrow(run, schema)
        if k < passes - 1:
            docs = staged(docs, "marked")
    return docs


def n_hit():
    """Words inside spans."""
    odd = F.filter(F.col("__spans"), lambda x, i: i % 2 == 1)
    even = F.filter(F.col("__spans"), lambda x, i: i % 2 == 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return total(odd) - total(even)


def contaminated():
    return (n_hit() > 0) & (20 * n_hit() >= F.col("__words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents of which less than a twentieth lies inside occurrences; all their columns stay, whatever their names."""
    rows = _marked(set_aside(docs, "text"), benchmark, window).where(~contaminated())
    return rows.drop("__words", "__spans", "__items").toDF(*docs.columns)


def cut_spans(text: str, spans: list[int]) -> str:
    """text without the hit words from each span's first to its last; what stands around stays."""
    import re

    at = [m.span() for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join(out) + (text or "")[done:]


def op1_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    return rows.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
