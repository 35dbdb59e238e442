"""Language-model scoring: a pretrained byte trie (PPM) beside a smoothed word model."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, column, partition_id, slices, staged, text_bytes, word_hashes, words
from .ppm import Model, gram_keys

ORDER = 5
#: Keys (a context and its follower) and words of the broadcast heads; rarer ones are looked up by a join.
NODES, HEAD = 1 << 20, 1 << 19
#: Distinct keys that a task gathers before it hands them on.
GATHER = 1 << 20


def remainder(column_name: str, by: int):
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column_name).cast("string"), F.lit(""))) % by


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    new, back = np.unique(keys, return_inverse=True)
    return new, np.bincount(back, counts, len(new)).astype(np.int64)


def gather(docs: DataFrame, order: int) -> DataFrame:
    """Counts by kind: 0, word hashes of training rows; contexts of `order` bytes with their follower, 1 of training rows and 2 of others."""

    def count(batches):
        held: list[list] = [[], [], []]

        def out(kind):
            if held[kind]:
                keys, counts = _merged(held[kind])
                held[kind] = []
                for a in range(0, len(keys), 1 << 18):
                    k = keys[a : a + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(counts[a : a + (1 << 18)])], ["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(column(part, "text"))
                starts, ends, first = words(data, offsets, NOT_SPACE)
                train = column(part, "train").to_numpy(zero_copy_only=False)
                grams, own = gram_keys(data, offsets, order)[0], np.repeat(train, np.diff(offsets) + 1)
                for kind, keys in ((0, word_hashes(data, starts, ends)[np.repeat(train, np.diff(first))]), (1, grams[own]), (2, grams[~own])):
                    if not len(keys):
                        continue
                    held[kind].append(np.unique(keys, return_counts=True))
                    if sum(len(k) for k, _ in held[kind]) > GATHER:
                        held[kind] = [_merged(held[kind])]
                        if len(held[kind][0][0]) > GATHER // 2:
                            yield from out(kind)
        for kind in (0, 1, 2):
            yield from out(kind)

    return docs.select("text", "train").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _thresholds(counts: DataFrame, by: str, most: int) -> dict[int, int]:
    """Per value of `by` the smallest power of two that at most `most` counts reach."""
    rows = counts.groupBy(by, F.floor(F.log2("n")).cast("int").alias("bits")).agg(F.count("*").alias("rows")).collect()  # at most 64 a value
    found: dict[int, int] = {}
    for value in {r[by] for r in rows}:
        size, bits = 0, 63
        for r in sorted((r for r in rows if r[by] == value), key=lambda r: -r["bits"]):
            size += r["rows"]
            if size > most:
                break
            bits = r["bits"]
        found[value] = min(1 << bits, (1 << 63) - 1)
    return found


def gram_logs(grams: DataFrame, order: int) -> DataFrame:
    """key, seen, log: every key of training and other rows with how often it occurs and its log10 probability under the whole trie.

    grams: kind, key, n of `gather`.  All that a key's chain of escapes asks for from order 2 on
    shares the last two bytes of its context, so each task holds whole branches of the trie;
    orders 0 and 1, at most 65,792 rows, go to every task.
    """
    pairs = grams.where("kind = 1").groupBy(F.expr("key & 65535").alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 65,536 rows
    top = (pairs.column("key").to_numpy().view(np.uint64), pairs.column("n").to_numpy())
    shared = [_merged([(top[0] & np.uint64((1 << 8 * (j + 1)) - 1), top[1])]) for j in range(min(order, 1) + 1)]

    def run(batches):
        held = [tuple(column(batch, c).to_numpy() for c in ("kind", "key", "n")) for batch in batches]
        if not held:
            return
        kind, keys, n = (np.concatenate(c) for c in zip(*held))
        keys, train = keys.view(np.uint64), kind == 1
        own = []
        if train.any():
            own = [_merged([(keys[train], n[train])])]
            for j in range(order - 1, 1, -1):
                own.insert(0, _merged([(own[0][0] & np.uint64((1 << 8 * (j + 1)) - 1), own[0][1])]))
        model = Model([(k, c[:, None].astype(np.float32)) for k, c in [*shared, *(own if order > 1 else [])]], final=False)
        keys, seen = _merged([(keys, n)])
        for a in range(0, len(keys), 1 << 18):
            k = keys[a : a + (1 << 18)]
            logs = model.chain(k)[:, 0].astype(np.float64) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(seen[a : a + (1 << 18)]), pa.array(logs)], ["key", "seen", "log"])

    return grams.repartition(F.expr("shiftright(key, 8) & 65535")).mapInArrow(run, "key long, seen long, log double")


def _tails(keys: np.ndarray, doc: np.ndarray, docs: int) -> list[pa.Array]:
    """Per document its distinct keys and how often each occurs."""
    order_ = np.lexsort((keys, doc))
    k, d = keys[order_], doc[order_]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(k))).astype(np.int32)
    cuts = pa.array(np.searchsorted(d[new], np.arange(docs + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(cuts, pa.array(k[new].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times))]


SCORE_SCHEMA = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, score double, tail array<long>, tail_n array<int>, grams array<long>, grams_n array<int>"


def score(docs: DataFrame, train, order: int = ORDER, nodes: int = NODES, head: int = HEAD) -> DataFrame:
    """One row a document; train: a boolean column over docs that chooses what is learnt from.

    nodes, head: keys and words that are broadcast; no score depends on them.
    A null text is empty: it has its end token alone.  Rows that share a doc_id
    are scored one by one.  Words are told apart by 64-bit hashes.  With no
    training rows every symbol costs the same and N and V are zero.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", train.alias("train"))
    counts = staged(gather(docs, order), "lm-counts")
    word_counts = counts.where("kind = 0").select("key", "n")
    n_docs = docs.where("train").count()
    sums = word_counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total = (sums["n"] or 0) + n_docs
    bottom = float(np.log10(total + sums["v"] + bool(n_docs) + 1))
    least = _thresholds(word_counts.withColumn("kind", F.lit(0)), "kind", head).get(0, 1)
    table = word_counts.where(F.col("n") >= least).toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    common = spark.sparkContext.broadcast({"keys": keys, "n": table.column("n").to_numpy()})
    grams = staged(gram_logs(counts.where("kind > 0"), order), "lm-grams")
    often = _thresholds(grams.select(F.lit(1).alias("kind"), F.col("seen").alias("n")), "kind", nodes).get(1, 1)
    table = grams.where(F.col("seen") >= often).select("key", "log").toArrow()  # at most `nodes` rows
    trie = spark.sparkContext.broadcast({"keys": table.column("key").to_numpy().view(np.uint64), "logs": table.column("log").to_numpy()})

    def run(batches):
        rid = partition_id() << 40
        known, model = common.value, trie.value
        if "index" not in known:
            known["index"] = pd.Index(known["keys"])
            known["logs"] = np.log10(np.append(known["n"], 0) + 1.0)
        if "index" not in model:
            model["index"] = pd.Index(model["keys"])
            model["logs"] = np.append(model["logs"], 0.0)
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(column(part, "text"))
                starts, ends, first = words(data, offsets, NOT_SPACE)
                hashes = word_hashes(data, starts, ends)
                at = known["index"].get_indexer(hashes)
                doc = np.repeat(np.arange(len(part)), np.diff(first))
                n_known = np.bincount(doc, at >= 0, len(part)).astype(np.int64)
                logs = np.bincount(doc, known["logs"][at], len(part))
                tail = np.flatnonzero(at < 0)
                keys, begin = gram_keys(data, offsets, order)
                in_head = model["index"].get_indexer(keys)
                own = np.add.reduceat(model["logs"][in_head], begin)
                rare = np.flatnonzero(in_head < 0)
                rare_doc = np.searchsorted(begin, rare, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid + np.arange(len(part))), column(part, "doc_id"), pa.array(~column(part, "train").to_numpy(zero_copy_only=False)), pa.array(np.diff(first).astype(np.int64) + 1), pa.array(n_known), pa.array(logs), pa.array(own), *_tails(hashes[tail], doc[tail], len(part)), *_tails(keys[rare], rare_doc, len(part))],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "known", "score", "tail", "tail_n", "grams", "grams_n"],
                )
                rid += len(part)

    rows = staged(docs.mapInArrow(run, SCORE_SCHEMA), "lm-rows")
    listed = lambda kind, keys, times: F.transform(F.arrays_zip(keys, times), lambda x: F.struct(F.lit(kind).alias("kind"), x[keys].alias("key"), x[times].alias("times")))
    tails = rows.select("rid", F.explode(F.concat(listed(0, "tail", "tail_n"), listed(1, "grams", "grams_n"))).alias("w")).select("rid", "w.*")
    rare = word_counts.where(F.col("n") < least).select(F.lit(0).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("log"))
    rare = rare.unionByName(grams.where(F.col("seen") < often).select(F.lit(1).alias("kind"), "key", "log"))
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    logs = F.col("times") * F.col("log")
    tails = tails.join(rare, ["kind", "key"]).groupBy("rid").agg(of(0, F.col("times")).alias("more"), of(0, logs).alias("more_logs"), of(1, logs).alias("more_score"))
    rows = rows.drop("tail", "tail_n", "grams", "grams_n").join(tails, "rid", "left")
    end_log = float(np.log10(n_docs + 1.0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known") + F.coalesce("more_logs", F.lit(0.0)) + end_log - F.col("n_tokens") * bottom).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder("doc_id", 7) != 2)
