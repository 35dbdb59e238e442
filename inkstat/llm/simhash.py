"""SimHash near-duplicates through pivot distance tables.

Every fingerprint carries its Hamming distances to fixed reference
fingerprints.  By the triangle inequality two fingerprints within k bits differ
by at most k in every one of these coordinates, so a pair is discarded by its
largest coordinate difference and only survivors are verified.  The table
prunes pairs but can't name them, so pairs come from block keys: fingerprints
within 4 bits agree in at least two of six blocks.  Only distinct fingerprints
are paired, copies of one are a class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, discard, set_aside, slices, staged

SHINGLE, SEED, BITS = 4, 42, 4
PIVOTS = 16


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprint_batch(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included; no words: zero."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = text.encode().lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= shingle:
            hashes.append(digest(joined, SEED))
            sizes[i] = 1
            continue
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate([[0], ends[: len(parts) - shingle] + 1]).tolist()
        hashes.extend([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
        sizes[i] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        h = np.array(hashes, np.uint64)
        first = (np.cumsum(sizes) - sizes)[some]
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), first)
            out[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the long column `row` if one is named; null texts have no words."""
    own = [row] if row else []

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fp = fingerprint_batch(pc.fill_null(column(part, "text"), "").to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(fp.view(np.int64)), *(column(part, c) for c in own)], ["doc_id", "fp", *own])

    return docs.select(F.col("doc_id").cast("long"), "text", *own).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *own)))


#: Widths of the six blocks; two of them agree wherever at most four bits differ.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one block key that a task pairs; larger buckets are dealt out as pairs of tiles.
BUCKET = 20_000
#: A fingerprint with over 1 / HOT of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 1000
#: Pairs looked at in one step.
STEP = 1 << 18


def _block_keys(fp: str):
    """An array of the 15 (pair of blocks, their bits) keys of a fingerprint."""
    low = np.cumsum((0, *BLOCKS)).tolist()
    part = [F.shiftrightunsigned(F.col(fp), low[i]).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for i, w in enumerate(BLOCKS)]
    return F.array(*(F.lit(k).cast("long") * (1 << 22) + part[i] * (1 << 11) + part[j] for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))))


def _local_links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: int, refs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within groups of rows, as (fingerprint, smallest one of its component in the group).

    Rows come sorted by group and distance to the first pivot.  Rows of one
    group whose sides differ, or are both -1, are paired.
    """
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)
    place = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) * 128 + table[:, 0]
    until = np.searchsorted(place, place + bits, "right")
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    counts = until - np.arange(n) - 1
    total = np.cumsum(counts)
    for begin in range(0, int(total[-1]) if n else 0, STEP):
        pair = np.arange(begin, min(begin + STEP, int(total[-1])))
        i = np.searchsorted(total, pair, "right")
        j = i + 1 + pair - (total[i] - counts[i])
        keep = (parent[i] != parent[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        for k in range(1, len(refs)):  # the pivot table: largest coordinate difference
            if not len(i):
                break
            keep = np.abs(table[i, k] - table[j, k]) <= bits
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        for a, b in zip(i[keep].tolist(), j[keep].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(i):
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    linked = np.flatnonzero(parent != np.arange(n))
    return [(fp[linked], fp[parent[linked]])] if len(linked) else []


def links(distinct: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that hold each component together."""
    if bits > 4:
        raise ValueError("six blocks find links of at most 4 bits")
    refs = pivots()
    first = int(refs[0].astype(np.int64))
    rows = distinct.select("fp", F.explode(_block_keys("fp")).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > bucket)
    rows = rows.join(hot, "key", "left")
    tiles = F.when(F.col("count").isNull(), F.lit(0)).otherwise(F.ceil(F.col("count") / bucket)).cast("long")
    rows = rows.select("fp", "key", tiles.alias("tiles")).withColumn("side", F.when(F.col("tiles") > 0, F.pmod(F.xxhash64("fp"), F.col("tiles"))).otherwise(-1))
    units = F.when(F.col("tiles") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.least(t, F.col("side")) * 1_000_000 + F.greatest(t, F.col("side")))).otherwise(F.array(F.lit(-1).cast("long")))
    rows = rows.select("fp", "key", "side", F.explode(units).alias("unit"))
    same = (F.col("unit") >= 0) & (F.floor(F.col("unit") / 1_000_000) == F.pmod("unit", F.lit(1_000_000)))
    rows = rows.withColumn("side", F.when(same, F.lit(-1)).otherwise(F.col("side")))
    rows = rows.withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.lit(first))))
    rows = rows.repartition("key", "unit").sortWithinPartitions("key", "unit", "d")

    def run(batches):
        held = None

        def done(t):
            group = np.stack([t["key"], t["unit"]], 1)
            change = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).any(axis=1)])) if len(group) else np.zeros(0, np.int64)
            for a, b in _local_links(change, t["side"], t["fp"].view(np.uint64), bits, refs):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            t = {c: column(batch, c).to_numpy() for c in ("fp", "key", "side", "unit")}
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            last = np.flatnonzero((t["key"] != t["key"][-1]) | (t["unit"] != t["unit"][-1])) if len(t["key"]) else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            yield from done({c: v[:cut] for c, v in t.items()})
            held = {c: v[cut:] for c, v in t.items()}
        if held is not None:
            yield from done(held)

    return rows.select("fp", "key", "side", "unit").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable), for the nodes of the edges (a, b).

    Rounds of smallest neighbouring label and of following labels; every round
    is written to the shared folder, and only counts come to the driver.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    both = edges.union(edges.select("b", "a"))
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        moved = staged(low.join(far, "new").select("node", F.col("label").alias("old"), F.least("new", "jump").alias("label")), "labels")
        discard(edges.sparkSession, labels)
        labels = moved.drop("old")
        labels.staged_at = moved.staged_at
        if not moved.where("old != label").limit(1).count():
            discard(edges.sparkSession, edges)
            return labels


def _components(rows: DataFrame, least: Column, bits: int, bucket: int) -> DataFrame:
    """fp, copies, component_id of every distinct fingerprint: the smallest value of the aggregate `least` that links of at most `bits` bits reach."""
    classes = staged(rows.groupBy("fp").agg(least.alias("least"), F.count("*").alias("copies")), "classes")
    labels = components(links(classes, bits, bucket))
    linked = labels.withColumnRenamed("node", "fp").join(classes.select("fp", "least"), "fp")
    named = linked.join(linked.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    out = staged(classes.join(named, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id")), "named")
    discard(rows.sparkSession, labels, classes)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most `bits` bits reach.

    Null and blank texts have fingerprint zero and are linked like any other.
    Rows that share a doc_id are documents of their own; a null doc_id never
    names a component that has another id.
    """
    rows = staged(fingerprints(docs, shingle), "simhash")
    named = _components(rows, F.min("doc_id"), bits, bucket)
    # fingerprints of more than a thousandth of all rows, fewer than a thousand of them, meet their rows without a shuffle
    most = (named.agg(F.sum("copies").alias("n")).first()["n"] or 0) / HOT
    hot = named.where(F.col("copies") > most).select("fp", "component_id")
    cold = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named.where(F.col("copies") <= most), "fp")
    return cold.select("doc_id", "fp", "component_id").unionByName(rows.join(F.broadcast(hot), "fp").select("doc_id", "fp", "component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs without all but one row of each component.

    Rows are numbered first, by partition and row.  The one with the smallest doc_id stays, null
    last and of equal ones the least number, so ids that are null or repeat decide for no other row.
    What is kept grows with the input, so the texts are dealt out by number and merged with it at every size.
    All columns stay, whatever their names.
    """
    given, docs = docs, set_aside(docs, "doc_id", "text")
    docs = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = fingerprints(docs, shingle, "__row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__row"))
    kept = _components(rows, least, bits, bucket).select(F.col("component_id.__row").alias("__row")).distinct()
    return docs.join(kept.hint("merge"), "__row", "left_semi").drop("__row").toDF(*given.columns)


def op9_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
