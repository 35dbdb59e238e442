"""Packing by non-negative least squares over shallow length combinations.

Every document is cut into full windows and a remainder.  The remainders'
histogram (at most window-1 counts) is all that the driver sees: it enumerates
pairs and triples of lengths that fill a window, solves their repeat counts by
non-negative least squares, and rounds them within the histogram.  The residual
is packed greedily, the longest piece first and then whatever is longest of
those that still fit; what no such sequence fills to the end is laid end to end,
cutting where a window fills.  The tail is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, partition_id, slices, staged
from .tokens import ENCODE_BYTES, encoder

WINDOW = 2048


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows a <= b <= c (a is 0 for pairs) of the given lengths with a + b + c = window."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    rows = []
    for a in [0, *lengths[3 * lengths <= window].tolist()]:
        b = lengths[(lengths >= max(a, 1)) & (2 * lengths <= window - a)]
        c = window - a - b
        keep = there[c]
        rows.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = 400, gain: float = 1e-3) -> np.ndarray:
    """Non-negative least squares: repeat counts x for which the combos' lengths come near the histogram.

    Multiplicative steps x * A'h / A'Ax keep x non-negative and never raise the error;
    they end when ten of them lower it by less than the share `gain`.
    """
    h = histogram.astype(float)
    h[0] = 0
    size = len(h)

    def times(x):  # A x
        out = sum(np.bincount(combos[:, k], x, size) for k in range(3))
        out[0] = 0
        return out

    def back(v):  # A' v
        return v[combos[:, 0]] + v[combos[:, 1]] + v[combos[:, 2]]

    target = back(h)
    x = np.full(len(combos), h.sum() / max(1, 3 * len(combos)))
    last = np.inf
    for k in range(steps):
        made = times(x)
        if k % 10 == 0:
            error = float(((made - h) ** 2).sum())
            if error > (1 - gain) * last:
                break
            last = error
        x *= target / np.maximum(back(made), 1e-12)
    return x


def greedy(rest: list[int], window: int) -> list[tuple[list[int], int]]:
    """Sequences that the longest piece left, then always the longest that fits, fill to the end: their lengths and how many of each.

    rest[l]: pieces of l tokens; what goes into sequences is taken out of it.
    """
    made = []
    there = [n for n in range(1, window) if rest[n]]
    for start in reversed(there.copy()):
        while rest[start]:
            used: dict[int, int] = {start: 1}
            gap, at = window - start, bisect_right(there, window - start)
            while gap and at:
                n = there[at - 1]
                take = min(rest[n] - used.get(n, 0), gap // n)
                if take > 0:
                    used[n] = used.get(n, 0) + take
                    gap -= take * n
                at = min(at - 1, bisect_right(there, gap))
            if gap:
                break  # no end without a cut
            repeats = min(rest[n] // k for n, k in used.items())
            made.append(([n for n, k in used.items() for _ in range(k)], repeats))
            for n, k in used.items():
                rest[n] -= repeats * k
                if not rest[n]:
                    there.remove(n)
    return made


@dataclass
class Plan:
    """slots: from which rank of which length on (length << 40 | rank) a piece goes to which sequence and offset."""

    window: int
    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    covered: np.ndarray  # by length: ranks below go to a combination
    base: np.ndarray  # by length: where its residual begins in the residual's stream
    sequences: int  # of combinations and of the greedy part
    stream: int  # tokens of the residual
    count: int = 0  # sequences in all, without the full windows

    def tail(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the stream's sequences after its last full window."""
        rest, at, out = self.stream % self.window, self.stream - self.stream % self.window, []
        for bit in reversed(range(self.window.bit_length())):
            if rest >> bit & 1:
                out.append((at, 1 << bit))
                at += 1 << bit
        return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)

    def place(self, lengths: np.ndarray, ranks: np.ndarray):
        """Per piece: sequence, offset (-1: it lies in the residual's stream), place in the stream."""
        at = np.searchsorted(self.keys, (lengths << 40) | ranks, "right") - 1
        fits = ranks < self.covered[lengths]
        at = np.where(fits, at, 0)
        first = self.keys[at] & ((1 << 40) - 1) if len(self.keys) else ranks
        sequence = np.where(fits, self.sequence[at] + ranks - first, -1) if len(self.keys) else np.full(len(ranks), -1)
        offset = np.where(fits, self.offset[at], -1) if len(self.keys) else np.full(len(ranks), -1)
        return sequence, offset, self.base[lengths] + (ranks - self.covered[lengths]) * lengths


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """histogram[l]: remainders of l tokens, l < window."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(np.flatnonzero(left), window)
    repeats = np.zeros(len(combos), np.int64)
    rest = left.tolist()
    if len(combos):
        x = solve(combos, left)
        for j in np.argsort(-x, kind="stable").tolist():
            a, b, c = combos[j].tolist()
            want = int(np.ceil(x[j] - 1e-9))
            if b == c:
                fits = rest[b] // (3 if a == b else 2)
            elif a == b:
                fits = min(rest[a] // 2, rest[c])
            else:
                fits = min(rest[b], rest[c])
            if a and a != b:
                fits = min(fits, rest[a])
            if (n := min(want, fits)) > 0:
                repeats[j] = n
                for k in (a, b, c):
                    if k:
                        rest[k] -= n
    filled = [([v for v in combos[j].tolist() if v], int(repeats[j])) for j in np.flatnonzero(repeats).tolist()] + greedy(rest, window)
    n = np.array([times for _, times in filled], np.int64)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(filled)), [len(lengths) for lengths, _ in filled]) if filled else np.zeros(0, np.int64)
    slot_length = np.array([v for lengths, _ in filled for v in lengths], np.int64)
    begin = np.cumsum(slot_length) - slot_length
    slot_offset = begin - begin[np.searchsorted(of, of)] if len(of) else begin
    slot_first, slot_n = first[of], n[of]
    order = np.argsort(slot_length, kind="stable")
    slot_length, slot_offset, slot_first, slot_n = (v[order] for v in (slot_length, slot_offset, slot_first, slot_n))
    running = np.cumsum(slot_n) - slot_n
    begins = np.searchsorted(slot_length, slot_length)
    ranks = running - running[begins] if len(running) else running
    covered = np.bincount(slot_length, slot_n, len(histogram)).astype(np.int64)
    residual = (histogram.astype(np.int64) - covered) * np.arange(len(histogram))
    residual[0] = 0
    plan = Plan(window, (slot_length << 40) | ranks, slot_first, slot_offset, covered, np.cumsum(residual) - residual, int(n.sum()), int(residual.sum()))
    plan.count = plan.sequences + plan.stream // window + len(plan.tail()[0])
    return plan


ROW_SCHEMA = "doc_id long, shard int, doc_tokens long, full_first long, full_crcs array<long>, rem int, rank long, rem_crc long, rem_ids binary"


def tokenised(docs: DataFrame, end_id: int = 1, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Per document: checksums of its full windows, and its remainder with its rank in (shard, length)."""

    def encode(batches):
        shard, full, seen, end = partition_id(), 0, np.zeros(window, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, most=ENCODE_BYTES):
                out = []
                for doc_id, ids in zip(column(part, "doc_id").to_pylist(), encoder(path)(column(part, "text"))):
                    ids += end
                    n = len(ids) // 4
                    k, rem = divmod(n, window)
                    view = memoryview(ids)
                    crcs = [zlib.crc32(view[4 * window * i : 4 * window * (i + 1)]) for i in range(k)]
                    tail = bytes(view[4 * window * k :])
                    short = np.frombuffer(tail, "<u4")
                    small = short.astype("<u2").tobytes() if not rem or short.max() < 65536 else tail
                    out.append((doc_id, shard, n, full, crcs, rem, int(seen[rem]), zlib.crc32(tail), small))
                    full += k
                    seen[rem] += 1
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "shard", "doc_tokens", "full_first", "full_crcs", "rem", "rank", "rem_crc", "rem_ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, ROW_SCHEMA)


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, end_id: int = 1, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces of every document and where they lie; see PIECE_SCHEMA.  Other columns of docs are not looked at.

    A null text is empty and holds its end id alone.  Rows that share a doc_id
    are packed as documents of their own.  An empty table gives no rows.
    """
    rows = staged(tokenised(docs, end_id, window, path), "pack")
    counts = staged(rows.groupBy("rem", "shard").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("full")), "pack-counts")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rem").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["rem"]] = r["n"]
    plan = make_plan(histogram, window)
    spread = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by the combinations, whatever the input

    ahead = Window.partitionBy("rem").orderBy("shard")
    base = counts.where("rem > 0").select("rem", "shard", (F.sum("n").over(ahead) - F.col("n")).alias("ahead"))
    shards = counts.groupBy("shard").agg(F.sum("full").alias("full"))
    shards = shards.select("shard", (F.sum("full").over(Window.orderBy("shard")) - F.col("full") + plan.count).alias("first"))

    full = rows.where(F.size("full_crcs") > 0).select("doc_id", "shard", "doc_tokens", "full_first", F.posexplode("full_crcs").alias("k", "ids_crc32"))
    full = full.join(shards, "shard").select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("full_first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    ranked = rows.where("rem > 0").join(base, ["rem", "shard"]).select("doc_id", "shard", "doc_tokens", "rem", "rank", (F.col("ahead") + F.col("rank")).alias("place"), "rem_crc")

    def assign(batches):
        plan = spread.value
        for batch in batches:
            rem = column(batch, "rem").to_numpy().astype(np.int64)
            sequence, offset, at = plan.place(rem, column(batch, "place").to_numpy())
            arrays = [column(batch, c) for c in ("doc_id", "shard", "doc_tokens", "rem", "rank", "rem_crc")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset.astype(np.int64)), pa.array(at)], ["doc_id", "shard", "doc_tokens", "rem", "rank", "rem_crc", "sequence_id", "offset", "at"])

    placed = ranked.mapInArrow(assign, "doc_id long, shard int, doc_tokens long, rem int, rank long, rem_crc long, sequence_id long, offset long, at long")
    placed = staged(placed, "pack-placed")
    whole = placed.where("offset >= 0").select("doc_id", (F.col("doc_tokens") - F.col("rem")).alias("start"), F.col("rem").cast("long").alias("length"), F.col("rem_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    rest = placed.where("offset < 0").select("shard", "rem", "rank", "at").join(rows.select("doc_id", "shard", "rem", "rank", "doc_tokens", "rem_ids"), ["shard", "rem", "rank"])

    def cut(batches):
        plan = spread.value
        tail_at, tail_n = plan.tail()
        full_until = plan.stream - plan.stream % plan.window
        for batch in batches:
            out = []
            for doc_id, rem, tokens, at, ids in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "rem", "doc_tokens", "at", "rem_ids"))):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * rem else "<u4").astype("<u4")
                done = 0
                while done < rem:
                    here = at + done
                    if here < full_until:
                        seq, begins = divmod(here, plan.window)
                        room, begins = plan.window - begins, begins
                    else:
                        k = int(np.searchsorted(tail_at, here, "right")) - 1
                        seq, begins = full_until // plan.window + k, here - int(tail_at[k])
                        room = int(tail_n[k]) - begins
                    n = min(room, rem - done)
                    out.append((doc_id, tokens - rem + done, n, zlib.crc32(ids[done : done + n].tobytes()), tokens, plan.sequences + seq, begins))
                    done += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return full.unionByName(whole).unionByName(rest.mapInArrow(cut, PIECE_SCHEMA))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
