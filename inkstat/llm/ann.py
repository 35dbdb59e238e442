"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is scaled to length one, turned by one random rotation, and kept as
the signs of its coordinates, packed into bytes, with two correction scalars:
its length and the inner product of the unit vector with its code.  From the
packed bits and the scalars comes an unbiased estimate of an inner product whose
error has a known spread; only vectors whose estimate plus `spread` times that
error reaches a query's k-th best are reranked by their exact inner product.
Codes are written once and scanned for a stated query set, in blocks of queries.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, partition_id, staged

#: Queries of one pass; a block is broadcast.
BLOCK = 4096
#: Vector components that are held as doubles at once.
VALUES = 1 << 21
_NO_ID = np.iinfo(np.int64).max


@lru_cache(maxsize=64)
def _signs(dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed + dim).choice([-1.0, 1.0], (3, dim))


def turned(unit: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two and rotated: three rounds of random signs and a Hadamard transform."""
    n, width = unit.shape
    dim = 1 << max(width - 1, 0).bit_length()
    out = np.pad(unit, ((0, 0), (0, dim - width)))
    for signs in _signs(dim):
        out = out * signs
        half = 1
        while half < dim:
            pairs = out.reshape(n, -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, dim)
            half *= 2
        out /= np.sqrt(dim)
    return out


class Codes:
    """One-bit codes of vectors of one width: packed bits, one row a byte, and the two scalars."""

    def __init__(self, packed: np.ndarray, length: np.ndarray, fit: np.ndarray):
        self.packed, self.length, self.fit = packed, length, fit

    @classmethod
    def of(cls, vectors: np.ndarray) -> Codes:
        top = np.abs(vectors).max(axis=1)  # scaled first: squares of finite components may overflow
        unit = vectors / top[:, None]
        size = np.linalg.norm(unit, axis=1)
        rows = turned(unit / size[:, None])
        return cls(np.ascontiguousarray(np.packbits(rows > 0, axis=1, bitorder="little").T), size * top, np.abs(rows).sum(axis=1) / np.sqrt(rows.shape[1]))

    def estimate(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the inner products with one turned query: estimates, and the spread of their errors."""
        dim = len(query)
        padded = np.pad(query, (0, -dim % 8)).reshape(-1, 8)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        tables = padded @ (2 * bits.T - 1.0)  # per byte of the code, the sum for each of its values
        total = tables[0][self.packed[0]]
        for table, code in zip(tables[1:], self.packed[1:]):
            total = total + table[code]
        size = np.linalg.norm(query)
        return total / np.sqrt(dim) * (self.length / self.fit), size * self.length * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(dim - 1, 1))


def _by_width(batch: pa.RecordBatch):
    """Parts of a batch that hold vectors of one width, at most VALUES components each, with those as a matrix."""
    values = column(batch, "v")
    widths = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        step = max(1, VALUES // width)
        for a in range(0, len(rows), step):
            part = batch.take(pa.array(rows[a : a + step]))
            yield part, column(part, "v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def encoded(table: DataFrame) -> DataFrame:
    """row, vec_id, v, code, length, fit: the usable rows of (vec_id, embedding), numbered and coded, written once.

    Not usable: null, empty and zero vectors and those with a null or non-finite
    component.  Every row counts by itself, whether its vec_id is null or not
    the only one.
    """
    kind = table.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v")).where(F.coalesce(good, F.lit(False)))

    def run(batches):
        at = partition_id() << 40
        for batch in batches:
            for part, v in _by_width(batch):
                codes = Codes.of(v)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(codes.packed)), len(v), [None, pa.py_buffer(np.ascontiguousarray(codes.packed.T))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(v))), column(part, "vec_id"), column(part, "v"), packed, pa.array(codes.length), pa.array(codes.fit)], ["row", "vec_id", "v", "code", "length", "fit"])
                at += len(v)

    return staged(rows.mapInArrow(run, f"row long, vec_id long, v {kind}, code binary, length double, fit double"), "ann-codes")


class _Block:
    """Queries of one pass by width: row numbers, vec_ids, vectors and turned vectors."""

    def __init__(self, table: pa.Table):
        self.by_width = {}
        for batch in table.combine_chunks().to_batches():
            for part, v in _by_width(batch):
                own = (column(part, "row").to_numpy(), column(part, "vec_id").to_numpy(), v, turned(v))
                old = self.by_width.get(v.shape[1])
                self.by_width[v.shape[1]] = own if old is None else tuple(np.concatenate(x) for x in zip(old, own))


def search(table: DataFrame, chosen: Column, k: int = 20, spread: float = 3.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: each query's k best other rows, nearest first, ties to the smaller vec_id (null last).

    table: vec_id, embedding; chosen: a condition on vec_id, null for a null one, that names
    the queries.  Rows are told apart by a number of their own: of rows that share a
    vec_id each is a query and a candidate of the others.  Vectors are compared with
    those of their own width, the only ones with which they have an inner product.
    """
    spark = table.sparkSession
    vectors = encoded(table)
    queries = vectors.where(chosen)
    passes = max(1, -(-queries.count() // block))
    parts = []
    for p in range(passes):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).select("row", "vec_id", "v")
        asked = spark.sparkContext.broadcast(_Block(own.toArrow()))  # about `block` rows

        def run(batches, asked=asked):
            best: dict = {}
            for batch in batches:
                for part, v in _by_width(batch):
                    if v.shape[1] not in asked.value.by_width:
                        continue
                    rows_q, _, q, spun = asked.value.by_width[v.shape[1]]
                    rows, nameless = column(part, "row").to_numpy(), column(part, "vec_id").is_null().to_numpy(zero_copy_only=False)
                    ids = column(part, "vec_id").fill_null(_NO_ID).to_numpy()
                    packed = np.frombuffer(b"".join(column(part, "code").to_pylist()), np.uint8).reshape(len(v), -1).T
                    codes = Codes(np.ascontiguousarray(packed), column(part, "length").to_numpy(), column(part, "fit").to_numpy())
                    for i in range(len(q)):
                        guess, error = codes.estimate(spun[i])
                        other = rows != rows_q[i]
                        held = best.get((v.shape[1], i))
                        bound = held[0][-1] if held is not None and len(held[0]) == k else -np.inf
                        if bound == -np.inf and len(v) > 4 * k:
                            first = np.argpartition(-guess, 2 * k)[: 2 * k]
                            exact = np.sort(v[first[other[first]]] @ q[i])[::-1]
                            bound = exact[k - 1]
                        left = np.flatnonzero((guess + spread * error >= bound) & other)
                        if len(left):
                            found = (np.einsum("ij,j->i", v[left], q[i]), nameless[left], ids[left], rows[left])
                            found = found if held is None else tuple(np.concatenate(x) for x in zip(held, found))
                            order = np.lexsort((*found[3:0:-1], -found[0]))[:k]
                            best[v.shape[1], i] = tuple(x[order] for x in found)
            for (width, i), (scores, nameless, ids, _) in best.items():
                rows_q, ids_q, _, _ = asked.value.by_width[width]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), rows_q[i])), pa.array(np.full(len(ids), ids_q[i])), pa.array(ids, mask=nameless), pa.array(scores)], ["query_row", "query_id", "vec_id", "score"]
                )

        parts.append(vectors.mapInArrow(run, "query_row long, query_id long, vec_id long, score double"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


def op2_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0).drop("query_row")
