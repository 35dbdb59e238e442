"""Shared pieces: staging tables, byte views of text columns, vectorised words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once by a Python worker.
SLICE_BYTES = 1 << 20
#: Bytes at which a batch of rows goes to a Python worker; the row that reaches them still belongs to it.  Spark's own bound is 10,000 rows or 64 MB.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def staging_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="inkstat-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def bound_batches(spark: SparkSession) -> None:
    """Bounds batches to Python workers in bytes for the session, unless it has a bound of its own: each is held by the executor and by the worker."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Folders that `staged` wrote and nobody discarded yet, in order.
_MADE: list[str] = []


def staged(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again; this cuts its lineage."""
    path = f"{staging_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _MADE.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = table if isinstance(table, str) else table.staged_at
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _MADE:
            _MADE.remove(path)


def staged_since(before: int = 0) -> list[str]:
    """What was staged after the first `before` tables that are there; staged_since() counts them."""
    return _MADE[before:]


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with every column but the used ones renamed by place, so that no name clashes; toDF(*docs.columns) undoes it."""
    return docs.toDF(*(c if c in used else f"__in_{i}" for i, c in enumerate(docs.columns)))


def put_back(rows: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """Undoes set_aside on rows that carry `added` behind the columns of docs; columns of docs that have such a name give way."""
    out = rows.toDF(*(f"__in_{i}" for i in range(len(docs.columns))), *added)
    taken = {a.lower() for a in added}
    return out.select(*(out[f"__in_{i}"].alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken), *added)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, TypeError, AttributeError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Freed memory goes back to the system: a reused Python worker would hold on to its peak from stage to stage, used or idle."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES):
    """Runs of rows whose texts together hold about `most` bytes; one longer text stands alone.

    After the last one, memory that was freed on the way is given back.
    """
    lengths = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(lengths, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def text_bytes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), A-Z lower-cased, and where each begins."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return (_LOWER[raw] if lower else raw), offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of this kind within each text, and each text's first word."""
    inside = kind[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    filled = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[filled[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time; ranges of one length up to eight never collide."""
    view = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))
    left = ends - starts
    out = left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at, rows = starts, None
    while len(at):
        h = out if rows is None else out[rows]
        h = (h ^ (view[at] & _FIRST_BYTES[np.minimum(left, 8)])) * _MIX
        h ^= h >> np.uint64(32)
        if rows is None:
            out = h
        else:
            out[rows] = h
        more = np.flatnonzero(left > 8)
        at, left = at[more] + 8, left[more] - 8
        rows = more if rows is None else rows[more]
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
