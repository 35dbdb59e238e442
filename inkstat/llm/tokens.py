"""Token-ID output: Parquet list columns with chosen encodings, row groups and page indexes."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, column, partition_id, slices, staging_root, text_bytes, word_hashes, words

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 20
#: Ids of distinct words that a worker keeps for good, and for a while.
COMMON, RECENT = 1_400_000, 350_000
#: White space is single spaces and newlines between other characters, and one newline may end the text; every
#: character is one that all versions of Unicode tables class alike.
_PLAIN = re.compile("(?:[ \n]?[\x00-\x08\x0e-\x1b!-\x84\x86-\x9f\xa1-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3001-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]++)*+\n?").fullmatch
#: ASCII letters and digits, and whatever is not ASCII.
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True
_WORD = np.ones(256, bool)
_WORD[[10, 32]] = False
#: How byte-level BPE writes each byte: printable ones as themselves, the others in order from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}


class Encoder:
    """Ids of texts by the tokenizers library.

    Byte-level BPE never merges across the pieces that its pattern splits, and
    the pattern always splits before a space or newline that stands alone.  So
    plain texts are cut there, and of all texts given at once every distinct
    word (told apart by 64-bit hashes) is looked up once, without the signs behind
    it.  A new word of letters is one piece and goes to the library's model
    itself; other new words go to the whole library, and so does
    any text that is not plain.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        #: Known words: hashes in ascending order, where each one's ids lie in the pool, and how many they are.
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")
        self.piece = self.tokenizer.model.tokenize
        self.newline = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str, space: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.piece(space + word)]).tobytes()  # little-endian, as every platform of Spark's

    def _learn(self, new: list[tuple[str, int]]) -> list[bytes]:
        """new: a word and what stands before it (0: a space, 1: a newline, 2 and 3: nothing)."""
        out: list = [None] * len(new)
        rest = []
        for i, (word, kind) in enumerate(new):
            if word.isalpha():
                ids = self._letters(word, "" if kind else "\u0120")
                out[i] = self.newline + ids if kind == 1 else ids
            else:
                rest.append(i)
        texts = [(" ", "\n", "", "")[kind] + word for word, kind in (new[i] for i in rest)]
        for i, ids in zip(rest, self._encode(texts)):
            out[i] = ids
        return out

    def _places(self, hashes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these ascending word hashes begin in the pool, and how many they are; word(k) gives the k-th word and what stands before it."""
        if len(self.pool) > COMMON + RECENT:
            stops = self.starts + self.sizes
            stay = stops <= COMMON
            self.keys, self.starts, self.sizes = self.keys[stay], self.starts[stay], self.sizes[stay]
            self.pool = self.pool[: stops[stay].max(initial=0)].copy()
        at = np.searchsorted(self.keys, hashes)
        lacks = at == len(self.keys)
        lacks[~lacks] = self.keys[at[~lacks]] != hashes[~lacks]
        new = np.flatnonzero(lacks)
        if len(new):
            learnt = self._learn([word(k) for k in new.tolist()])
            sizes = np.array([len(v) // 4 for v in learnt], np.int64)
            places = at[new]
            self.keys = np.insert(self.keys, places, hashes[new])
            self.starts = np.insert(self.starts, places, len(self.pool) + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, places, sizes)
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(learnt), "<u4")])
            at += np.cumsum(lacks) - lacks
        return self.starts[at], self.sizes[at]

    def __call__(self, column_: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null one is empty."""
        column_ = pc.fill_null(column_, "")
        texts = column_.to_pylist()
        plain = np.array([bool(t and t[0] not in " \n" and "<|" not in t and _PLAIN(t)) for t in texts], bool)
        out: list = [None] * len(texts)
        whole = np.flatnonzero(~plain).tolist()
        for i, ids in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = ids
        chosen = np.flatnonzero(plain).tolist()
        if not chosen:
            return out
        data, offsets = text_bytes(column_ if len(chosen) == len(texts) else column_.filter(pa.array(plain)), lower=False)
        starts, ends, first = words(data, offsets, _WORD)
        kind = np.where(data[starts - 1] == 10, 1, 0)
        kind[first[:-1]] = 2
        # signs behind a word's last ASCII letter or digit are a piece of their own (kind 3)
        signed = np.int32 if len(data) < 1 << 31 else np.int64
        last = np.maximum.accumulate(np.where(_SOLID[data], np.arange(len(data), dtype=signed), signed(-1)))[ends - 1]
        split = (last >= starts) & (last < ends - 1) & (data[last] < 128)
        place = np.arange(len(starts)) + np.cumsum(split) - split
        tails = place[split] + 1
        begins, stops, kinds = (np.zeros(len(starts) + len(tails), np.int64) for _ in range(3))
        begins[place], stops[place], kinds[place] = starts, np.where(split, last + 1, ends), kind
        begins[tails], stops[tails], kinds[tails] = last[split] + 1, ends[split], 3
        first = np.append(place, len(kinds))[first]
        starts, ends, kind = begins, stops, kinds
        keys = word_hashes(data, starts, ends) + kind.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        new, at, back = np.unique(keys, return_index=True, return_inverse=True)
        del keys
        begin, size = self._places(new, lambda k: (data[starts[at[k]] : ends[at[k]]].tobytes().decode(), kind[at[k]]))
        n = size[back]
        done = np.cumsum(n)
        tokens = self.pool[np.repeat(begin[back] - (done - n), n) + np.arange(done[-1])].tobytes()
        cuts = np.append(0, done)[first] * 4
        newline = (data[offsets[1:] - 1] == 10).tolist()
        for i, a, b, more in zip(chosen, cuts[:-1].tolist(), cuts[1:].tolist(), newline):
            out[i] = tokens[a:b] + self.newline if more else tokens[a:b]
        return out


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    return Encoder(path)


SHARD_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def encode_sorted(docs: DataFrame, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Rows in ascending doc_id order (repeated ids: by text), partition after partition.

    A null text is empty and still gets its end id; a null doc_id comes first.
    shard_start counts the ids of the same partition before the row.  Batches
    to Python workers are bounded in bytes.
    """
    bound_batches(docs.sparkSession)

    def encode(batches):
        shard, at, end = partition_id(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, most=ENCODE_BYTES):
                ids = [x + end for x in encoder(path)(column(part, "text"))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(at + ends - n), pa.array(n), lists], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                at += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(encode, SHARD_SCHEMA)


def write_tokens(rows: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 2000, page_bytes: int = 256 << 10) -> None:
    """One file a partition; the writer adds column and offset indexes to every file.

    encoding: "dictionary", or "delta" for DELTA_BINARY_PACKED ids.
    """
    rows.write.options(
        **{
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
            "parquet.page.row.count.limit": str(page_rows),
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "shard", "shard_start", "n_tokens", "ids"), doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """Selected columns; doc_ids (first, last) reaches the row-group and page indexes as a filter."""
    rows = spark.read.schema(SHARD_SCHEMA).parquet(path)
    if doc_ids:
        rows = rows.where(F.col("doc_id").between(*doc_ids))
    return rows.select(*columns)


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds start, the ids of all rows before; the window runs over one row a file."""
    sums = read_tokens(spark, path, ("shard", "n_tokens")).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(base, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, shard, shard_start, and of the ids read back: n_tokens and ids_crc32."""

    def crc(batches):
        for batch in batches:
            lists = column(batch, "ids")
            offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
            data = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "shard"), column(batch, "shard_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{staging_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(encode_sorted(spark.read.parquet(f"{sf_dir}/documents.parquet")), path)
    rows = with_starts(spark, path, digest(read_tokens(spark, path)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
