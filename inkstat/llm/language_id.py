"""Language identification by exact code lengths of per-language byte tries (PPM)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, put_back, set_aside, slices, text_bytes
from .lm_score import remainder
from .ppm import Model, gram_keys, suffix_orders

ORDER = 4
#: Bytes of labelled text that a language's trie is fitted on, about (whole documents, chosen by a hash of the id).
SAMPLE = 2 << 20
UNKNOWN = "und"
#: Letters, as far as bytes tell; everything else becomes a space.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def fit(docs: DataFrame, train, order: int = ORDER, sample: int = SAMPLE) -> tuple[list[str], list[Model]]:
    """The learnt languages in order, and a frozen trie of each.

    train chooses rows; those without text or lang are left out.  A language's trie
    holds its own keys alone, so that many languages cost as much as their samples.
    """
    rows = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}  # a row a language
    if not sizes:
        return [], []
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sizes.items()), F.lit(0.0))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                own = np.array(column(part, "lang").to_pylist(), object)
                for lang in set(own.tolist()):
                    data, offsets = text_bytes(column(part.filter(pa.array(own == lang)), "text"))
                    keys, n = np.unique(gram_keys(_LETTERS[data], offsets, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    table = chosen.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()  # bounded by the samples
    names, key, n = table.column("lang").combine_chunks().dictionary_encode(), table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    own = names.indices.to_numpy()
    models = {}
    for i, lang in enumerate(names.dictionary.to_pylist()):
        orders = [suffix_orders(key[own == i], n[own == i][:, None].astype(float))]
        for j in range(order - 1, -1, -1):
            orders.insert(0, suffix_orders(orders[0][0] & np.uint64((1 << 8 * (j + 1)) - 1), orders[0][1]))
        models[lang] = Model(orders)
    langs = sorted(models)
    return langs, [models[lang] for lang in langs]


def code_lengths(data: np.ndarray, offsets: np.ndarray, models: list[Model]) -> np.ndarray:
    """Natural logarithm of each text's probability under each model; distinct keys are looked up once."""
    keys, first = gram_keys(data, offsets, models[0].order)
    back, distinct = pd.factorize(keys)
    return np.stack([np.add.reduceat(m.logs(distinct)[:, 0].astype(np.float64)[back], first) for m in models], 1)


def identify(docs: DataFrame, langs: list[str], models: list[Model]) -> DataFrame:
    """docs plus lang_pred, score (its share of the languages' likelihoods per sixteenth byte) and bits (its code length).

    No text, no letter or no learnt language: `und`, score 0, bits null.  Ties go
    to the language first in order.  Rows are told one by one, whatever their
    ids.  Columns of docs that have one of the three names give way.
    """
    spread = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the samples
    given, docs = docs, set_aside(docs, "text")
    names = [f.name for f in docs.schema.fields]

    def run(batches):
        models = spread.value
        for batch in batches:
            for part in slices(batch):
                texts = column(part, "text")
                data, offsets = text_bytes(texts)
                letters = _LETTERS[data]
                plain = np.concatenate([[0], np.cumsum((letters >= 97) & (letters < 123))])
                known = plain[offsets[1:]] > plain[offsets[:-1]]
                for i in np.flatnonzero(~known & (np.diff(offsets) > 0)).tolist():
                    known[i] = any(c.isalpha() for c in texts[i].as_py())
                if langs:
                    logs = code_lengths(letters, offsets, models)
                    best = np.argmax(logs, axis=1)
                    scaled = (logs - logs.max(axis=1, keepdims=True)) / np.maximum(1, np.diff(offsets) / 16)[:, None]
                    share = np.exp(scaled)
                    score = np.where(known, 1 / share.sum(axis=1), 0.0)
                    bits = -logs[np.arange(len(best)), best] / np.log(2)
                else:
                    known[:] = False
                    best, score, bits = np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part))
                pred = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in names), pa.array(pred, pa.string()), pa.array(score), pa.array(bits, mask=~known)], [*names, "lang_pred", "score", "bits"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())])
    return put_back(docs.mapInArrow(run, schema), given, "lang_pred", "score", "bits")


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder("doc_id", 3) == 1
    rows = identify(docs.select("doc_id", "text"), *fit(docs, ~held_out)).drop("text")
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")
