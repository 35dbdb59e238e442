"""A Python worker gives back what it freed, batch by batch; batches are bounded in bytes."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from conftest import ROOT

import corpus_pipeline
from inkstat.llm import common, tokens

#: Arrays below malloc's limit for mappings of their own, with a small one kept on top of them: the heap cannot shrink by itself.
PROGRAM = """
import numpy as np, pyarrow as pa
from inkstat.llm.common import slices

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

batch = pa.RecordBatch.from_arrays([pa.array(["word " * 1000] * 1000)], ["text"])
before, kept, parts = resident(), [], []
for part in slices(batch):
    parts.append(part.num_rows)
    held = [np.ones(8000) for _ in range(2000)]
    kept.append(np.ones(8000))
    peak, held = resident(), None
print(sum(parts), len(parts), peak - before, resident() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_goes_back():
    rows, parts, peak, after = map(int, subprocess.run([sys.executable, "-c", PROGRAM], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())
    assert rows == 1000 and parts > 1 and peak > 100
    assert after < 30


def test_batches_are_bounded_in_bytes(spark, tmp_path):
    def sizes(batches):
        for batch in batches:
            lengths = [len(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([len(lengths)]), pa.array([sum(lengths[:-1])])], ["n", "size"])

    rows = spark.range(0, 801, 1, 1).selectExpr("id AS doc_id", "IF(id = 800, repeat('word ', 4000000), repeat('word ', 10000)) AS text", "'en' AS lang", "'s' AS source", "5L AS n_chars")
    try:
        for bound in (None, 1 << 20):
            spark.conf.unset(common._BATCH) if bound is None else spark.conf.set(common._BATCH, str(bound))
            corpus_pipeline.language_stage(spark, rows.limit(3), str(tmp_path))
            seen = rows.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in seen) == 801 and all(r["size"] < (bound or common.BATCH_BYTES) for r in seen)  # before the last row
    finally:
        spark.conf.unset(common._BATCH)


#: 300,000 distinct words of eight letters, of about four ids each.
WORDS = """
import numpy as np, pyarrow as pa
from inkstat.llm import tokens
from inkstat.llm.common import slices

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

letters = np.random.default_rng(1).integers(97, 123, (300, 1000, 9), np.uint8)
letters[:, :, 8] = 32
letters[:, -1, 8] = 46
texts = [bytes(x.ravel()).decode() for x in letters]
encode = tokens.Encoder()
encode(pa.array(["a few words"]))
before = resident()
batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
n = sum(len(x) // 4 for part in slices(batch, most=tokens.ENCODE_BYTES) for x in encode(part.column(0)))
del batch
print(n, resident() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_known_words_take_little_memory():
    n, grown = map(int, subprocess.run([sys.executable, "-c", WORDS], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())
    assert n > 900_000 and grown < 32


def test_known_words_are_bounded_in_ids(monkeypatch):
    """Words are forgotten and learnt again, and one that is longer than the bounds is not kept for good."""
    monkeypatch.setattr(tokens, "COMMON", 300)
    monkeypatch.setattr(tokens, "RECENT", 100)
    dice = random.Random(1)
    encode = tokens.Encoder()
    vocabulary = ["".join(dice.choices("abcdeé1.-", k=dice.randint(1, 9))) for _ in range(400)]
    for turn in range(60):
        texts = ["x" + "".join(dice.choices("abcde", k=5000)) * (turn % 20 == 0), *(dice.choice(" \n").join(dice.choices(vocabulary, k=20)) for _ in range(2))]
        known = len(encode.pool)
        got = encode(pa.array(texts))
        assert got == [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(encode.pool) <= min(known, 400) + sum(map(len, got)) // 4
        assert len(encode.keys) == len(encode.starts) == len(encode.sizes) and (np.diff(encode.keys) > 0).all()
    assert 0 < (encode.starts + encode.sizes <= 300).sum() < len(encode.keys)


def test_batches_to_the_encoder_are_bounded(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'a text' AS text")
    try:
        for given, held in ((None, common.BATCH_BYTES), (1 << 20, 1 << 20)):
            spark.conf.unset(common._BATCH) if given is None else spark.conf.set(common._BATCH, str(given))
            assert tokens.encode_sorted(docs).count() == 3
            assert int(spark.conf.get(common._BATCH)) == held
    finally:
        spark.conf.unset(common._BATCH)
