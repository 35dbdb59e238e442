"""Quality classifier: a generalised additive model with pairwise interactions.

Sixteen shape features of the whole text are cut into bins.  Cyclic boosting
adds a shallow tree on one feature after another to that feature's lookup table;
the pairs of features with the largest remaining gain then get tables of their
own, boosted alike.  A score is the sum of table entries, one per feature and
pair, through the logistic function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import NOT_SPACE, column, put_back, set_aside, slices, text_bytes, word_hashes, words
from .lm_score import remainder

#: Labelled documents that the model is fitted on, about (chosen by a hash of the id).
SAMPLE = 12_000
THRESHOLD = 0.3
FEATURES = ["log_bytes", "log_words", "upper", "digit", "space", "newline", "pipe", "bang", "noise", "stop", "other", "word_bytes", "repeated", "distinct", "short", "high"]

_LOWER, _UPPER, _DIGIT, _SPACE, _NEWLINE, _PIPE, _BANG, _NOISE, _STOP, _OTHER, _HIGH = range(11)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
for _chars, _kind in ((b" \t\r\x0b\x0c", _SPACE), (b"\n", _NEWLINE), (b"|", _PIPE), (b"!", _BANG), (b"#$%&*@^~+=<>\\{}[]_", _NOISE), (b".,", _STOP)):
    _KIND[list(_chars)] = _kind


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text; a null or empty text has zeros."""
    data, offsets = text_bytes(texts, lower=False)
    n, lens = len(texts), np.diff(offsets)
    doc = np.repeat(np.arange(n), lens)
    kinds = np.bincount(doc * 11 + _KIND[data], minlength=11 * n).reshape(n, 11).astype(float)
    starts, ends, first = words(data, offsets, NOT_SPACE)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    h = word_hashes(data, starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    mixed = np.sort(((h >> np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(40))) if n < 1 << 24 else h)
    new = np.concatenate([[True], mixed[1:] != mixed[:-1]]) if len(mixed) else np.zeros(0, bool)
    distinct = np.bincount((mixed[new] >> np.uint64(40)).astype(np.int64), minlength=n)[:n]
    size, w = np.maximum(lens, 1), np.maximum(count, 1)
    letters = np.maximum(kinds[:, _LOWER] + kinds[:, _UPPER], 1)
    return np.stack(
        [
            np.log1p(lens),
            np.log1p(count),
            kinds[:, _UPPER] / letters,
            kinds[:, _DIGIT] / size,
            kinds[:, _SPACE] / size,
            kinds[:, _NEWLINE] / w,
            kinds[:, _PIPE] / w,
            kinds[:, _BANG] / w,
            kinds[:, _NOISE] / w,
            kinds[:, _STOP] / w,
            kinds[:, _OTHER] / w,
            np.bincount(owner, ends - starts, n) / w,
            np.bincount(owner, again, n) / w,
            distinct / w,
            np.bincount(owner, ends - starts <= 3, n) / w,
            kinds[:, _HIGH] / size,
        ],
        axis=1,
    )


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    mains: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    fold: int = 4  # bins of a main table in one of a pair's

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, table in enumerate(self.mains):
            out += table[bins[:, k]]
        for a, b, table in self.pairs:
            out += table[bins[:, a] // self.fold, bins[:, b] // self.fold]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.bins(x))))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> int:
    """Where to split bins in two; 0: nowhere."""
    left, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left**2 / (hl + ridge) + (g.sum() - left) ** 2 / (h.sum() - hl + ridge)
    return int(np.argmax(gain)) + 1 if len(gain) and gain.max() > g.sum() ** 2 / (h.sum() + ridge) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree of depth two."""
    out = np.zeros(len(g))
    first = _cut(g, h, ridge)
    for a, b in ((0, first), (first, len(g))) if first else ((0, len(g)),):
        second = _cut(g[a:b], h[a:b], ridge) if first else 0
        for c, d in ((a, a + second), (a + second, b)) if second else ((a, b),):
            out[c:d] = g[c:d].sum() / (h[c:d].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four."""
    cg, ch = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (g, h))
    a, b = np.meshgrid(np.arange(1, len(g)), np.arange(1, g.shape[1]), indexing="ij")

    def four(c):
        ul = c[a, b]
        return ul, c[a, -1] - ul, c[-1, b] - ul, c[-1, -1] - c[a, -1] - c[-1, b] + ul

    parts = list(zip(four(cg), four(ch)))
    gain = sum(x**2 / (y + ridge) for x, y in parts)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    i, j = at[0] + 1, at[1] + 1
    values = [x[at] / (y[at] + ridge) for x, y in parts]
    table = np.empty_like(g)
    table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = values
    return float(gain[at]), table


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, ridge: float = 2.0) -> Gam:
    """No rows: a score of one half; labels all alike: a score near that label."""
    positive = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(positive / (1 - positive))), [], [])
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    model.mains = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    f = np.full(len(y), model.base)

    def slope():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.mains):
            g, h = slope()
            step = rate * _tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)), ridge)
            table += step
            f += step[b[:, k]]
    half = b // model.fold
    sides = [(len(t) - 1) // model.fold + 1 for t in model.mains]

    def grid(i, j, v):
        return np.bincount(half[:, i] * sides[j] + half[:, j], v, sides[i] * sides[j]).reshape(sides[i], sides[j])

    g, h = slope()
    some = [(i, j) for i in range(len(sides)) for j in range(i) if sides[i] > 1 and sides[j] > 1]
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i, j in some), reverse=True)
    model.pairs = [(i, j, np.zeros((sides[i], sides[j]))) for _, i, j in gains[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slope()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h), ridge)[1]
            table += step
            f += step[half[:, i], half[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE) -> Gam:
    """labels: doc_id, quality (0 or 1); rows with a null in either are left out, of repeated ids the lower label counts.

    train: a boolean column over labels that chooses what is learnt from.
    """
    rows = labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    n = rows.count()
    share = min(1.0, sample / max(n, 1))
    rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.min("quality") > 0).alias("__label"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(rows), "__id")  # about `sample` rows

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = features(column(part, "text"))
                yield pa.RecordBatch.from_arrays([column(part, "__id"), column(part, "__label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "label", "x"])

    table = chosen.mapInArrow(run, "id long, label boolean, x array<double>").toArrow().sort_by("id")
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_gam(x, table.column("label").to_numpy(zero_copy_only=False).astype(float))


def scored(docs: DataFrame, model: Gam, threshold: float = THRESHOLD, least: float | None = None) -> DataFrame:
    """docs plus score and predicted; with `least`, only rows whose score reaches it, without the two columns.

    Rows are scored one by one, whatever their ids; a null text scores as an empty one.
    Columns of docs called score or predicted give way to the new ones, or stay with `least`.
    """
    given, docs = docs, set_aside(docs, "text")
    names = [f.name for f in docs.schema.fields]
    extra = [] if least is not None else [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    spread = docs.sparkSession.sparkContext.broadcast(model)  # bins and pairs are fixed in number

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                score = spread.value.score(features(column(part, "text")))
                if least is not None:
                    yield part.filter(pa.array(score >= least)).select(names)
                else:
                    yield pa.RecordBatch.from_arrays([*(column(part, c) for c in names), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    rows = docs.mapInArrow(run, StructType([*docs.schema.fields, *extra]))
    return put_back(rows, given, "score", "predicted") if least is None else rows.toDF(*given.columns)


def op8_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder("doc_id", 5) == 0
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
