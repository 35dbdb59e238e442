"""Weighted ensembles over rows of (doc_id, tool, classification, confidence, signals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the full and of the fast ensemble.
FULL = {"binoculars": 0.20, "fast_detectgpt": 0.15, "vocabulary": 0.15, "burstiness": 0.12, "ngram": 0.10, "syntactic": 0.10, "content": 0.08, "punctuation": 0.05, "structure": 0.05}
FAST = {"vocabulary": 0.40, "punctuation": 0.16, "structure": 0.44}
OTHER = 0.05


def weight(weights: dict[str, float]) -> Column:
    out = F.lit(OTHER)
    for tool, w in weights.items():
        out = F.when(F.col("tool") == tool, w).otherwise(out)
    return out


def full_score() -> Column:
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))))
    return F.when(F.col("classification") == "likely_ai", 0.5 + 0.4 * sure).when(F.col("classification") == "likely_human", 0.5 - 0.4 * sure).otherwise(0.5)


def fast_score(compat: bool = True) -> Column:
    """Buckets by confidence.  compat: `uncertain` holds the letters ai and counts as a machine's, as users of that scale expect."""
    name = F.col("classification")
    ai = F.contains(name, F.lit("ai")) if compat else name == "likely_ai"
    bucket = lambda a, b, c: F.when(F.col("confidence") >= 0.8, a).when(F.col("confidence") >= 0.6, b).otherwise(c)
    return F.when(ai, bucket(0.9, 0.75, 0.6)).when(F.contains(name, F.lit("human")), bucket(0.1, 0.25, 0.4)).otherwise(0.5)


def combine(rows: DataFrame, weights: dict[str, float], score: Column, high: float, low: float, very_high: float, very_low: float, sure: tuple[float, float], top: int, ai: Column | None = None) -> DataFrame:
    """One row a document: score, classification, confidence, numbers of tools and the top signals.

    Tools in error don't count and the other weights are scaled up; with none
    left the score is a half.  Signals are ordered by weight, then tool and
    place; of equal texts the first stays.
    """
    ok = F.col("classification") != "error"
    ai = F.col("classification") == "likely_ai" if ai is None else ai
    rows = rows.select("*", F.when(ok, weight(weights)).otherwise(0.0).alias("w"), F.when(ok, score).otherwise(0.5).alias("s"))
    order = F.create_map(*(F.lit(x) for i, t in enumerate(weights) for x in (t, i)))
    signals = F.transform("signals", lambda x, i: F.struct((-F.col("w")).alias("w"), F.coalesce(F.try_element_at(order, F.col("tool")), F.lit(len(weights))).alias("o"), i.alias("i"), x.alias("x")))
    found = rows.groupBy("doc_id").agg(
        F.sum(F.col("s") * F.col("w")).alias("sum"), F.sum("w").alias("all"), F.count_if(ok & ai).alias("ai_tools"),
        F.count_if(ok & (F.col("classification") == "likely_human")).alias("human_tools"), F.count_if(ok).alias("tools"), F.sort_array(F.flatten(F.collect_list(F.when(ok, signals)))).alias("signals"),
    )
    value = F.when(F.col("all") > 0, F.col("sum") / F.col("all")).otherwise(0.5)
    found = found.withColumn("score", value)
    s = F.col("score")
    classification = F.when(s > high, "likely_ai").when(s < low, "likely_human").otherwise("uncertain")
    confidence = F.when(s > high, F.when(s > very_high, sure[1]).otherwise(sure[0])).when(s < low, F.when(s < very_low, sure[1]).otherwise(sure[0])).otherwise(0.5)
    return found.select("doc_id", F.round("score", 6).alias("score"), classification.alias("classification"), confidence.alias("confidence"), "ai_tools", "human_tools", "tools", F.slice(F.array_distinct(F.transform("signals", lambda x: x["x"])), 1, top).alias("top_signals"))


def full(rows: DataFrame) -> DataFrame:
    return combine(rows, FULL, full_score(), 0.7, 0.3, 0.85, 0.15, (0.75, 0.95), 10)


def fast(rows: DataFrame, compat: bool = True) -> DataFrame:
    ai = F.contains("classification", F.lit("ai")) if compat else None
    return combine(rows, FAST, fast_score(compat), 0.65, 0.35, 0.80, 0.20, (0.65, 0.85), 5, ai)


def only(rows: DataFrame, verdict: str) -> DataFrame:
    """Rows to show: those with this verdict; scores are not touched."""
    return rows.where(F.col("classification") == verdict)


def top_per_class(rows: DataFrame, n: int) -> DataFrame:
    """The n highest scores of each classification, ties to the smaller id."""
    order = Window.partitionBy("classification").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
