"""Scores that outside models computed: perplexity, curvature, verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config.rules import Rules
from ..functions.text import strip
from . import verdicts


def as_rows(table: DataFrame, tool: str) -> DataFrame:
    """A verdict table as ensemble rows; its signals stay if it has any."""
    signals = F.col("signals") if "signals" in table.columns else F.array().cast("array<string>")
    return table.select("doc_id", F.lit(tool).alias("tool"), "classification", "confidence", signals.alias("signals"))


def model_verdicts(table: DataFrame, tool: str) -> DataFrame:
    """A model's verdicts as ensemble rows: confidence between 0.3 and 0.95; without a verdict, an error."""
    known = F.col("classification").isin(verdicts.AI, verdicts.HUMAN, verdicts.UNSURE)
    sure = F.when(known, F.least(F.lit(0.95), F.greatest(F.lit(0.3), F.coalesce("confidence", F.lit(0.5))))).otherwise(0.0)
    return as_rows(table.withColumn("confidence", sure).withColumn("classification", F.when(known, F.col("classification")).otherwise(verdicts.ERROR)), tool)


def naive_sentences(text) -> Column:
    """Parts between `.`, `!` and `?` that hold three words or more: what a model scores one by one."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: F.size(F.split(s, r"\s+")) >= 3)


def perplexity_measures(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """documents: doc_id, perplexity (null: too short to score); sentences: doc_id, perplexity.

    Mean, population deviation, least, most and their variation (cv; flat below
    0.2) over a document's sentences; without any, its own perplexity, flat.
    Sample deviation and variation in percent are the burstiness pair.
    """
    found = sentences.groupBy("doc_id").agg(
        F.count("perplexity").alias("scored"), F.avg("perplexity").alias("m"), F.stddev_pop("perplexity").alias("s"), F.min("perplexity").alias("lo"), F.max("perplexity").alias("hi"), F.stddev_samp("perplexity").alias("burstiness"),
    )
    own = F.col("perplexity")
    rows = documents.join(found, "doc_id", "left").select(
        "doc_id", "perplexity", F.coalesce("scored", F.lit(0)).alias("scored"), F.coalesce("m", own).alias("mean"), F.coalesce("s", F.lit(0.0)).alias("deviation"), F.coalesce("lo", own).alias("least"), F.coalesce("hi", own).alias("most"), "burstiness",
    )
    cv = F.when(F.col("mean") > 0, F.col("deviation") / F.col("mean")).otherwise(0.0)
    return rows.select("*", cv.alias("cv"), (cv < 0.2).alias("flat"), F.when(F.col("mean") > 0, F.col("burstiness") * 100.0 / F.col("mean")).alias("burstiness_cv"))


def perplexity_verdict(measures: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """measures with classification and confidence; error where there is no perplexity."""
    p, cv = F.col("perplexity"), F.col("cv")
    low = rules.flags("perplexity", "perplexity", p, auto_off=False)
    classification, confidence = verdicts.cases(
        (p.isNull(), verdicts.ERROR, 0.0),
        (low & (F.col("flat") | (F.col("mean") < 15)), verdicts.AI, F.when(p < 10, 0.9).when(p < 15, 0.75).otherwise(0.6)),
        ((p > 50) & (cv > 0.3), verdicts.HUMAN, F.when(p > 85, 0.9).when(p > 70, 0.75).otherwise(0.6)),
        (None, verdicts.UNSURE, 0.5),
    )
    return measures.withColumn("classification", classification).withColumn("confidence", confidence)


def curvature(scores: DataFrame) -> DataFrame:
    """scores: doc_id, log_prob, perturbed (array of log probabilities).  d_score: how many deviations the text lies above its perturbations."""
    n = F.size("perturbed").cast("double")
    add = lambda a, x: a + x
    mean = F.try_divide(F.aggregate("perturbed", F.lit(0.0), add), n)
    rows = scores.select("doc_id", "log_prob", "perturbed", mean.alias("mean"))
    square = F.try_divide(F.aggregate(F.transform("perturbed", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), add), n)
    return rows.select("doc_id", F.try_divide(F.col("log_prob") - F.col("mean"), F.sqrt(square)).alias("d_score"))
