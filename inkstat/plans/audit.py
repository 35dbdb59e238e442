"""Incremental audits and the ledger of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, modified_at, ...) that the cache has not, or not with this time."""
    return files.join(cache.select("path", "modified_at"), ["path", "modified_at"], "left_anti")


def refreshed(files: DataFrame, cache: DataFrame, scored: DataFrame) -> DataFrame:
    """The new cache: rows of files that still exist, with fresh scores where they changed."""
    kept = cache.join(files.select("path", "modified_at"), ["path", "modified_at"], "left_semi")
    return kept.unionByName(scored)


def report(cache: DataFrame, threshold: float = 30.0) -> DataFrame:
    """path, score, status, highest score first."""
    status = F.when(F.col("score") > threshold / 100, "NEEDS WORK").otherwise("OK")
    return cache.select("path", "score", status.alias("status")).orderBy(F.desc("score"), "path")


def rounds(ledger: DataFrame) -> DataFrame:
    """session, round, score, delta to the round before, success: human with confidence over 80 or a score below 0.26."""
    before = F.lag("score").over(Window.partitionBy("session").orderBy("round"))
    success = (F.col("classification") == "likely_human") & ((F.col("confidence") > 80) | (F.col("score") < 0.26))
    return ledger.select("session", "round", "score", (F.col("score") - before).alias("delta"), success.alias("success"))


def next_round(ledger: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot's rows with their session's next round number."""
    last = ledger.groupBy("session").agg(F.max("round").alias("last"))
    return snapshot.join(last, "session", "left").withColumn("round", F.coalesce("last", F.lit(0)) + 1).drop("last")
