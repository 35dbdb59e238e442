"""Structured Streaming: documents scored as they arrive, events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble, verdicts


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long"):
    """Scores Parquet documents that arrive below source and appends verdicts to target; a batch that runs twice is written once."""

    def batch(docs: DataFrame, number: int) -> None:
        ensemble.fast(verdicts.tool_rows(docs, ("vocabulary", "punctuation", "structure"))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows; works on streams and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    rows = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
