"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstat.llm import decontaminate, language_id, packing, quality, simhash
from inkstat.llm.common import bound_batches, discard, set_aside, staged, staged_since
from inkstat.llm.lm_score import remainder


def _bounded(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 5) != 0)
    return quality.scored(docs, model, least=quality.THRESHOLD)


@_bounded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; those without letters go."""
    marked = language_id.identify(set_aside(docs, "text"), *language_id.fit(docs, remainder("doc_id", 3) != 1))
    return marked.where(F.col("lang_pred") != language_id.UNKNOWN).drop("lang_pred", "score", "bits").toDF(*docs.columns)


@_bounded
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


@_bounded
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_bounded
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and the sequences they lie in."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("dedup", dedup_stage), ("decontaminate", decontaminate_stage), ("packing", packing_stage)]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage staged on the way goes once its result is written, and so does its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = len(staged_since())
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *(path for path in staged_since(before) if path != docs.staged_at))
    return STAGES[-1][1](spark, docs, sf_dir)
