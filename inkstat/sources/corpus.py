"""Where documents come from and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "mdx", "txt", "markdown", "rst", "adoc", "tex")


def text_files(spark: SparkSession, root: str, pattern: str = "*", ignore: str | None = None) -> DataFrame:
    """path, modified_at, text (trimmed): one row a file with a known extension; ignore: a pattern of paths."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(EXTENSIONS)))
    return rows.where(~F.col("path").rlike(ignore)) if ignore else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their files come in fewer pieces than there are cores; larger tables stay as they lie.

    A Parquet row group is read by one task, and measures of texts take far longer than
    moving a table that small.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document a row."""
    rows.write.json(path)


def read_analysis(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Analyzer results; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
