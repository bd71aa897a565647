"""Human corrections: stored as JSON lines, read back as training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRECTION_SCHEMA = (
    "entry_id string, original_text string, llm_output string, human_correction string, "
    "language string, provider string, saved_at timestamp"
)


def correction_entries(df: DataFrame) -> DataFrame:
    """Rename request fields to stored fields, with an id and the time of saving."""
    return df.select(
        F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("entry_id"), "original_text",
        F.col("translated_text").alias("llm_output"), F.col("corrected_text").alias("human_correction"),
        F.col("target_language").alias("language"), "provider",
        F.current_timestamp().alias("saved_at"))


def append_corrections(entries: DataFrame, path: str) -> None:
    """One JSON object on a line, UTF-8, appended; compressed, as an entry holds its text three times."""
    entries.write.mode("append").option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORRECTION_SCHEMA).json(path)


def training_pairs(corrections: DataFrame) -> DataFrame:
    """Distinct real edits; an entry whose two texts agree teaches nothing."""
    kept = ["original_text", "llm_output", "human_correction", "language", "provider"]
    return corrections.where(~F.col("llm_output").eqNullSafe(F.col("human_correction"))).select(
        *kept).distinct()
