"""Result rows and their storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.routing import normalize_language, uses_model


def encode_outputs(df: DataFrame, column: str, out: str) -> DataFrame:
    """Binary to base64 text on one line; a rendering that failed is null and stays null."""
    return df.withColumn(out, F.translate(F.base64(column), "\r\n", ""))


def result_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The result as handed out.

    Google routes report the mapped language and no provider, model routes the requested
    language; only DOCX routes carry a DOCX.
    """
    model = uses_model("llm_provider")
    language = F.when(model, F.col("target_language")).otherwise(normalize_language("target_language"))
    return df.select(
        *keys, "html", "original_html", language.alias("language"),
        F.when(model, F.col("llm_provider")).alias("provider"),
        F.when(F.col("file_type") == "docx", F.col("translated_docx_b64")).alias("translated_docx_b64"),
        "translated_pdf_b64")


def result_json(results: DataFrame, keys: list[str], out: str = "json") -> DataFrame:
    fields = [c for c in results.columns if c not in keys]
    return results.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(out))


def write_results(results: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = results.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
