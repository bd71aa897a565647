"""Request routing: language, engine and file type. Projections only, no joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.text import ColumnOrName, col, lookup


def normalize_language(c: ColumnOrName) -> Column:
    c = col(c)
    return F.when(F.lower(c) == "rajasthani", "hi").otherwise(c)


def language_name(c: ColumnOrName, fold_case: bool = False) -> Column:
    """Display name; an unknown code stands for itself."""
    c = col(c)
    return F.coalesce(lookup(F.lower(c) if fold_case else c, fixed.LANGUAGE_NAMES), c)


def script_code(c: ColumnOrName) -> Column:
    return F.coalesce(lookup(col(c), fixed.SCRIPT_CODES), F.lit(fixed.DEFAULT_SCRIPT_CODE))


def target_font(c: ColumnOrName) -> Column:
    return F.when(F.lower(col(c)).isin("hi", "rajasthani"), fixed.HINDI_FONT)


def uses_model(provider: ColumnOrName) -> Column:
    """True for a named engine other than google."""
    p = F.coalesce(col(provider), F.lit(""))
    return (p != "") & (F.lower(p) != "google")


def route(df: DataFrame, file_type: str = "file_type", provider: str = "llm_provider") -> DataFrame:
    engine = F.when(uses_model(provider), "model").otherwise("google")
    return df.withColumn("route", F.concat(F.col(file_type), F.lit("_"), engine))


def check_provider(df: DataFrame, registered: list[str], provider: str = "llm_provider",
                   role: str = "Translator") -> DataFrame:
    """Mark requests whose engine is not registered (names are case-sensitive): 503."""
    missing = uses_model(provider) & ~F.col(provider).isin(registered)
    detail = F.concat(F.lit(f"{role} '"), F.col(provider), F.lit("' not configured"))
    return df.select(
        "*", F.when(missing, 503).otherwise(200).alias("status"), F.when(missing, detail).alias("detail"))


def split_rejects(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(status) == 200), df.where(F.col(status) != 200)


def file_type_of_name(filename: ColumnOrName) -> Column:
    name = F.lower(col(filename))
    return F.when(F.endswith(name, F.lit(".pdf")), "pdf").when(F.endswith(name, F.lit(".docx")), "docx")


def file_type_of_url(url: ColumnOrName, content_type: ColumnOrName) -> Column:
    """By path or content type; pdf wins when both match."""
    path = F.split_part(F.lower(col(url)), F.lit("?"), F.lit(1))
    kind = F.coalesce(F.lower(col(content_type)), F.lit(""))
    return (
        F.when(F.endswith(path, F.lit(".pdf")) | F.contains(kind, F.lit("pdf")), "pdf")
        .when(F.endswith(path, F.lit(".docx"))
              | F.contains(kind, F.lit("officedocument.wordprocessingml")), "docx")
    )
