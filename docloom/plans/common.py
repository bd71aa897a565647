"""Inputs that queries derive from the given tables, as SQL both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.functions.fixed import WHITE_SPACE
from docloom.sources.requests import read_table, spread

# request fields that the documents table does not have, from its language and source
TARGET = (
    "CASE lang WHEN 'en' THEN 'Rajasthani' WHEN 'fr' THEN 'hi' WHEN 'de' THEN 'TE' ELSE 'xx' END"
)
PROVIDER = (
    "CASE WHEN source IN ('src0', 'src1') THEN NULL WHEN source = 'src2' THEN '' "
    "WHEN source IN ('src3', 'src4') THEN 'Google' WHEN source IN ('src5', 'src6', 'src7') THEN 'gemini' "
    "WHEN source IN ('src8', 'src9') THEN 'Gemini' WHEN source IN ('src10', 'src11') THEN 'indictrans2' "
    "ELSE 'openai' END"
)
FILENAME = (
    "concat(source, '-', CAST(doc_id AS VARCHAR(20)), CASE lang WHEN 'en' THEN '.docx' "
    "WHEN 'fr' THEN '.PDF' WHEN 'de' THEN '.Docx' ELSE '.txt' END)"
)
REQUESTS = (
    f"SELECT doc_id, text, lang, source, {TARGET} AS target_language, {PROVIDER} AS llm_provider, "
    f"{FILENAME} AS filename FROM documents"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "pages"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(
        "doc_id", "text", "lang", "source", f"{TARGET} AS target_language",
        f"{PROVIDER} AS llm_provider", f"{FILENAME} AS filename")


def sql_text(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("'", "''") + "'"


WS = sql_text(WHITE_SPACE)
LINES = (
    "SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, "
    "unnest(range(len(string_split(text, chr(10))))) AS seg_no FROM documents"
)
SEGS = f"SELECT doc_id, lang, source, seg_no, trim(line, {WS}) AS text FROM ({LINES}) WHERE trim(line, {WS}) <> ''"


def prefix_hindi(texts: list[str]) -> list[str]:
    """Stands in for a model: reversible, and the same in every engine."""
    return ["[hi] " + t for t in texts]
