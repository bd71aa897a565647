"""Event logs, stored corrections and result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators.routing import file_type_of_name
from docloom.plans.common import REQUESTS, documents, pages, requests
from docloom.plans.registry import query
from docloom.session import work_dir
from docloom.sources import corrections as C
from docloom.sources import events as E
from docloom.sources import results as R
from docloom.sources.requests import read_table

# ------------------------------------------------------------------------ event logs

# chunks sent twice, out of place or without their end, by the conversation's last speaker
_EVENTS = """
SELECT conv_id AS doc_id, turn * 3 AS pos, 'chunk' AS type,
       CASE WHEN role = 'system' THEN turn + 1 ELSE turn END AS idx, text AS html FROM conversations
UNION ALL
SELECT conv_id, turn * 3 + 2, 'done', NULL, text FROM conversations WHERE role = 'assistant' AND turn > 4
UNION ALL
SELECT conv_id, turn * 3 + 1, 'note', NULL, 'x' FROM conversations WHERE role = 'user'
"""


def _event_lines(spark, sf_dir):
    """Log lines: chunk events, an end after each late answer, keep-alive comments."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    total = F.lit(None).cast("long")
    chunk = E.format_event(F.struct(
        F.lit("chunk").alias("type"),
        F.when(F.col("role") == "system", F.col("turn") + 1).otherwise(F.col("turn")).alias("index"),
        total.alias("total"), F.col("text").alias("html")))
    done = E.format_event(F.struct(
        F.lit("done").alias("type"), F.col("text").alias("html"), F.lit("o").alias("original_html"),
        F.when(F.col("turn") < 7, "hi").alias("language"), F.lit("gemini").alias("provider")))
    late = (F.col("role") == "assistant") & (F.col("turn") > 4)
    lines = F.array(
        F.struct((F.col("turn") * 3).alias("pos"), chunk.alias("value")),
        F.struct((F.col("turn") * 3 + 1).alias("pos"), F.when(
            F.col("role") == "user", E.format_event(F.struct(F.lit("note").alias("type"), F.lit("x").alias("html")))
        ).otherwise(": keep-alive").alias("value")),
        F.struct((F.col("turn") * 3 + 2).alias("pos"), F.when(late, done).otherwise("").alias("value")))
    return conv.select(F.col("conv_id").alias("doc_id"), F.inline(lines))


@query("parse_event_log", f"SELECT doc_id, pos, type, idx AS index, html FROM ({_EVENTS})")
def parse_event_log(spark, sf_dir):
    """Events written as log lines and read back; comments and blank lines are skipped."""
    return E.parse_event_log(_event_lines(spark, sf_dir)).select("doc_id", "pos", "type", "index", "html")


@query("check_event_order", f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY pos) - 1 AS rn FROM ({_EVENTS}))
SELECT doc_id, count(*) FILTER (type = 'chunk') AS chunks,
  count(*) FILTER (type = 'chunk' AND idx <> rn) = 0 AS contiguous,
  count(*) FILTER (type = 'done') = 1 AS one_done,
  coalesce(max(CASE WHEN type = 'done' THEN pos END) = max(pos), false) AS done_last,
  count(*) FILTER (type = 'done') > 0 AND count(*) FILTER (type = 'done' AND pos >= 21) = 0 AS keys_present
FROM e GROUP BY doc_id
""")
def check_event_order(spark, sf_dir):
    """The end of a stream that comes in turn 7 lacks its language."""
    return E.check_event_order(E.parse_event_log(_event_lines(spark, sf_dir)))


# ----------------------------------------------------------------------- corrections

_SAVED = (
    "SELECT doc_id, text AS original_text, concat('[hi] ', text) AS translated_text, "
    "CASE WHEN lang = 'en' THEN concat('[hi] ', text) ELSE concat('[hi] ', replace(text, 'a', 'A')) END "
    "AS corrected_text, target_language, llm_provider AS provider"
)
_ENTRIES = f"""
SELECT original_text, translated_text AS llm_output, corrected_text AS human_correction,
       target_language AS language, provider FROM ({_SAVED} FROM ({REQUESTS}))
"""
_STORED = ["original_text", "llm_output", "human_correction", "language", "provider"]


def saved_corrections(df):
    return df.selectExpr(*[
        "doc_id", "text AS original_text", "concat('[hi] ', text) AS translated_text",
        "CASE WHEN lang = 'en' THEN concat('[hi] ', text) ELSE concat('[hi] ', replace(text, 'a', 'A')) END "
        "AS corrected_text", "target_language", "llm_provider AS provider"])


@query("correction_entries", _ENTRIES)
def correction_entries(spark, sf_dir):
    return C.correction_entries(saved_corrections(requests(spark, sf_dir))).select(*_STORED)


@query("append_corrections", f"{_ENTRIES} UNION ALL {_ENTRIES}")
def append_corrections(spark, sf_dir):
    """Two batches appended to one JSON-lines table and read back."""
    path = work_dir(spark, "corrections")
    for _ in range(2):
        C.append_corrections(C.correction_entries(saved_corrections(requests(spark, sf_dir))), path)
    return C.read_corrections(spark, path).select(*_STORED)


@query("training_pairs", f"""
SELECT DISTINCT * FROM ({_ENTRIES}) WHERE llm_output IS DISTINCT FROM human_correction
""")
def training_pairs(spark, sf_dir):
    """Real edits, each once, whatever was saved twice or unchanged."""
    once = C.correction_entries(saved_corrections(requests(spark, sf_dir)))
    return C.training_pairs(once.unionAll(once))


# --------------------------------------------------------------------------- results

@query("encode_outputs", """
SELECT page_id, CASE WHEN contains(html, '</body>') THEN to_base64(encode(html)) END AS html_b64 FROM pages
""")
def encode_outputs(spark, sf_dir):
    """A page without an end stands for a rendering that failed."""
    html = pages(spark, sf_dir).select(
        "page_id", F.when(F.contains("html", F.lit("</body>")), F.encode("html", "UTF-8")).alias("content"))
    return R.encode_outputs(html, "content", "html_b64").select("page_id", "html_b64")


_RESULTS = f"""
SELECT doc_id, '<p>[hi] ' || text || '</p>' AS html, '<p>' || text || '</p>' AS original_html,
  CASE WHEN model THEN target_language WHEN lower(target_language) = 'rajasthani' THEN 'hi'
       ELSE target_language END AS language,
  CASE WHEN model THEN llm_provider END AS provider,
  CASE WHEN lower(filename) LIKE '%.docx' THEN 'RE9DWA==' END AS translated_docx_b64,
  CASE WHEN lang <> 'es' THEN 'UERG' END AS translated_pdf_b64
FROM (SELECT *, llm_provider IS NOT NULL AND llm_provider <> '' AND lower(llm_provider) <> 'google' AS model
      FROM ({REQUESTS}))
"""


def _results(spark, sf_dir):
    rows = requests(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("<p>[hi] "), "text", F.lit("</p>")).alias("html"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("original_html"), "target_language", "llm_provider",
        file_type_of_name("filename").alias("file_type"), F.lit("RE9DWA==").alias("translated_docx_b64"),
        F.when(F.col("lang") != "es", "UERG").alias("translated_pdf_b64"))
    return R.result_rows(rows, ["doc_id"])


@query("result_rows", _RESULTS)
def result_rows(spark, sf_dir):
    return _results(spark, sf_dir)


@query("result_json", f"""
SELECT doc_id, CAST(to_json({{'html': html, 'original_html': original_html, 'language': language,
  'provider': provider, 'translated_docx_b64': translated_docx_b64, 'translated_pdf_b64': translated_pdf_b64}})
  AS VARCHAR) AS json FROM ({_RESULTS})
""")
def result_json(spark, sf_dir):
    return R.result_json(_results(spark, sf_dir), ["doc_id"])


@query("write_results", _RESULTS)
def write_results(spark, sf_dir):
    """Written to a table by language and read back."""
    path = work_dir(spark, "results")
    R.write_results(_results(spark, sf_dir), path, partition_by="language")
    return spark.read.parquet(path)


@query("read_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def read_documents(spark, sf_dir):
    return documents(spark, sf_dir)
