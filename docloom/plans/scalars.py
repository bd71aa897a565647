"""Routing, request checks and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import fixed, text
from docloom.operators import routing
from docloom.plans.common import REQUESTS, SEGS, WS, documents, pages, requests, sql_text
from docloom.plans.registry import query
from docloom.operators.segment import segments
from docloom.sources import requests as req


def _case(column: str, table: dict[str, str], other: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {other} END"


@query("language_fields", f"""
SELECT doc_id, target_language,
  CASE WHEN lower(target_language) = 'rajasthani' THEN 'hi' ELSE target_language END AS language_code,
  {_case("target_language", fixed.LANGUAGE_NAMES, "target_language")} AS name_exact,
  {_case("lower(target_language)", fixed.LANGUAGE_NAMES, "target_language")} AS name_folded,
  {_case("target_language", fixed.SCRIPT_CODES, sql_text(fixed.DEFAULT_SCRIPT_CODE))} AS script_code,
  CASE WHEN lower(target_language) IN ('hi', 'rajasthani') THEN 'Anek Devanagari' END AS font
FROM ({REQUESTS})
""")
def language_fields(spark, sf_dir):
    lang = "target_language"
    return requests(spark, sf_dir).select(
        "doc_id", lang,
        routing.normalize_language(lang).alias("language_code"),
        routing.language_name(lang).alias("name_exact"),
        routing.language_name(lang, fold_case=True).alias("name_folded"),
        routing.script_code(lang).alias("script_code"),
        routing.target_font(lang).alias("font"))


_TYPED = f"""
SELECT *, CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN lower(filename) LIKE '%.docx' THEN 'docx' END
  AS kind, llm_provider IS NOT NULL AND llm_provider <> '' AND lower(llm_provider) <> 'google' AS model
FROM ({REQUESTS})
"""


@query("accept_uploads", f"""
SELECT doc_id, filename, kind AS file_type, CASE WHEN kind IS NULL THEN 400 ELSE 200 END AS status,
  CASE WHEN kind IS NULL THEN 'filename must end with .pdf or .docx' END AS detail FROM ({_TYPED})
""")
def accept_uploads(spark, sf_dir):
    return req.accept_uploads(requests(spark, sf_dir)).select(
        "doc_id", "filename", "file_type", "status", "detail")


@query("accept_pdf_only", f"""
SELECT doc_id, filename, CASE WHEN kind = 'pdf' THEN kind END AS file_type,
  CASE WHEN kind = 'pdf' THEN 200 ELSE 400 END AS status,
  CASE WHEN kind = 'pdf' THEN NULL ELSE 'Only .pdf files are supported' END AS detail FROM ({_TYPED})
""")
def accept_pdf_only(spark, sf_dir):
    return req.accept_uploads(requests(spark, sf_dir), "pdf").select(
        "doc_id", "filename", "file_type", "status", "detail")


@query("route", f"""
SELECT doc_id, llm_provider, kind || CASE WHEN model THEN '_model' ELSE '_google' END AS route
FROM ({_TYPED}) WHERE kind IS NOT NULL
""")
def route(spark, sf_dir):
    accepted, _ = routing.split_rejects(req.accept_uploads(requests(spark, sf_dir)))
    return routing.route(accepted).select("doc_id", "llm_provider", "route")


_KNOWN = ", ".join(f"'{t}'" for t in fixed.TRANSLATORS)


@query("check_provider", f"""
SELECT doc_id, llm_provider, CASE WHEN bad THEN 503 ELSE 200 END AS status,
  CASE WHEN bad THEN 'Translator ''' || llm_provider || ''' not configured' END AS detail
FROM (SELECT *, model AND llm_provider NOT IN ({_KNOWN}) AS bad FROM ({_TYPED}))
""")
def check_provider(spark, sf_dir):
    return routing.check_provider(requests(spark, sf_dir), fixed.TRANSLATORS).select(
        "doc_id", "llm_provider", "status", "detail")


@query("check_reviewer", f"""
SELECT doc_id, llm_provider, CASE WHEN bad THEN 503 ELSE 200 END AS status,
  CASE WHEN bad THEN 'Reviewer ''' || llm_provider || ''' not configured' END AS detail
FROM (SELECT *, model AND llm_provider NOT IN ('gemini', 'openai') AS bad FROM ({_TYPED}))
""")
def check_reviewer(spark, sf_dir):
    return routing.check_provider(requests(spark, sf_dir), fixed.REVIEWERS, role="Reviewer").select(
        "doc_id", "llm_provider", "status", "detail")


# the page's language stands for the answer's content type; a query string hides a suffix
_URL = "regexp_replace(url, '[?]', CASE WHEN contains(url, '/de/') THEN '.DOCX?' ELSE '.PDF?' END)"
_TYPE = (
    "CASE WHEN contains(html, 'lang=\"fr\"') THEN 'Application/PDF' WHEN contains(html, 'lang=\"es\"') "
    "THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' "
    "WHEN contains(html, 'lang=\"de\"') THEN 'text/html' END"
)


@query("detect_file_type", f"""
WITH u AS (SELECT page_id, {_URL} AS url, {_TYPE} AS content_type FROM pages),
k AS (SELECT *, CASE WHEN lower(split_part(url, '?', 1)) LIKE '%.pdf' OR contains(lower(content_type), 'pdf')
    THEN 'pdf' WHEN lower(split_part(url, '?', 1)) LIKE '%.docx'
    OR contains(lower(content_type), 'officedocument.wordprocessingml') THEN 'docx' END AS file_type FROM u)
SELECT page_id, url, file_type, CASE WHEN file_type IS NULL THEN 400 ELSE 200 END AS status,
  CASE WHEN file_type IS NULL THEN {sql_text(fixed.BAD_URL_TYPE)} END AS detail FROM k
""")
def detect_file_type(spark, sf_dir):
    urls = pages(spark, sf_dir).selectExpr("page_id", f"{_URL} AS url", f"{_TYPE} AS content_type")
    return req.detect_file_type(urls).select("page_id", "url", "file_type", "status", "detail")


# good data; with line breaks in it; with its padding cut off; not base64 at all
_DATA_SPARK = (
    "CASE lang WHEN 'en' THEN base64(encode(text, 'UTF-8')) "
    "WHEN 'fr' THEN regexp_replace(base64(encode(text, 'UTF-8')), 'A', concat('A', chr(10), '-')) "
    "WHEN 'de' THEN rtrim('=', base64(encode(text, 'UTF-8'))) "
    "ELSE concat('!!!not-valid-base64!!!', CAST(doc_id AS STRING)) END"
)
_DATA_DUCK = (
    "CASE lang WHEN 'en' THEN to_base64(encode(text)) "
    "WHEN 'fr' THEN regexp_replace(to_base64(encode(text)), 'A', 'A' || chr(10) || '-', 'g') "
    "WHEN 'de' THEN rtrim(to_base64(encode(text)), '=') "
    "ELSE '!!!not-valid-base64!!!' || doc_id END"
)


@query("decode_base64_requests", f"""
WITH d AS (SELECT doc_id, filename, regexp_replace({_DATA_DUCK}, '[^A-Za-z0-9+/=]', '', 'g') AS data,
           kind FROM ({_TYPED})),
v AS (SELECT *, regexp_full_match(data, '[A-Za-z0-9+/]*={{0,2}}') AND length(data) % 4 = 0 AS ok FROM d)
SELECT doc_id, kind AS file_type,
  CASE WHEN NOT ok OR kind IS NULL THEN 400 ELSE 200 END AS status,
  CASE WHEN NOT ok THEN 'Invalid base64 data'
       WHEN kind IS NULL THEN 'filename must end with .pdf or .docx' END AS detail,
  CASE WHEN ok AND kind IS NOT NULL THEN lower(hex(from_base64(data))) END AS content_hex
FROM v
""")
def decode_base64_requests(spark, sf_dir):
    sent = requests(spark, sf_dir).selectExpr("doc_id", "filename", f"{_DATA_SPARK} AS file_data")
    return req.decode_base64_requests(sent).select(
        "doc_id", "file_type", "status", "detail", F.lower(F.hex("content")).alias("content_hex"))


@query("output_name", f"""
SELECT doc_id, 'translated_' || regexp_replace(filename, '(?i)\\.(docx|pdf)$', '') || '.html' AS name
FROM ({REQUESTS})
""")
def output_name(spark, sf_dir):
    return requests(spark, sf_dir).select("doc_id", text.output_name("filename", ".html").alias("name"))


# ---------------------------------------------------------------- text functions

@query("trim_white_space", f"""
SELECT doc_id, trim(chr(160) || chr(9) || text || chr(8195) || chr(10), {WS}) AS text FROM documents
""")
def trim_white_space(spark, sf_dir):
    padded = F.concat(F.lit("\xa0\t"), "text", F.lit(" \n"))
    return documents(spark, sf_dir).select("doc_id", text.trim_ws(padded).alias("text"))


_ESCAPED = (
    "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
    "'\"', '&quot;'), '''', '&#x27;')"
)


@query("escape_html", f"SELECT doc_id, {_ESCAPED} AS html FROM documents")
def escape_html(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.escape_html("text").alias("html"))


@query("unescape_html", "SELECT doc_id, text FROM documents")
def unescape_html(spark, sf_dir):
    """Escaping and unescaping is the identity."""
    return documents(spark, sf_dir).select(
        "doc_id", text.unescape_html(text.escape_html("text")).alias("text"))


@query("decode_entities", """
SELECT page_id, replace(replace(replace(html, '&#39;', ''''), '&quot;', '"'), '&amp;', '&') AS html FROM pages
""")
def decode_entities(spark, sf_dir):
    html = pages(spark, sf_dir)
    return html.select("page_id", text.decode_entities("html").alias("html"))


@query("extract_body", """
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<body[^>]*>([\\s\\S]*?)</body>')
  THEN regexp_extract(html, '(?i)<body[^>]*>([\\s\\S]*?)</body>', 1) ELSE html END AS body FROM pages
""")
def extract_body(spark, sf_dir):
    """Pages without a closing body tag come back whole."""
    html = pages(spark, sf_dir)
    return html.select("page_id", text.extract_body("html").alias("body"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>?', ' ', 'g') AS text FROM pages")
def strip_tags(spark, sf_dir):
    html = pages(spark, sf_dir)
    return html.select("page_id", text.strip_tags("html").alias("text"))


_GLYPHS = "".join(fixed.SYMBOLS_FROM)


@query("map_symbols", """
SELECT doc_id, translate(text, ',.-;:!', '☑☐✓✗☐■') AS mapped,
  CASE WHEN lang = 'en' THEN translate(text, ',.-;:!', '☑☐✓✗☐■') END AS wingdings_only
FROM documents
""")
def map_symbols(spark, sf_dir):
    """Punctuation stands for the six glyphs of a symbol font."""
    glyphs = F.translate("text", ",.-;:!", _GLYPHS)
    font = F.when(F.col("lang") == "en", "Wingdings").otherwise("Arial")
    return documents(spark, sf_dir).select(
        "doc_id", text.map_symbols(glyphs).alias("mapped"),
        F.when(F.col("lang") == "en", text.map_symbols(glyphs, font)).alias("wingdings_only"))


# fenced with a language; opened only; not fenced; a fence with blanks around it
_FENCED = (
    "CASE lang WHEN 'en' THEN concat('```html', chr(10), text, chr(10), '```') "
    "WHEN 'fr' THEN concat('```', chr(10), text) WHEN 'de' THEN text "
    "ELSE concat('  ```', chr(10), text, chr(10), ' ``` ') END"
)


def _fence_sql(body: str) -> str:
    return f"CASE WHEN starts_with(t, '```') THEN {body} ELSE t END"


def _lines_sql(first: int, last: str) -> str:
    return f"array_to_string(list_slice(string_split(t, chr(10)), {first}, {last}), chr(10))"


_N = "len(string_split(t, chr(10)))"
_INNER = _lines_sql(2, f"{_N} - 1")
_SAFE = (
    f"CASE WHEN {_N} > 2 THEN trim(CASE WHEN trim(string_split(t, chr(10))[-1], {WS}) = '```' "
    f"THEN {_INNER} ELSE {_lines_sql(2, _N)} END, {WS}) ELSE t END"
)


@query("strip_code_fence", f"""
SELECT doc_id,
  {_fence_sql(f"CASE WHEN {_N} > 2 THEN {_INNER} ELSE t END")} AS plain,
  {_fence_sql(f"CASE WHEN {_N} > 2 THEN trim({_INNER}, {WS}) ELSE t END")} AS batch,
  {_fence_sql(_SAFE)} AS safe,
  {_fence_sql(f"trim({_INNER}, {WS})")} AS review
FROM (SELECT doc_id, trim({_FENCED}, {WS}) AS t FROM documents)
""")
def strip_code_fence(spark, sf_dir):
    answers = documents(spark, sf_dir).selectExpr("doc_id", f"{_FENCED} AS answer")
    return answers.select("doc_id", *[
        text.strip_code_fence("answer", v).alias(v) for v in ("plain", "batch", "safe", "review")])


@query("segment_key", f"SELECT DISTINCT text, lower(sha256(text)) AS seg_key FROM ({SEGS})")
def segment_key(spark, sf_dir):
    segs = segments(documents(spark, sf_dir)).select("text").distinct()
    return segs.select("text", F.lower(F.hex(text.segment_key("text"))).alias("seg_key"))
