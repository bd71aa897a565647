"""Whole requests, end to end."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docloom.functions.fixed import BAD_FILENAME, HTML_FOOTER, HTML_HEADER, PROTECTED_TERMS
from docloom.operators import memory, quality, review, routing, segment
from docloom.operators.assemble import assemble
from docloom.operators.policy import RetryPolicy
from docloom.operators.translate import Engine, translate_by_engine, translate_chunks, translate_html
from docloom.plans.common import LINES, REQUESTS, WS, documents, pages, requests
from docloom.plans.registry import query
from docloom.session import work_dir
from docloom.sources import corrections as C
from docloom.sources import requests as req
from docloom.sources import results as R


def _say(name):
    def fn(texts, language):
        if any("ß" in t for t in texts):
            return list(texts)  # an engine that overlooks some lines
        return [f"एक दो तीन {name} {language} " + t.translate(_SOFT) for t in texts]

    return fn


# letters that make a translated line read as another script
_SOFT = str.maketrans("aeioutrn", "अएइओउतरन")
_SOFT_SQL = "translate({x}, 'aeioutrn', 'अएइओउतरन')"

ENGINES = {
    "gemini": Engine(_say("g"), 1, RetryPolicy()),
    "openai": Engine(_say("o"), 1, RetryPolicy()),
}


def _reviewer(texts, language):
    return [f"समीक्षा {language} " + t for t in texts]


def _page_model(html, language):
    return html.replace("<p>", f"<p>[{language}] ")


def _html_model(htmls, language):
    """Changes paragraphs, and escapes what such an engine escapes."""
    return [h.replace("&", "&amp;").replace("<p>", f"<p>g {language} ") for h in htmls]


_CODE = "CASE WHEN lower(target_language) = 'rajasthani' THEN 'hi' ELSE target_language END"
_KIND = "CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN lower(filename) LIKE '%.docx' THEN 'docx' END"
_MODEL = "coalesce(llm_provider, '') <> '' AND lower(coalesce(llm_provider, '')) <> 'google'"
_ASKED = f"SELECT *, {_CODE} AS code, {_KIND} AS kind, {_MODEL} AS model FROM ({REQUESTS})"
_SAID = f"'एक दो तीन ' || substr(llm_provider, 1, 1) || ' ' || code || ' ' || {_SOFT_SQL.format(x='text')}"
_ASIDE = (
    r"<[^>]*>|__R?(TERM|BRACKET)_\d+A?__|\[\[[^\n]*?\]\]|(STYLE|IMG)_PLACEHOLDER_\d+|"
    + "|".join(re.escape(t) for t in PROTECTED_TERMS) + r"|\d+([.,/:\-]\d+)*%?"
)
_LINE_OF = f"""
SELECT *, CASE WHEN contains(text, 'ß') THEN text ELSE {_SAID} END AS translated
FROM (SELECT a.*, l.seg_no, trim(l.line, {WS}) AS text
      FROM (SELECT doc_id, seg_no, line FROM ({LINES})) l
      JOIN (SELECT * EXCLUDE (text) FROM ({_ASKED})) a ON l.doc_id = a.doc_id WHERE trim(l.line, {WS}) <> '')
"""
_DONE_LINES = f"""
SELECT *, CASE WHEN NOT model THEN 'g ' || code || ' ' || text
  WHEN kind = 'pdf' THEN '[' || code || '] ' || text
  WHEN len(words) > 0 AND (text = translated OR
    len(list_filter(words, lambda w: regexp_full_match(w, '\\p{{Latin}}+'))) > 0.5 * len(words))
  THEN 'समीक्षा ' || code || ' ' || translated ELSE translated END AS final
FROM (SELECT *, regexp_extract_all(regexp_replace(translated, '{_ASIDE}', ' ', 'g'), '[\\p{{L}}\\p{{M}}]+') AS words
      FROM ({_LINE_OF}))
"""


def _stored(df, name):
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("translate_requests", f"""
WITH d AS (SELECT doc_id, '{HTML_HEADER}' || string_agg('<p>' || final || '</p>', '' ORDER BY seg_no) || '{HTML_FOOTER}' AS html,
      '{HTML_HEADER}' || string_agg('<p>' || text || '</p>', '' ORDER BY seg_no) || '{HTML_FOOTER}' AS original_html
      FROM ({_DONE_LINES}) GROUP BY doc_id),
r AS (SELECT *, CASE WHEN kind IS NULL THEN 400 WHEN model AND llm_provider NOT IN ('gemini', 'openai') THEN 503 ELSE 200
      END AS status FROM ({_ASKED}))
SELECT r.doc_id, r.status,
  CASE r.status WHEN 400 THEN '{BAD_FILENAME}'
    WHEN 503 THEN 'Translator ' || chr(39) || llm_provider || chr(39) || ' not configured' END AS detail,
  CASE WHEN r.status = 200 THEN coalesce(html, '{HTML_HEADER}{HTML_FOOTER}') END AS html,
  CASE WHEN r.status = 200 THEN coalesce(original_html, '{HTML_HEADER}{HTML_FOOTER}') END AS original_html,
  CASE WHEN r.status = 200 THEN CASE WHEN model THEN target_language ELSE code END END AS language,
  CASE WHEN r.status = 200 AND model THEN llm_provider END AS provider
FROM r LEFT JOIN d ON r.doc_id = d.doc_id
""")
def translate_requests(spark, sf_dir):
    """Check, route, translate, review, assemble, hand out: one row for each request.

    DOCX with a model goes line by line, each distinct line once, with a review; PDF with a
    model in chunks of pages; what google translates as one HTML document. Requests that
    fail a check come back with their status.

    Translations and chunks are written once and read back: later steps read them several
    times, and a lost executor must not repeat paid calls.
    """
    asked = requests(spark, sf_dir)
    accepted, bad_name = routing.split_rejects(req.accept_uploads(asked))
    checked, no_engine = routing.split_rejects(
        routing.check_provider(accepted.drop("status", "detail"), list(ENGINES)))
    # read by every branch below: checked and routed once
    ready = _stored(routing.route(checked).withColumn("code", routing.normalize_language("target_language")), "ready")
    wrapped = {"header": HTML_HEADER, "footer": HTML_FOOTER}

    def paragraph(text):
        return F.concat(F.lit("<p>"), text, F.lit("</p>"))

    # lines
    segs = segment.segments(ready.where("route = 'docx_model'"), keep=["llm_provider", "code"])
    key = ["llm_provider", "code", "text"]
    counted = _stored(segs.groupBy(*key).agg(F.count(F.lit(1)).alias("uses")), "counted")
    done = translate_by_engine(counted, ENGINES, language_col="code")
    known = memory.write_memory(done, work_dir(spark, "memory"), key)
    placed = memory.apply_translations(segs, known, key, hot=memory.hot_keys(counted, key))
    placed.write.parquet(path := work_dir(spark, "placed"))
    final = quality.review_pass(spark.read.parquet(path), [_reviewer], by=("llm_provider", "code"))
    final.write.parquet(path := work_dir(spark, "reviewed-lines"))
    by_line = assemble(
        spark.read.parquet(path).select("doc_id", "seg_no", paragraph("translated").alias("html")),
        "doc_id", "seg_no", **wrapped)

    # pages in chunks: here a line is a page
    lines = segment.segments(ready.where("route = 'pdf_model'"))
    chunks = segment.wrap_chunk(segment.chunk_pages(
        lines.select("doc_id", "seg_no", paragraph("text").alias("page")), order="seg_no", html="page"))
    answered = translate_chunks(
        chunks.drop("pages").join(ready.select("doc_id", "code"), "doc_id"), _page_model, language="code", mask=True)
    answered.write.parquet(path := work_dir(spark, "answered"))
    by_chunk = assemble(spark.read.parquet(path), "doc_id", "chunk_index", **wrapped)

    # originals, and whole documents for google; a document without a line is an empty page
    empty = F.lit(HTML_HEADER + HTML_FOOTER)
    originals = assemble(
        segment.segments(ready).select("doc_id", "seg_no", paragraph("text").alias("html")),
        "doc_id", "seg_no", out="original_html", **wrapped)
    every = ready.drop("text").join(originals, "doc_id", "left").withColumn(
        "original_html", F.coalesce("original_html", empty))
    whole = translate_html(every.where("route LIKE '%google'").select("doc_id", "code", "original_html"),
                           Engine(_html_model), "original_html", "code", out="html")
    whole.select("doc_id", "html").write.parquet(path := work_dir(spark, "whole"))

    texts = by_line.unionByName(by_chunk).unionByName(spark.read.parquet(path))
    none = F.lit(None).cast("string")
    rows = every.join(texts, "doc_id", "left").withColumn("html", F.coalesce("html", empty))
    results = R.result_rows(
        rows.withColumn("translated_docx_b64", none).withColumn("translated_pdf_b64", none), ["doc_id"])
    handed = results.drop("translated_docx_b64", "translated_pdf_b64").withColumn("status", F.lit(200)).withColumn("detail", none)
    rejects = bad_name.select("doc_id", "status", "detail").unionByName(no_engine.select("doc_id", "status", "detail"))
    return handed.unionByName(rejects, allowMissingColumns=True)


def _translate_words(htmls, language):
    return [h.replace(" the ", f" THE-{language} ").replace("'", "&#39;") for h in htmls]


@query("translate_html_google", """
SELECT page_id, replace(replace(replace(replace(html, ' the ', ' THE-hi '), '&#39;', chr(39)),
  '&quot;', '"'), '&amp;', '&') AS translated, 'ok' AS status FROM pages
""")
def translate_html_google(spark, sf_dir):
    """Whole pages by an engine that reads HTML; their style blocks stay out of the call."""
    docs = pages(spark, sf_dir).select("page_id", "html", F.lit("hi").alias("target_language"))
    return translate_html(docs, Engine(_translate_words)).select("page_id", "translated", "status")


_FIRST = "regexp_extract(text, '[A-Za-z]{4,}', 0)"


def _critic(original, translated, language):
    import json
    import re

    word = re.search("[A-Za-z]{4,}", translated[5:])
    return json.dumps({"score": 6, "corrections": [{
        "incorrect_snippet": word.group(0) if word else "", "suggested_fix": "ठीक", "reason": "r"}]})


@query("evaluate_fix_and_save", f"""
SELECT DISTINCT text AS original_text, '[hi] ' || text AS llm_output,
  '[hi] ' || substr(text, 1, strpos(text, {_FIRST}) - 1) || 'ठीक' || substr(text, strpos(text, {_FIRST}) + length({_FIRST}))
  AS human_correction, 'hi' AS language, 'gemini' AS provider
FROM documents WHERE {_FIRST} <> ''
""")
def evaluate_fix_and_save(spark, sf_dir):
    """Judge every translation, apply what it corrects, store the entries, read the pairs."""
    sent = documents(spark, sf_dir).select(
        F.col("text").alias("original_text"), F.concat(F.lit("[hi] "), "text").alias("translated_text"),
        F.lit("hi").alias("target_language"))
    judged = review.parse_reviews(review.evaluate(sent, _critic))
    fixed = review.apply_fixes(judged.where(F.col("score") < 8), "translated_text", out="corrected_text")
    path = work_dir(spark, "reviewed")
    C.append_corrections(C.correction_entries(fixed.withColumn("provider", F.lit("gemini"))), path)
    return C.training_pairs(C.read_corrections(spark, path))
