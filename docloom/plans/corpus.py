"""Segments, batches, chunks, and the translation of a whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.fixed import ENGINES, HTML_FOOTER, HTML_HEADER
from docloom.functions.masking import mask_terms
from docloom.functions.text import segment_key
from docloom.operators import memory, segment
from docloom.operators.assemble import assemble, assemble_parts
from docloom.operators.policy import RetryPolicy
from docloom.operators.requests import plan_chunk_stream, plan_rates, plan_requests
from docloom.operators.translate import (
    REVIEW_TEMPLATE, Engine, align_lines, build_prompts, translate_by_engine, translate_chunks, translate_segments,
)
from docloom.plans.common import LINES, SEGS, WS, documents, prefix_hindi
from docloom.plans.registry import query
from docloom.session import work_dir
from docloom.sources.requests import read_table, with_defaults


@query("translate_corpus", f"""
SELECT doc_id, string_agg(CASE WHEN trim(line, {WS}) = '' THEN line ELSE '[hi] ' || trim(line, {WS}) END,
                          chr(10) ORDER BY seg_no) AS text
FROM ({LINES}) GROUP BY doc_id
""")
def translate_corpus(spark, sf_dir):
    """Each distinct line is translated once; documents keep their blank lines.

    Lines travel to the join as 32-byte keys; their text moves once, folded, to the
    distinct count. Lines used very often are spread over several join tasks.
    """
    rows = segment.paragraphs(documents(spark, sf_dir).select("doc_id", "text"))
    uses = segment.distinct_segments(rows.where(F.col("text").isNotNull()))
    counted = uses.select("text", "uses")
    counted.write.option("compression", "zstd").parquet(path := work_dir(spark, "corpus-uses"))
    # counted once, for the calls and for the frequent lines
    keyed_uses = spark.read.parquet(path).withColumn("seg_key", segment_key("text"))
    done = translate_segments(keyed_uses, prefix_hindi, keep=["seg_key"], spread=False)
    translations = memory.write_memory(
        done.select("seg_key", "translated", "status"), work_dir(spark, "corpus-memory"), ["seg_key"], new=True)
    hot = memory.hot_keys(keyed_uses, ["seg_key"])
    keyed = rows.select("doc_id", "seg_no", segment_key("text").alias("seg_key"), "blank")
    placed = memory.apply_memory(keyed, translations, ["seg_key"], hot=hot)
    parts = placed.select("doc_id", "seg_no", F.coalesce("translated", "blank").alias("part"))
    return assemble(parts, "doc_id", "seg_no", "part", sep="\n", out="text")


@query("segments", f"SELECT doc_id, seg_no, text FROM ({SEGS})")
def segments(spark, sf_dir):
    return segment.segments(documents(spark, sf_dir))


@query("distinct_segments_doc", f"""
SELECT doc_id, text, count(*) AS uses, min(seg_no) AS first_seg FROM ({SEGS}) GROUP BY doc_id, text
""")
def distinct_segments_doc(spark, sf_dir):
    return segment.distinct_segments(segment.segments(documents(spark, sf_dir)), "doc")


@query("distinct_segments_corpus", f"""
SELECT text, count(*) AS uses, min(doc_id) AS first_doc FROM ({SEGS}) GROUP BY text
""")
def distinct_segments_corpus(spark, sf_dir):
    return segment.distinct_segments(segment.segments(documents(spark, sf_dir)))


_DISTINCT = f"SELECT doc_id, text, min(seg_no) AS first_seg FROM ({SEGS}) GROUP BY doc_id, text"


def _batches_sql(size: int) -> str:
    return f"""
SELECT doc_id, first_seg, text, (rn // {size}) AS batch_no, (rn % {size}) AS pos
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_seg) - 1 AS rn FROM ({_DISTINCT}))"""


@query("batch_segments", _batches_sql(25))
def batch_segments(spark, sf_dir, size=25):
    segs = segment.distinct_segments(segment.segments(documents(spark, sf_dir)), "doc")
    return segment.batch_segments(segs, size).select("doc_id", "first_seg", "text", "batch_no", "pos")


@query("plan_requests", "\nUNION ALL\n".join(f"""
SELECT doc_id, '{name}' AS provider, n AS segments, CAST(ceil(n / {size}.0) AS BIGINT) AS requests,
       CAST((ceil(n / {size}.0) - 1) * {gap} AS BIGINT) AS paced_s
FROM (SELECT doc_id, count(*) AS n FROM ({_DISTINCT}) GROUP BY doc_id)""" for name, size, gap in ENGINES))
def plan(spark, sf_dir):
    segs = segment.segments(documents(spark, sf_dir))
    return plan_requests(segs.select("doc_id", "text").distinct())


# ------------------------------------------------------------------ translating

@query("translate_segments", f"""
SELECT DISTINCT text, '[hi] ' || text AS translated, 'ok' AS status, 1 AS attempts FROM ({SEGS})
""")
def translate(spark, sf_dir):
    uniq = segment.distinct_segments(segment.segments(documents(spark, sf_dir)))
    return translate_segments(uniq, prefix_hindi)


@query("translate_segments_masked", f"""
SELECT DISTINCT text, '[hi] ' || text AS translated, 'ok' AS status FROM (
  SELECT replace(replace(text, ' the ', ' GST '), ' que ', ' [[que]] ') AS text FROM ({SEGS}))
""")
def translate_masked(spark, sf_dir):
    """Terms and bracket tokens are hidden from the model and come back."""
    segs = segment.segments(documents(spark, sf_dir)).withColumn(
        "text", F.expr("replace(replace(text, ' the ', ' GST '), ' que ', ' [[que]] ')"))
    uniq = segment.distinct_segments(segs)
    return translate_segments(uniq, prefix_hindi, mask=True).select("text", "translated", "status")


def _fails_on_marks(texts):
    if any("ß" in t or "ñ" in t for t in texts):
        raise ValueError("engine refused")
    return prefix_hindi(texts)


@query("translate_with_fallback", f"""
SELECT DISTINCT text,
  CASE WHEN contains(text, 'ß') OR contains(text, 'ñ') THEN text ELSE '[hi] ' || text END AS translated,
  CASE WHEN contains(text, 'ß') OR contains(text, 'ñ') THEN 'kept' ELSE 'ok' END AS status
FROM ({SEGS})
""")
def translate_with_fallback(spark, sf_dir):
    """A failing request keeps its originals. One segment a request, so the outcome does
    not depend on which segments share one."""
    uniq = segment.distinct_segments(segment.segments(documents(spark, sf_dir)))
    return translate_segments(uniq, _fails_on_marks, RetryPolicy(), batch_size=1).select(
        "text", "translated", "status")


@query("translate_split_batches", f"""
SELECT DISTINCT text,
  CASE WHEN contains(text, 'ß') OR contains(text, 'ñ') THEN text ELSE '[hi] ' || text END AS translated,
  CASE WHEN contains(text, 'ß') OR contains(text, 'ñ') THEN 'kept' ELSE 'ok' END AS status
FROM ({SEGS})
""")
def translate_split_batches(spark, sf_dir):
    """A failing request of 25 is halved until the lines that it fails for stand alone."""
    uniq = segment.distinct_segments(segment.segments(documents(spark, sf_dir)))
    return translate_segments(uniq, _fails_on_marks, RetryPolicy(split_calls=48), batch_size=25).select(
        "text", "translated", "status")


_BY_ENGINE = ("CASE lang WHEN 'en' THEN 'gemini' WHEN 'fr' THEN 'sarvam' ELSE 'openai' END AS llm_provider, "
              "CASE lang WHEN 'es' THEN 'te' ELSE 'hi' END AS target_language")


def _named(name):
    return lambda texts, language: [f"{name} {language} {t}" for t in texts]


PACED = {
    "gemini": Engine(_named("gemini"), 25, RetryPolicy(gap=0.001, latency=0.004, in_flight=2)),
    "sarvam": Engine(_named("sarvam"), 25, RetryPolicy(gap=0.001)),
    "openai": Engine(_named("openai"), 20, RetryPolicy(in_flight=4)),
}


@query("translate_paced", f"""
SELECT DISTINCT llm_provider, target_language, text, llm_provider || ' ' || target_language || ' ' || text AS translated,
  'ok' AS status, 1 AS attempts
FROM (SELECT {_BY_ENGINE}, text FROM ({SEGS}))
""")
def translate_paced(spark, sf_dir):
    """Engines with a rate each, kept by all tasks together, and with several calls in flight."""
    segs = segment.segments(documents(spark, sf_dir), keep=["lang"])
    rows = segs.selectExpr(*_BY_ENGINE.split(", "), "text").distinct()
    return translate_by_engine(rows, PACED)


@query("plan_rates", f"""
SELECT llm_provider, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(requests) AS BIGINT) AS requests, CAST(1 AS BIGINT) AS lanes,
  CASE llm_provider WHEN 'openai' THEN 0e0 ELSE (sum(requests) - 1) * 0.001e0 END AS paced_s
FROM (SELECT llm_provider, count(*) AS n,
        ceil(count(*) / CASE llm_provider WHEN 'openai' THEN 20e0 ELSE 25e0 END) AS requests
      FROM (SELECT DISTINCT {_BY_ENGINE}, text FROM ({SEGS})) GROUP BY llm_provider, target_language)
GROUP BY llm_provider
""")
def rates(spark, sf_dir):
    """What one task an engine will send, and how long its gaps take."""
    segs = segment.segments(documents(spark, sf_dir), keep=["lang"])
    return plan_rates(segs.selectExpr(*_BY_ENGINE.split(", "), "text").distinct(), PACED, partitions=1)


_MEMORY = f"SELECT DISTINCT text, '[mem] ' || text AS translated FROM ({SEGS}) WHERE lang = 'en'"


def _memory(spark, sf_dir):
    known = segment.segments(documents(spark, sf_dir).where("lang = 'en'"))
    return known.select("text").distinct().withColumn("translated", F.concat(F.lit("[mem] "), "text"))


@query("apply_memory", f"""
SELECT s.doc_id, s.seg_no, s.text, m.translated FROM ({SEGS}) s LEFT JOIN ({_MEMORY}) m ON s.text = m.text
""")
def apply_memory(spark, sf_dir):
    """By the key of a line, with the lines that make up much of all spread over tasks."""
    segs = segment.segments(documents(spark, sf_dir)).select("doc_id", "seg_no", "text", segment_key("text").alias("seg_key"))
    known = _memory(spark, sf_dir).select(segment_key("text").alias("seg_key"), "translated")
    uses = segs.groupBy("seg_key").agg(F.count(F.lit(1)).alias("uses"))
    return memory.apply_memory(segs, known, ["seg_key"], hot=memory.hot_keys(uses, ["seg_key"])).drop("seg_key")


@query("reuse_memory", f"SELECT DISTINCT lang, text, '[' || lang || '] ' || text AS translated FROM ({SEGS})")
def reuse_memory(spark, sf_dir):
    """A memory filled in two runs: each language keeps its own texts, known ones are not asked
    for again, and what is written twice is read once."""
    path, key = work_dir(spark, "reused"), ["lang", "text"]
    uses = segment.segments(documents(spark, sf_dir), keep=["lang"]).select(*key).distinct()

    def engine(name):
        return Engine(lambda texts, lang: [
            f"[{lang}] {t}" if name == "first" or lang != "en" else "asked again" for t in texts])

    for name, part in (("first", uses.where("lang = 'en'")), ("second", uses), ("third", uses)):
        rows = part if name == "first" else memory.pending_segments(part, memory.read_memory(spark, path, key), key)
        rows = rows.withColumn("llm_provider", F.lit(name))
        done = translate_by_engine(rows, {name: engine(name)}, language_col="lang", spread=False).drop("llm_provider")
        memory.write_memory(done, path, key, new=True)
    spark.read.parquet(path).write.mode("append").option("compression", "zstd").parquet(path)  # another writer adds what is there
    return memory.read_memory(spark, path, key).select(*key, "translated")


@query("pending_segments", f"""
SELECT DISTINCT text FROM ({SEGS}) WHERE text NOT IN (SELECT text FROM ({_MEMORY}))
""")
def pending_segments(spark, sf_dir):
    segs = segment.segments(documents(spark, sf_dir))
    return memory.pending_segments(segs.select("text").distinct(), _memory(spark, sf_dir))


@query("apply_translations", f"""
SELECT s.doc_id, s.seg_no, coalesce(m.translated, s.text) AS translated
FROM ({SEGS}) s LEFT JOIN ({_MEMORY}) m ON s.text = m.text
""")
def apply_translations(spark, sf_dir):
    """Known texts are replaced, others stay. The threshold here is low, so that the test
    tables have lines that count as hot and take the spread path."""
    segs = segment.segments(documents(spark, sf_dir))
    uses = segs.groupBy("text").agg(F.count(F.lit(1)).alias("uses"))
    hot = memory.hot_keys(uses, min_uses=3)
    done = memory.apply_translations(segs, _memory(spark, sf_dir), hot=hot)
    return done.select("doc_id", "seg_no", "translated")


_RUNS = """
SELECT doc_id, seg_no, unnest(string_split(text, ', ')) AS piece,
       unnest(range(len(string_split(text, ', ')))) AS run_no FROM ({segs})
"""


@query("place_in_runs", f"""
WITH r AS (SELECT *, starts_with(piece, 'e') AS has_drawing FROM ({_RUNS.format(segs=SEGS)})),
w AS (SELECT *, min(CASE WHEN NOT has_drawing THEN run_no END) OVER (PARTITION BY doc_id, seg_no) AS first_text,
             max(run_no) OVER (PARTITION BY doc_id, seg_no) AS last_run FROM r)
SELECT doc_id, seg_no, run_no, CASE WHEN has_drawing THEN piece WHEN run_no = first_text
  THEN '[hi] ' || doc_id ELSE '' END AS text, has_drawing FROM w
UNION ALL
SELECT doc_id, seg_no, run_no + 1, '[hi] ' || doc_id, false FROM w WHERE first_text IS NULL AND run_no = last_run
""")
def place_in_runs(spark, sf_dir):
    """A paragraph cut into runs at commas; runs that start with e stand for drawings."""
    segs = segment.segments(documents(spark, sf_dir))
    runs = segs.select("doc_id", "seg_no", F.posexplode(F.split("text", ", ", -1)).alias("run_no", "text"))
    runs = runs.select(
        "doc_id", "seg_no", F.col("run_no").cast("long").alias("run_no"), "text",
        F.startswith("text", F.lit("e")).alias("has_drawing"),
        F.concat(F.lit("[hi] "), F.col("doc_id").cast("string")).alias("translated"))
    return memory.place_in_runs(runs, ["doc_id", "seg_no"])


# ------------------------------------------------------- batches of lines, prompts

_GROUPED = f"""
SELECT doc_id, batch_no, list(text ORDER BY pos) AS segments FROM ({_batches_sql(25)}) GROUP BY doc_id, batch_no
"""
# an answer that loses its second line and has a blank line at the front, in a fence
_ANSWER = """
'```' || chr(10) || chr(10) || array_to_string(list_transform(list_filter(segments, lambda x, i: i <> 2),
  lambda x: '[hi] ' || x), chr(10)) || chr(10) || '```'
"""


def _grouped(spark, sf_dir):
    rows = batch_segments(spark, sf_dir)
    batches = rows.groupBy("doc_id", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s"))
    return batches.select("doc_id", "batch_no", F.transform("s", lambda x: x["text"]).alias("segments"))


def _answered(spark, sf_dir):
    kept = F.filter("segments", lambda x, i: i != 1)
    said = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("[hi] "), x)), "\n")
    return _grouped(spark, sf_dir).withColumn(
        "response", F.concat(F.lit("```\n\n"), said, F.lit("\n```")))


@query("align_lines", f"""
WITH b AS (SELECT doc_id, batch_no, segments, {_ANSWER} AS response FROM ({_GROUPED})),
l AS (SELECT *, list_filter(string_split(response, chr(10)), lambda x: x <> '' AND x <> '```') AS got FROM b)
SELECT doc_id, batch_no, pos, segments[pos + 1] AS text, got[pos + 1] AS translated
FROM (SELECT *, unnest(range(least(len(segments), len(got)))) AS pos FROM l)
""")
def align(spark, sf_dir):
    return align_lines(_answered(spark, sf_dir), keys=("doc_id", "batch_no"))


@query("check_counts", f"""
SELECT doc_id, batch_no, len(segments) AS sent, len(segments) - CASE WHEN len(segments) > 1 THEN 1 ELSE 0 END
  AS returned, len(segments) = 1 AS aligned FROM ({_GROUPED})
""")
def counts(spark, sf_dir):
    from docloom.operators.quality import check_counts

    return check_counts(_answered(spark, sf_dir)).select("doc_id", "batch_no", "sent", "returned", "aligned")


@query("build_prompts", f"""
SELECT doc_id, batch_no, 'Translate each line into Hindi. Answer with exactly ' || len(segments)
  || ' lines, one for each input line, and nothing else.' || chr(10) || '---' || chr(10)
  || array_to_string(segments, chr(10)) || chr(10) || '---' || chr(10) AS prompt
FROM ({_GROUPED})
""")
def prompts(spark, sf_dir):
    batches = _grouped(spark, sf_dir).withColumn("language", F.lit("hi"))
    return build_prompts(batches, "language").select("doc_id", "batch_no", "prompt")


@query("review_prompts", f"""
SELECT doc_id, batch_no, 'Parts of this Hindi document may still be in the source language. '
  || CASE WHEN contains(joined, '__RTERM_') THEN 'Copy every __TERM_N__ and __BRACKET_N__ token into the answer unchanged.'
       || chr(10) ELSE '' END || 'Translate only those ' || n || ' lines and return them in order.' || chr(10)
  || '---' || chr(10) || joined || chr(10) || '---' || chr(10) AS prompt
FROM (SELECT doc_id, batch_no, len(segments) AS n,
        replace(array_to_string(segments, chr(10)), ' the ', ' __RTERM_0__ ') AS joined FROM ({_GROUPED}))
""")
def review_prompts(spark, sf_dir):
    """The review form of the prompt, with the token note where a term is hidden; a request
    without a language is one for Hindi."""
    batches = with_defaults(_grouped(spark, sf_dir).withColumn("target_language", F.lit(None).cast("string")))
    hidden = mask_terms(F.array_join("segments", "\n"), [" the "], prefix="R")
    marked = batches.withColumn("m", hidden).withColumn("term_map", F.col("m.term_map")).withColumn(
        "segments", F.split(F.replace(F.col("m.text"), F.lit("__RTERM_0__"), F.lit(" __RTERM_0__ ")), "\n"))
    return build_prompts(marked, "target_language", term_map="term_map", template=REVIEW_TEMPLATE).select(
        "doc_id", "batch_no", "prompt")


# ------------------------------------------------------------------- page chunks

_PAGE = "'<div class=\"page\"><p>' || text || '</p></div>'"
_PAGES = f"SELECT conv_id AS doc_id, turn AS page_no, {_PAGE} AS html FROM conversations"
_CHUNKS = f"""
SELECT doc_id, rn // 3 AS chunk_index, CAST(ceil(max(n) / 3.0) AS BIGINT) AS chunk_total,
       string_agg(html, '' ORDER BY rn) AS body, bool_or(contains(html, 'ç')) AS marked
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS rn,
             count(*) OVER (PARTITION BY doc_id) AS n FROM ({_PAGES}))
GROUP BY doc_id, rn // 3
"""


def pages_of(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"),
        F.concat(F.lit('<div class="page"><p>'), "text", F.lit("</p></div>")).alias("html"))


@query("plan_chunk_stream", f"""
SELECT doc_id, count(*) AS pages, CAST(ceil(count(*) / 3.0) AS BIGINT) AS requests,
  CAST((ceil(count(*) / 3.0) - 1) * 2 AS BIGINT) AS paced_s FROM ({_PAGES}) GROUP BY doc_id
""")
def chunk_stream_plan(spark, sf_dir):
    return plan_chunk_stream(pages_of(spark, sf_dir))


@query("chunk_pages", f"SELECT doc_id, chunk_index, chunk_total, body FROM ({_CHUNKS})")
def chunk_pages(spark, sf_dir):
    chunks = segment.chunk_pages(pages_of(spark, sf_dir))
    return chunks.select("doc_id", "chunk_index", "chunk_total", F.array_join("pages", "").alias("body"))


@query("chunk_pages_dense", f"SELECT doc_id, chunk_index, chunk_total, body FROM ({_CHUNKS})")
def chunk_pages_dense(spark, sf_dir):
    """The same where pages are known to be numbered without gaps: one shuffle of bodies."""
    chunks = segment.chunk_pages(pages_of(spark, sf_dir), dense=True)
    return chunks.select("doc_id", "chunk_index", "chunk_total", F.array_join("pages", "").alias("body"))


@query("wrap_chunk", f"""
SELECT doc_id, chunk_index, '{HTML_HEADER}' || body || '{HTML_FOOTER}' AS html FROM ({_CHUNKS})
""")
def wrap_chunk(spark, sf_dir):
    chunks = segment.wrap_chunk(segment.chunk_pages(pages_of(spark, sf_dir), dense=True))
    return chunks.select("doc_id", "chunk_index", "html")


def translate_page_html(html):
    """Stands in for a model on HTML; refuses pages with a ç."""
    if "ç" in html:
        raise ValueError("engine refused")
    return html.replace("<p>", "<p>[hi] ")


_TRANSLATED = f"""
SELECT doc_id, chunk_index, chunk_total, CASE WHEN marked THEN 'kept' ELSE 'ok' END AS status,
  CASE WHEN marked THEN body ELSE replace(body, '<p>', '<p>[hi] ') END AS html FROM ({_CHUNKS})
"""


def translated_chunks(spark, sf_dir):
    wrapped = segment.wrap_chunk(segment.chunk_pages(pages_of(spark, sf_dir), dense=True))
    return translate_chunks(
        wrapped.drop("pages"), translate_page_html).select(
        "doc_id", "chunk_index", "chunk_total", "status", "html")


@query("translate_chunks", _TRANSLATED)
def translate_chunk_rows(spark, sf_dir):
    """Failed chunks keep their original pages."""
    return translated_chunks(spark, sf_dir)


def _careful_model(html):
    if "GST" in html or "[[" in html or "L&amp;T" in html:
        raise ValueError("a protected term was sent")
    return html.replace("<p>", "<p>[hi] ")


_WITH_TERMS = "replace(replace({x}, ' the ', ' GST the L&amp;T '), ' de ', ' [[Note]] de ')"


@query("translate_chunks_masked", f"""
SELECT doc_id, chunk_index, 'ok' AS status, replace({_WITH_TERMS.format(x="body")}, '<p>', '<p>[hi] ') AS html FROM ({_CHUNKS})
""")
def translate_chunks_masked(spark, sf_dir):
    """Chunks with protected terms, plain and escaped, and kept passages: the model never sees them."""
    rows = pages_of(spark, sf_dir).withColumn("html", F.expr(_WITH_TERMS.format(x="html")))
    wrapped = segment.wrap_chunk(segment.chunk_pages(rows, dense=True)).drop("pages")
    return translate_chunks(wrapped, _careful_model, mask=True).select("doc_id", "chunk_index", "status", "html")


@query("assemble_document", f"""
SELECT doc_id, 0 AS part_no, 1 AS part_total,
  '{HTML_HEADER}' || string_agg(html, '' ORDER BY chunk_index) || '{HTML_FOOTER}' AS html
FROM ({_TRANSLATED}) GROUP BY doc_id
""")
def assemble_document(spark, sf_dir):
    return assemble_parts(translated_chunks(spark, sf_dir), "doc_id")


@query("assemble", f"""
SELECT doc_id, '{HTML_HEADER}' || string_agg('<p>' || text || '</p>', '' ORDER BY seg_no) || '{HTML_FOOTER}' AS html
FROM ({SEGS}) GROUP BY doc_id
""")
def assemble_rows(spark, sf_dir):
    segs = segment.segments(documents(spark, sf_dir)).select(
        "doc_id", "seg_no", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    return assemble(segs, "doc_id", "seg_no", header=HTML_HEADER, footer=HTML_FOOTER)
