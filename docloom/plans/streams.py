"""Streaming queries. Each runs until its input is used up and returns its end state."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.fixed import HTML_FOOTER, HTML_HEADER, PREVIEW_HEADER
from docloom.operators import segment
from docloom.plans.common import PROVIDER, SEGS, TARGET, documents, prefix_hindi
from docloom.plans.corpus import _CHUNKS, _TRANSLATED, pages_of, translate_page_html
from docloom.plans.registry import query
from docloom.plans.storage import _ENTRIES, _STORED, saved_corrections
from docloom.session import work_dir
from docloom.sources import corrections as C
from docloom.streaming import chunks as S
from docloom.streaming.segments import write_translations

# the last chunk of a conversation never arrives where its text holds these letters
_LOST = "contains(body, 'Ét') AND chunk_index = chunk_total - 1"


def _chunk_files(spark, sf_dir):
    """Chunks of all conversations as files a stream can read; every first chunk twice."""
    path = work_dir(spark, "chunk-input")
    wrapped = segment.wrap_chunk(segment.chunk_pages(pages_of(spark, sf_dir), dense=True))
    rows = wrapped.withColumn("body", F.array_join("pages", "")).where(f"NOT ({_LOST})").select(
        "doc_id", "chunk_index", "chunk_total", "html")
    again = rows.where("chunk_index = 0")
    rows.unionAll(again).repartition(4, F.xxhash64("doc_id", "chunk_index")).write.parquet(path)
    return path


def _run(spark, sf_dir):
    """Translate the stream into the chunk table; returns its path."""
    table = work_dir(spark, "chunks")
    source = S.read_chunk_stream(spark, _chunk_files(spark, sf_dir), files_per_trigger=2)
    S.run_to_end(S.write_chunks(
        S.stream_chunks(source, translate_page_html), table, work_dir(spark, "chunks-checkpoint")))
    return table


def _track_files(spark, table):
    path = work_dir(spark, "progress")
    arrived = S.read_chunk_stream(spark, table, schema=S.TABLE_SCHEMA, bytes_per_trigger=1 << 28)
    S.run_to_end(S.write_progress(S.track_arrivals(arrived), path, work_dir(spark, "progress-checkpoint")))
    return path


def _track(spark, table):
    return spark.read.schema(S.PROGRESS_SCHEMA).parquet(_track_files(spark, table))


_ARRIVED = f"SELECT t.* FROM ({_TRANSLATED}) t JOIN (SELECT doc_id, chunk_index FROM ({_CHUNKS}) WHERE NOT ({_LOST})) USING (doc_id, chunk_index)"
_TWICE = f"SELECT * FROM ({_ARRIVED}) UNION ALL SELECT * FROM ({_ARRIVED}) WHERE chunk_index = 0"


@query("stream_chunks", f"SELECT doc_id, chunk_index, chunk_total, status, html, chunk_index + 1 AS done FROM ({_TWICE})")
def stream_chunks(spark, sf_dir):
    table = spark.read.parquet(_run(spark, sf_dir))
    return table.select("doc_id", "chunk_index", "chunk_total", "status", "html", "done")


@query("stream_progress", f"""
SELECT doc_id, count(*) AS done, max(chunk_total) AS total FROM ({_ARRIVED}) GROUP BY doc_id
""")
def stream_progress(spark, sf_dir):
    """Repeated chunks count once."""
    return S.latest_progress(_track(spark, _run(spark, sf_dir))).select("doc_id", "done", "total")


@query("stream_documents", f"""
SELECT doc_id, 0 AS part_no, 1 AS part_total,
  '{HTML_HEADER}' || string_agg(html, '' ORDER BY chunk_index) || '{HTML_FOOTER}' AS html
FROM ({_ARRIVED}) GROUP BY doc_id HAVING count(*) = max(chunk_total)
""")
def stream_documents(spark, sf_dir):
    """Only complete documents come out."""
    path = _run(spark, sf_dir)
    progress = _track(spark, path)
    return S.finished_documents(spark.read.parquet(path), progress)


@query("stream_done_events", f"""
SELECT doc_id, 'done' AS type, 0 AS part_no, 1 AS part_total,
  '{HTML_HEADER}' || string_agg(html, '' ORDER BY chunk_index) || '{HTML_FOOTER}' AS html,
  'conversation ' || doc_id AS original_html, 'hi' AS language, 'gemini' AS provider,
  CAST(NULL AS VARCHAR) AS translated_pdf_b64
FROM ({_ARRIVED}) GROUP BY doc_id HAVING count(*) = max(chunk_total)
""")
def stream_done_events(spark, sf_dir):
    """Each finished document once, as a stream over the progress rows."""
    table = _run(spark, sf_dir)
    originals = pages_of(spark, sf_dir).select("doc_id").distinct().selectExpr(
        "doc_id", "concat('conversation ', doc_id) AS original_html", "'hi' AS language", "'gemini' AS provider")
    path = work_dir(spark, "done")
    done = S.track_done(S.read_progress_stream(spark, _track_files(spark, table), bytes_per_trigger=1 << 28))
    S.run_to_end(S.write_done(done, table, originals, path, work_dir(spark, "done-checkpoint")))
    return spark.read.parquet(path).drop("batch_id")


@query("partial_preview", f"""
SELECT doc_id, 0 AS part_no, 1 AS part_total,
  '{PREVIEW_HEADER}' || string_agg(html, '' ORDER BY chunk_index) || '{HTML_FOOTER}' AS html
FROM ({_ARRIVED}) GROUP BY doc_id
""")
def partial_preview(spark, sf_dir):
    return S.partial_preview(spark.read.parquet(_run(spark, sf_dir)))


@query("stream_translate", f"SELECT doc_id, seg_no, text, '[hi] ' || text AS translated FROM ({SEGS})")
def stream_translate(spark, sf_dir):
    """All lines as a stream over a memory: a line that an earlier trigger brought is not asked for again."""
    source, out, known = (work_dir(spark, n) for n in ("documents-input", "stream-translated", "stream-memory"))
    documents(spark, sf_dir).select("doc_id", "text").write.option("compression", "zstd").parquet(source)
    half = max(1, len(spark.read.parquet(source).inputFiles()) // 2)
    docs = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", half).parquet(source)
    S.run_to_end(write_translations(segment.segments(docs), prefix_hindi, known, out, work_dir(spark, "stream-translate-checkpoint")))
    return spark.read.parquet(out).drop("batch_id")


@query("stream_corrections", _ENTRIES)
def stream_corrections(spark, sf_dir):
    """The documents table itself is the stream, be it one file or a folder of files."""
    path = work_dir(spark, "stream-corrections")
    docs = (
        spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long")
        .parquet(f"{sf_dir}/documents[.]parquet")  # a pattern: a stream takes no path of one file
        .selectExpr("doc_id", "text", "lang", f"{TARGET} AS target_language", f"{PROVIDER} AS llm_provider"))
    entries = C.correction_entries(saved_corrections(docs))
    S.run_to_end(S.write_corrections(entries, path, work_dir(spark, "stream-corrections-checkpoint")))
    return C.read_corrections(spark, path).select(*_STORED)
