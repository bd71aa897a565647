"""What the physical plans must and must not hold."""

import pytest

from docloom.plans import QUERIES, load_all

load_all()
CALLS = {  # the only queries with a Python stage: those that call a model
    "translate_html_google", "translate_segments", "translate_segments_masked", "translate_with_fallback",
    "translate_chunks", "translate_chunks_masked", "assemble_document", "review_pass", "evaluate", "evaluate_and_score",
    "evaluate_requests", "translate_paced", "translate_split_batches",
}
WRITERS = {"translate_corpus", "append_corrections", "write_results", "stream_chunks", "stream_progress", "stream_documents",
           "partial_preview", "stream_corrections", "stream_done_events", "translate_requests", "evaluate_fix_and_save",
           "reuse_memory", "stream_translate"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_plan(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas"):
        assert bad not in text, bad
    # one task only ever adds up partial sums, for the share of hot keys
    assert text.count("Exchange SinglePartition") == text.count("partial_sum(uses")
    assert ("MapInPandas" in text) == (name in CALLS)


@pytest.mark.parametrize("name", sorted(WRITERS))
def test_plan_of_what_is_read_back(spark, sf_dir, name):
    """Queries that write first: their last plan reads tables and calls nothing again."""
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in text, bad


def test_scans_read_only_what_is_needed(spark, sf_dir):
    text = plan(QUERIES["segments"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(QUERIES["distinct_segments_corpus"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filters_reach_the_scan(spark, sf_dir):
    from docloom.operators.segment import segments
    from docloom.sources.requests import read_table, spread

    docs = spread(read_table(spark, sf_dir, "documents")).where("lang = 'en'")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(segments(docs))


def test_dense_chunks_shuffle_bodies_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["chunk_pages_dense"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # bodies by (doc, block); totals by doc, then by (doc, block): none in front of the grouping
    assert text.count("Exchange hashpartitioning") == 3


def test_inputs_are_dealt_out_only_where_a_session_says_so(spark, sf_dir):
    from docloom.sources.requests import spread

    assert "RoundRobinPartitioning(8)" in plan(spread(spark.range(0, 10, 1, 1)))
    was = spark.conf.get("spark.docloom.spread")
    spark.conf.unset("spark.docloom.spread")
    try:
        assert "Exchange" not in plan(QUERIES["segments"](spark, sf_dir))
    finally:
        spark.conf.set("spark.docloom.spread", was)


def test_translated_lines_travel_as_keys(spark, sf_dir):
    """The segment side of the join carries ids, a key and blank lines, no text."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["translate_corpus"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [seg_key" in text and "__salt" in text
