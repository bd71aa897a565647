"""The model stages: batches, retries, fallbacks, memory, review."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import memory, quality, segment
from docloom.operators.memory import place_in_runs
from docloom.operators.policy import POLICIES, RetryPolicy
from docloom.operators.translate import (
    Engine, align_lines, build_prompts, translate_by_engine, translate_chunks, translate_segments,
)
from docloom.plans.common import prefix_hindi


def texts(spark, n):
    return spark.range(n).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))


class Flaky:
    """Fails a number of times, then answers."""

    def __init__(self, failures, message):
        self.failures, self.message, self.calls = failures, message, 0

    def __call__(self, *args):
        self.calls += 1
        if self.calls <= self.failures:
            raise RuntimeError(self.message)
        return "done"


def test_retry_waits_and_gives_up():
    waits = []
    policy = RetryPolicy(4, (10, 20, 30), ("429", "RESOURCE_EXHAUSTED"), sleep=waits.append)
    assert policy.call(Flaky(2, "429 slow down")) == ("done", 3)
    assert waits == [10, 20]
    waits.clear()
    with pytest.raises(RuntimeError) as e:
        policy.call(Flaky(9, "resource_exhausted"))
    assert waits == [10, 20, 30] and e.value.attempts == 4  # no wait after the last
    waits.clear()
    other = Flaky(9, "500")
    with pytest.raises(RuntimeError):
        policy.call(other)
    assert other.calls == 1 and not waits


def test_engine_policies():
    assert POLICIES["anthropic"].attempts == 3 and POLICIES["anthropic"].waits == (1, 2)
    assert POLICIES["sarvam"].on_error == "raise" and POLICIES["gemini"].on_error == "keep"
    assert POLICIES["openai"].attempts == POLICIES["indictrans2"].attempts == 1


def test_batches_are_bounded_and_cover_each_segment_once(spark):
    def spy(batch):
        assert 0 < len(batch) <= 7
        return [f"{t}|{len(batch)}" for t in batch]

    rows = translate_segments(texts(spark, 100), spy, batch_size=7).collect()
    assert sorted(r.text for r in rows) == sorted(r.text for r in texts(spark, 100).collect())
    assert all(r.status == "ok" and r.translated.startswith(r.text + "|") for r in rows)


def test_failed_batch_keeps_only_its_own_originals(spark):
    def fn(batch):
        if "line 5" in batch:
            raise ValueError("no")
        return prefix_hindi(batch)

    rows = translate_segments(texts(spark, 60), fn, batch_size=10).collect()
    kept = [r for r in rows if r.status == "kept"]
    assert 0 < len(kept) <= 10 and "line 5" in {r.text for r in kept}
    assert all(r.translated == r.text for r in kept)
    assert all(r.translated == "[hi] " + r.text for r in rows if r.status == "ok")


def test_wrong_line_count_is_not_paired(spark):
    rows = translate_segments(texts(spark, 30), lambda b: b[:-1], batch_size=5).collect()
    assert {r.status for r in rows} == {"misaligned"} and all(r.translated == r.text for r in rows)


def test_an_empty_answer_is_a_failure(spark):
    rows = translate_segments(texts(spark, 4), lambda b: [None] * len(b), batch_size=2).collect()
    assert {r.status for r in rows} == {"kept"} and all(r.translated == r.text for r in rows)


def test_errors_propagate_when_asked(spark):
    def fn(batch):
        raise ValueError("engine down")

    with pytest.raises(Exception, match="engine down"):
        translate_segments(texts(spark, 3), fn, RetryPolicy(on_error="raise")).collect()


def test_masked_text_never_reaches_the_model(spark):
    def fn(batch):
        assert not any("GST" in t or "[[" in t or "L&T" in t for t in batch)
        return [t[::1].replace("pay", "दें") for t in batch]

    df = spark.createDataFrame([("pay GST to L&T Finance [[A-1]]",), ("pay [[GST]] now",)], "text string")
    rows = {r.text: r for r in translate_segments(df, fn, mask=True).collect()}
    assert {r.status for r in rows.values()} == {"ok"}
    assert {r.translated for r in rows.values()} == {"दें GST to L&T Finance [[A-1]]", "दें [[GST]] now"}


def test_calls_use_the_partitions_asked_for(spark):
    """Adaptive execution must not merge the call stage into one task."""
    segs = texts(spark, 500).select("text").distinct()
    done = translate_segments(segs, prefix_hindi, partitions=6)
    tasks = done.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 6
    same = translate_segments(segs, prefix_hindi, partitions=8)
    assert same.select(F.spark_partition_id().alias("p")).distinct().count() == 8


def test_chunk_answers_are_unwrapped(spark):
    df = spark.createDataFrame(
        [(1, 0, "<html><body>a</body></html>"), (1, 1, "<html><body>b</body></html>"), (1, 2, "<html><body>c</body></html>")],
        "doc_id long, chunk_index long, html string")

    def fn(html):
        if ">b<" in html:
            raise ValueError("no")
        return "```html\n" + html.upper() + "\n```" if ">a<" in html else "plain"

    got = {r.chunk_index: (r.html, r.status) for r in translate_chunks(df, fn).collect()}
    assert got == {0: ("A", "ok"), 1: ("b", "kept"), 2: ("plain", "ok")}


def test_requests_never_mix_engines_or_languages(spark):
    def say(name, limit):
        def fn(batch, language):
            assert len(batch) <= limit and len({t.split()[0] for t in batch}) == 1
            assert all(t.startswith(f"{name}.{language} ") for t in batch)
            assert name == "b" or not any("GST" in t for t in batch)
            if name == "b" and language == "te":
                raise ValueError("no")
            return [f"{t}!{len(batch)}" for t in batch]
        return fn

    engines = {"a": Engine(say("a", 4), 4, mask=True), "b": Engine(say("b", 9), 9)}
    df = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("llm_provider"),
        F.when(F.col("id") % 3 == 0, "hi").otherwise("te").alias("target_language"), "id")
    df = df.withColumn("text", F.concat("llm_provider", F.lit("."), "target_language", F.lit(" GST "), F.col("id").cast("string")))
    rows = translate_by_engine(df, engines).collect()
    assert len(rows) == 200
    for r in rows:
        failed = (r.llm_provider, r.target_language) == ("b", "te")
        assert r.status == ("kept" if failed else "ok")
        assert r.translated == r.text if failed else r.translated.startswith(r.text + "!")


def test_chunks_in_their_own_language(spark):
    df = spark.createDataFrame([(1, 0, "x", "hi"), (2, 0, "x", "te")], "doc_id long, chunk_index long, html string, lang string")
    got = {r.doc_id: r.html for r in translate_chunks(df, lambda h, lang: h + lang, language="lang").collect()}
    assert got == {1: "xhi", 2: "xte"}


def test_align_lines(spark):
    rows = [(1, ["a", "b"], "x\ny"), (2, ["a", "b"], "x"), (3, ["a"], "x\ny\nz"), (4, ["a", "b"], "x\n\n y \r\n"),
            (5, ["a", "b"], "```\nx\ny\n```"), (6, ["a"], "")]
    df = spark.createDataFrame(rows, "batch_no int, segments array<string>, response string")
    got = {}
    for r in align_lines(df).orderBy("batch_no", "pos").collect():
        got.setdefault(r.batch_no, []).append((r.text, r.translated))
    both = [("a", "x"), ("b", "y")]
    assert got == {1: both, 2: [("a", "x")], 3: [("a", "x")], 4: both, 5: both}
    counts = {r.batch_no: (r.sent, r.returned, r.aligned) for r in quality.check_counts(df).collect()}
    assert counts[2] == (2, 1, False) and counts[3] == (1, 3, False) and counts[6] == (1, 0, False)


def test_prompts_note_only_with_masked_terms(spark):
    df = spark.createDataFrame(
        [(1, ["a {note}"], "hi", [("__TERM_0__", "x")]), (2, ["b"], "xx", [])],
        "id int, segments array<string>, lang string, m array<struct<token:string,original:string>>")
    got = [r.prompt for r in build_prompts(df, "lang", term_map="m").orderBy("id").collect()]
    assert "Hindi" in got[0] and "__TERM_N__" in got[0] and "a {note}" in got[0] and "exactly 1 lines" in got[0]
    assert "xx" in got[1] and "__TERM_N__" not in got[1]


def skewed(spark):
    """A third of all rows have one text, and some have none."""
    return spark.range(9000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same").when(F.col("id") % 100 == 1, None)
        .otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("text"))


def test_hot_text_is_spread_and_the_result_is_the_same(spark):
    segs = skewed(spark)
    table = segs.where("text IS NOT NULL AND text <> 't7'").select("text").distinct().withColumn(
        "translated", F.concat(F.lit("[hi] "), "text"))
    uses = segs.groupBy("text").agg(F.count(F.lit(1)).alias("uses"))
    hot = memory.hot_keys(uses, min_uses=1000)
    assert hot.count() == 1
    plain = memory.apply_memory(segs, table)
    spread = memory.apply_memory(segs, table, hot=hot)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, spread.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = memory.apply_memory(segs, table, hot=hot).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in rows) < 9000 / 3  # no task holds the hot text whole
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_list_is_bounded_by_share(spark, monkeypatch):
    counted = spark.range(1000).select(F.col("id").cast("string").alias("text"), F.lit(20).alias("uses"))
    assert memory.hot_keys(counted, min_uses=1).count() == 1000
    monkeypatch.setattr(memory, "MAX_HOT", 50)
    assert memory.hot_keys(counted, min_uses=1).count() == 0  # none has a fiftieth
    one = counted.unionAll(spark.createDataFrame([("big", 10_000)], "text string, uses int"))
    assert memory.hot_keys(one, min_uses=1).count() == 1


def test_written_memory_leaves_failures_pending(spark, tmp_path):
    def fn(batch):
        if "line 3" in batch:
            raise ValueError("no")
        return prefix_hindi(batch)

    done = translate_segments(texts(spark, 8), fn, batch_size=1)
    known = memory.write_memory(done, str(tmp_path / "memory"))
    assert known.count() == 7
    assert [r.text for r in memory.pending_segments(texts(spark, 8), known).collect()] == ["line 3"]
    placed = memory.apply_translations(texts(spark, 8), known)
    assert {r.translated for r in placed.collect()} == {
        "line 3", *(f"[hi] line {i}" for i in range(8) if i != 3)}


def test_drawings_stay_in_place(spark):
    rows = [(1, 0, "a", True, "T"), (1, 1, "b", False, "T"), (1, 2, "c", False, "T"),
            (2, 0, "d", True, "U"), (3, 0, "e", False, None)]
    df = spark.createDataFrame(rows, "p int, run_no int, text string, has_drawing boolean, translated string")
    got = {(r.p, r.run_no): r.text for r in place_in_runs(df, ["p"]).collect()}
    assert got == {(1, 0): "a", (1, 1): "T", (1, 2): "", (2, 0): "d", (2, 1): "U", (3, 0): "e"}


def test_review_takes_the_first_reviewer_that_answers(spark):
    df = spark.createDataFrame(
        [(1, "pay now", "pay now"), (2, "pay", "दें"), (3, "GST 12%", "GST 12%"), (4, "bad word", "bad word"),
         (5, "x", "मैं और hello"), (6, "worst", "worst")],
        "id int, text string, translated string")

    def first(batch):
        if "bad word" in batch or "worst" in batch:
            raise ValueError("no")
        return ["1:" + t for t in batch]

    def second(batch):
        if "worst" in batch:
            raise ValueError("no")
        return ["2:" + t for t in batch]

    got = {r.id: (r.translated, r.reviewed) for r in quality.review_pass(df, [first, second], batch_size=1).collect()}
    assert got == {1: ("1:pay now", True), 2: ("दें", False), 3: ("GST 12%", False), 4: ("2:bad word", True),
                   5: ("मैं और hello", False), 6: ("worst", False)}


def test_no_reviewer_changes_nothing(spark):
    df = spark.createDataFrame([(1, "pay", "pay")], "id int, text string, translated string")
    assert quality.review_pass(df, []).collect()[0].translated == "pay"


def test_segments_keep_order_and_documents_keep_blank_lines(spark):
    df = spark.createDataFrame([(1, " a \n\n\tb\n\xa0"), (2, "\n"), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.seg_no, r.text) for r in segment.segments(df).orderBy("doc_id", "seg_no").collect()]
    assert got == [(1, 0, "a"), (1, 2, "b")]
    assert segment.paragraphs(df).count() == 4 + 2 + 1


def test_review_keeps_languages_apart_and_hides_terms(spark):
    seen = []

    def reviewer(texts, language):
        if any("GST" in t or "[[" in t for t in texts):
            raise ValueError("a protected term was sent")
        return [f"{language}: {t} अंत" for t in texts]

    rows = [(1, "g", "hi", "pay the GST now", "pay the GST now"), (2, "g", "te", "pay the GST now", "pay the GST now"),
            (3, "o", "hi", "see [[Note]] here", "see [[Note]] here"), (4, "o", "hi", "fine", "ठीक"), (5, "o", "hi", "none", None)]
    df = spark.createDataFrame(rows, "id int, engine string, lang string, text string, translated string")
    got = {r.id: (r.translated, r.reviewed) for r in quality.review_pass(df, [reviewer], by=("engine", "lang")).collect()}
    assert got == {1: ("hi: pay the GST now अंत", True), 2: ("te: pay the GST now अंत", True),
                   3: ("hi: see [[Note]] here अंत", True), 4: ("ठीक", False), 5: (None, False)}
    assert seen == []


def test_symbols_go_out_as_glyphs(spark):
    seen = Engine(lambda texts, lang: ["ok" if "☑" in t else "not mapped" for t in texts], symbols=True)
    raw = Engine(lambda texts, lang: ["mapped" if "☑" in t else "ok" for t in texts])
    df = spark.createDataFrame([("s", "hi", "a \uf0a7"), ("r", "hi", "a \uf0a7")], "llm_provider string, target_language string, text string")
    assert {r.translated for r in translate_by_engine(df, {"s": seen, "r": raw}).collect()} == {"ok"}


def test_memory_is_safe_to_write_twice(spark, tmp_path):
    path, key = str(tmp_path / "m"), ["lang", "text"]
    rows = spark.createDataFrame([("hi", "a", "A", "ok"), ("te", "a", "B", "ok"), ("hi", "b", "b", "kept"), ("hi", "a", "A", "ok")],
                                 "lang string, text string, translated string, status string")
    for _ in range(2):
        known = memory.write_memory(rows, path, key)
        assert sorted((r.lang, r.text, r.translated) for r in known.collect()) == [("hi", "a", "A"), ("te", "a", "B")]
    assert spark.read.parquet(path).count() == 2
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert memory.read_memory(spark, path, key).count() == 2
    assert [r.text for r in memory.pending_segments(rows.select(*key).distinct(), known, key).collect()] == ["b"]


def test_a_fresh_memory_moves_no_text_again(spark, tmp_path):
    """F8, F9, F11: what was dealt out and folded by a shuffle is called, stored and read where it lies."""
    segs = texts(spark, 50).select("text").distinct()
    done = translate_segments(segs, prefix_hindi, spread=False)
    assert "REPARTITION_BY" not in (plan := done._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange") == segs._jdf.queryExecution().executedPlan().toString().count("Exchange")
    path = str(tmp_path / "m")
    known = memory.write_memory(done, path, new=True)
    assert "Exchange" not in known._jdf.queryExecution().executedPlan().toString()
    assert known.count() == segs.count()
    # files of a write that did not end count, so the next reader folds again
    os.remove(f"{path}/_SUCCESS")
    again = memory.write_memory(done, path, new=True)
    assert spark.read.parquet(path).count() == 2 * segs.count() and again.count() == segs.count()


def test_a_chunk_goes_through_python_once(spark):
    """the body that stands in for a failed answer is cut out after the call, and answers leave in pieces."""
    df = spark.range(0, 1000, 1, 1).selectExpr(
        "id AS doc_id", "0L AS chunk_index", "concat('<body><p>', id, '</p></body>') AS html")

    def model(html):
        if "9</p>" in html:
            raise ValueError("no")
        return html.replace("<p>", "<p>x")

    done = translate_chunks(df, model, spread=False)
    assert "__original" not in done._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.html, r.status) for r in done.collect()}
    assert got == {i: (f"<p>{i}</p>", "kept") if i % 10 == 9 else (f"<p>x{i}</p>", "ok") for i in range(1000)}


class Clock:
    """Writes down the waits of a task where the test can read them."""

    def __init__(self, path):
        self.path = path

    def __call__(self, seconds):
        with open(self.path, "a") as f:
            f.write(f"{seconds}\n")


def test_every_call_stage_keeps_the_pace(spark, tmp_path):
    from docloom.operators import review
    from docloom.operators.translate import translate_html

    def waits(run):
        path = tmp_path / f"waits{len(list(tmp_path.iterdir()))}"
        path.touch()
        run(RetryPolicy(gap=7, sleep=Clock(str(path)))).collect()
        return path.read_text().split()

    texts = spark.createDataFrame([(f"line {k}", "hi", k) for k in range(4)], "text string, lang string, doc_id long")
    chunks = texts.selectExpr("doc_id", "0L AS chunk_index", "concat('<body>', text, '</body>') AS html", "lang")
    pairs = texts.selectExpr("text AS original_text", "text AS translated_text", "lang AS target_language")
    assert waits(lambda p: translate_segments(texts, list, p, batch_size=1, partitions=1)) == ["7"] * 3
    assert waits(lambda p: translate_chunks(chunks, str, p, partitions=1)) == ["7"] * 3
    assert waits(lambda p: review.evaluate(pairs, lambda o, t, lang: "{}", policy=p, partitions=1)) == ["7"] * 3
    assert waits(lambda p: translate_html(chunks, Engine(lambda h, lang: h, policy=p), language="lang", partitions=1)) == ["7"] * 3


def test_equal_pairs_are_judged_once_and_errors_can_stop(spark, tmp_path):
    from docloom.operators import review

    log = tmp_path / "calls"
    log.touch()

    def judge(original, translated, language):
        with open(log, "a") as f:
            f.write("call\n")
        if original == "bad":
            raise ValueError("no")
        return '{"score": 9}'

    rows = spark.createDataFrame([("a", "b", "hi")] * 200 + [("c", None, "hi")], "original_text string, translated_text string, target_language string")
    assert {r.raw for r in review.evaluate(rows, judge).collect()} == {'{"score": 9}'} and review.evaluate(rows, judge).count() == 201
    log.write_text("")
    assert len(review.evaluate(rows, judge).collect()) == 201
    assert log.read_text().split() == ["call"] * 2
    bad = spark.createDataFrame([("bad", "b", "hi")], rows.schema)
    assert '"score": 0' in review.evaluate(bad, judge).collect()[0].raw
    with pytest.raises(Exception, match="no"):
        review.evaluate(bad, judge, policy=RetryPolicy(on_error="raise")).collect()


def test_dense_chunks_check_their_pages(spark):
    from docloom.operators.segment import chunk_pages, paragraphs

    def pages(numbers):
        return spark.createDataFrame([(1, n, f"<p>{n}</p>") for n in numbers], "doc_id long, page_no long, html string")

    assert chunk_pages(pages(range(7)), dense=True).count() == 3
    for bad in ([0, 1, 5, 9], [0, 0, 2], [0, 1, 2, 6, 7, 8], [0, 0, 3, 3], [1, 2, 3]):
        with pytest.raises(Exception, match="document 1"):
            chunk_pages(pages(bad), dense=True).collect()
        assert chunk_pages(pages(sorted(set(bad)))).count() == -(-len(set(bad)) // 3)
    empty = spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string")
    assert {r.doc_id for r in paragraphs(empty).collect()} == {1, 2}


def test_cells_without_an_id_never_merge(spark):
    from docloom.operators.layout import cell_spans

    rows = [(1, 0, 0, None), (1, 0, 1, None), (1, 0, 2, "a"), (1, 1, 0, None), (1, 1, 1, "b"), (1, 1, 2, "a"), (1, 2, 1, "b")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "t int, row_no long, col_no long, cell_id string, grid_span int, text string")
    got = sorted((r.row_no, r.col_no, r.rowspan) for r in cell_spans(df, ["t"]).collect())
    assert got == [(0, 0, 1), (0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 1, 2)]


def test_html_route_puts_styles_and_images_back(spark):
    from docloom.operators.translate import translate_html

    html = "<style>p{}</style><img src='data:image/png;base64,xyz'><p>the L&T isn't</p>"

    def engine(texts, language):
        assert "p{}" not in texts[0] and "xyz" not in texts[0]
        return [texts[0].replace("the", language).replace("'t", "&#39;t")]

    df = spark.createDataFrame([(1, html, "hi"), (2, "<p>the bad</p>", "te")], "id int, html string, target_language string")
    got = {r.id: (r.translated, r.status) for r in translate_html(df, Engine(engine)).collect()}
    assert got == {1: (html.replace("the", "hi"), "ok"), 2: ("<p>te bad</p>", "ok")}
