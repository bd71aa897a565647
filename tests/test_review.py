"""Structure, review answers and corrections."""

from pyspark.sql import functions as F

from docloom.operators import html as H
from docloom.operators import quality, review
from docloom.sources import corrections as C
from docloom.sources import events as E


def fixed(spark, html, snippet, fix):
    df = spark.createDataFrame([(html, [(snippet, fix, "r")])],
                               "html string, corrections array<struct<incorrect_snippet:string,suggested_fix:string,reason:string>>")
    r = review.apply_fixes(df).collect()[0]
    return r.fixed_html, r.outcome[0]


def test_exact_fix_is_literal_and_first_only(spark):
    assert fixed(spark, "a.b a.b", "a.b", "$&\\1$") == ("$&\\1$ a.b", "exact")


def test_fuzzy_fix_spans_tags_and_blanks(spark):
    # two blanks in the snippet need two in the text
    assert fixed(spark, "<p>go<b>od</b>&nbsp; day</p><p>good day</p>x", "good  day", "B$1") == (
        "<p>B$1</p><p>good day</p>x", "fuzzy")
    assert fixed(spark, "<p>good day</p>x", "good  day", "B$1")[1] == "unmatched"
    assert fixed(spark, "<p>go<b>od</b>&nbsp;\n<i>day</i></p>", "good day", "B$1\\") == ("<p>B$1\\</i></p>", "fuzzy")
    assert fixed(spark, "a<b>+</b>(c)*, a<i>+(c)*</i>", "a+(c)*", "R") == ("R, R</i>", "fuzzy")


def test_fuzzy_needs_plain_or_whole_tag_snippets(spark):
    assert fixed(spark, "a <b> c", "a<b>c", "x") == ("a <b> c", "unmatched")
    assert fixed(spark, "ab", "", "x")[1] == "ignored"
    assert fixed(spark, "ab", "a", None)[1] == "ignored"


def test_fixes_fold_in_order(spark):
    df = spark.createDataFrame(
        [("one two", [("one", "two", "r"), ("two", "three", "r"), ("nine", "x", "r")]), ("q", None)],
        "html string, corrections array<struct<incorrect_snippet:string,suggested_fix:string,reason:string>>")
    done = review.apply_fixes(df)
    rows = {r.html: r for r in done.collect()}
    assert rows["one two"].fixed_html == "three two" and rows["q"].fixed_html == "q"
    left = review.unmatched_fixes(done, ["html"]).collect()
    assert [(r.pos, r.incorrect_snippet) for r in left] == [(2, "nine")]


def test_reviews_parse_or_fall_back(spark):
    rows = [(1, '{"score": 8, "issues": ["a"]}'), (2, '```json\n{"score": 7.5}\n```'), (3, '{"score": 8'), (4, "[1]"),
            (5, None), (6, '{"score": "9", "corrections": null}'), (7, '{"score": 3} tail'), (8, "```"),
            (9, '{"score": 0, "error": "e", "suggestion": "s"}')]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = {r.id: r for r in review.parse_reviews(df).collect()}
    assert {k: r.score for k, r in got.items()} == {1: 8, 2: 7.5, 3: 0, 4: 0, 5: 0, 6: 9, 7: 0, 8: 0, 9: 0}
    assert got[1].issues == ["a"] and got[1].error is None and got[3].error and got[9].error == "e"
    assert review.explode_issues(review.parse_reviews(df), ["id"]).count() == 1


def test_score_bands(spark):
    df = spark.createDataFrame([(s,) for s in (10, 8, 7, 5, 4, 0)], "score int")
    assert [r.b for r in df.select(review.score_band().alias("b")).collect()] == [
        "good", "good", "fair", "fair", "poor", "poor"]


def test_structure_damage(spark):
    a = '<table><tr><td class="x">a</td></tr></table>'
    rows = [(1, a, a.replace(">a<", ">b<")), (2, a, a.replace("<td class=\"x\">a</td>", "")),
            (3, a, a.replace('"x"', '"y"')), (4, a, a.replace("</tr>", "</tr><tr></tr>"))]
    df = spark.createDataFrame(rows, "id int, original_html string, html string")
    got = {r.id: (r.same_tags, r.same_rows, r.same_cells, r.same_attributes)
           for r in quality.check_structure(df).collect()}
    assert got == {1: (True,) * 4, 2: (False, True, False, False), 3: (True, True, True, False),
                   4: (False, False, True, True)}


def test_preserved_counts_repeats(spark):
    rows = [("GST 5% ☑ ☑", "GST 5% ☑ ☑ और"), ("GST 5% ☑ ☑", "5% ☑"), ("L&T Finance 1,00,000", "एल 1,00,000"),
            ("12/03/2024 [[A]]", "[[A]] 12/03/2024")]
    df = spark.createDataFrame(rows, "text string, translated string")
    got = [(r.preserved, sorted(r.lost)) for r in quality.check_preserved(df).collect()]
    assert got == [(True, []), (False, sorted(["GST", "☑"])), (False, ["L&T Finance"]), (True, [])]


def runs(spark, raw):
    df = spark.createDataFrame([(1, raw)], "b int, raw string")
    return [(r.text, "".join(k for k, v in (("b", r.bold), ("i", r.italic), ("u", r.underline)) if v))
            for r in H.inline_runs(df, ["b"]).orderBy("run_no").collect()]


def test_inline_runs(spark):
    assert runs(spark, "a<b>x<i>y</i></b>z") == [("a", ""), ("xy", "b"), ("z", "")]
    assert runs(spark, "<b>x<b>y</b>z</b>w") == [("xyz", "b"), ("w", "")]
    assert runs(spark, "<b>x</i>y</b>z") == [("xy", "b"), ("z", "")]
    assert runs(spark, "a<br>b<u>c<br/>d</u>") == [("a", ""), ("\n", ""), ("b", ""), ("cd", "u")]
    assert runs(spark, '<span style="font-weight: bold; font-style: italic">s</span><a>&amp;</a></b>') == [
        ("s", "bi"), ("&", "")]
    assert runs(spark, "1 < 2<em>open") == [("1 ", ""), ("<", ""), (" 2", ""), ("open", "i")]


def test_inline_runs_of_a_long_block(spark):
    """Many groups of tokens, a run that goes on over all of them, and the mark in the text."""
    assert runs(spark, "a\x01\x02<b>" + "x<i>y</i>" * 1000) == [("a\x01\x02", ""), ("xy" * 1000, "b")]
    assert runs(spark, "<u>p</u>q" * 700) == [("p", "u"), ("q", "")] * 700
    assert runs(spark, "") == []


def test_unclosed_paragraphs_and_scripts(spark):
    page = '<body><script>var t="</p>"</script><p>one<p>two &lt;b&gt;<img src="i.png"><ul><li>x</ul><h2>H<br>2</h2>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = [(r.kind, r.level, r.text) for r in H.html_blocks(df).orderBy("block_no").collect()]
    assert got == [("p", None, "one"), ("p", None, "two <b>"), ("img", None, "i.png"), ("li", None, "x"),
                   ("h2", 2, "H\n2")]


def test_header_and_footer_are_apart(spark):
    page = '<div class="docx-footer"><p>f</p></div><div class="docx-header"><p>h</p></div><p>b</p>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = [(r.section, r.text) for r in H.html_blocks(df).orderBy("block_no").collect()]
    assert got == [("header", "h"), ("footer", "f"), ("body", "b")]


def test_ragged_and_nested_tables(spark):
    t = "<table><tr><td>a<td>b</tr><tr><th>c</th></tr></table>"
    n = "<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</td></tr></table>"
    df = spark.createDataFrame([(1, t + "<p>-</p>" + n), (2, "no table"), (3, "<table></table>")], "doc_id long, html string")
    got = [(r.doc_id, r.table_no, r.row_no, r.col_no, r.kind, r.text, r.n_cols)
           for r in H.table_cells(df).orderBy("doc_id", "table_no", "row_no", "col_no").collect()]
    assert got == [(1, 0, 0, 0, "td", "a", 2), (1, 0, 0, 1, "td", "b", 2), (1, 0, 1, 0, "th", "c", 2),
                   (1, 1, 0, 0, "td", "xiny", 2), (1, 1, 0, 1, "td", "z", 2)]


def test_long_tables_stay_in_their_row(spark):
    """More tags than one group of the fold holds, rows without cells, many tables, stray tags, one id twice."""
    rows = "".join(f"<tr><td>{k}<td>{k}\x01x{'<th>h</th>' * (k % 3)}</tr><tr></tr>" for k in range(1500))
    many = "</table>" + "<table><tr></tr></table>".join(f"<table><tr><td>{k}</td></tr></table>after" for k in range(300))
    df = spark.createDataFrame([(1, f"<table>{rows}</table>"), (1, many.replace("</table>", "", 1)), (2, many)], "doc_id long, html string")
    cells = H.table_cells(df)
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    got = cells.where("doc_id = 1 and n_cols > 1").orderBy("row_no", "col_no").collect()
    want = [(k, c, t) for k in range(1500) for c, t in enumerate([str(k), f"{k}\x01x", *["h"] * (k % 3)])]
    assert [(r.row_no, r.col_no, r.text) for r in got] == want and {r.n_cols for r in got} == {4}
    single = cells.where("doc_id = 1 and n_cols = 1").orderBy("table_no").collect()
    assert [(r.table_no, r.text) for r in single] == [(2 * k, str(k)) for k in range(300)]
    assert cells.where("doc_id = 2").count() == 0  # closed before it was opened: never at depth one again


def test_result_violations(spark):
    long = "x" * 101
    rows = [(long, "o", "hi", "QUJD"), ("short", "short", None, ""), (long, "o", "hi", None)]
    df = spark.createDataFrame(rows, "html string, original_html string, language string, pdf string")
    got = [r.violations for r in quality.check_result(df, encoded=("pdf",)).collect()]
    assert got == [[], ["missing language", "html too short", "html unchanged", "pdf does not decode"], []]


def test_event_order(spark):
    def chunk(i):
        return f'data: {{"type": "chunk", "index": {i}, "html": "h"}}'

    end = 'data: {"type":"done","html":"h","original_html":"o","language":"hi","provider":"p"}'
    streams = {1: [chunk(0), ": keep-alive", "", chunk(1), end], 2: [chunk(0), chunk(2), end], 3: [chunk(0), end, end],
               4: [end.replace('"language":"hi",', ""), chunk(0)], 5: [chunk(0)]}
    rows = [(d, i, line) for d, lines in streams.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, value string")
    got = {r.doc_id: (r.chunks, r.contiguous, r.one_done, r.done_last, r.keys_present)
           for r in E.check_event_order(E.parse_event_log(df)).collect()}
    assert got == {1: (2, True, True, True, True), 2: (2, False, True, True, True), 3: (1, True, False, True, True),
                   4: (1, True, True, False, False), 5: (1, True, False, False, False)}


def test_correction_lines_are_plain_utf8(spark, tmp_path):
    df = spark.createDataFrame([("ओ\n\"q\"", "t", "c", "hi", None)],
                               "original_text string, translated_text string, corrected_text string, target_language string, provider string")
    path = str(tmp_path / "c")
    C.append_corrections(C.correction_entries(df), path)
    line = spark.read.text(path).collect()[0].value
    assert "ओ" in line and '"provider":null' in line
    back = C.read_corrections(spark, path).collect()[0]
    assert back.original_text == "ओ\n\"q\"" and len(back.entry_id) == 32 and back.saved_at is not None
    assert C.training_pairs(C.read_corrections(spark, path)).count() == 1


def test_stored_corrections_are_compressed(spark, tmp_path):
    """an entry holds its text three times."""
    df = spark.range(200).selectExpr("repeat(concat('word ', id, ' '), 100) AS t").selectExpr(
        "t AS original_text", "t AS translated_text", "t AS corrected_text", "'hi' AS target_language", "'p' AS provider")
    path = tmp_path / "c"
    for _ in range(2):
        C.append_corrections(C.correction_entries(df), str(path))
    assert sum(f.stat().st_size for f in path.rglob("part-*")) < 100_000  # over 600,000 as they are
    back = C.read_corrections(spark, str(path))
    assert back.count() == 400 and back.select("original_text").distinct().count() == 200


def test_missed_words_are_found_by_a_look_at_a_character_first(spark):
    """what is set aside is tried only where it can begin; it is set aside as before."""
    from docloom.operators.quality import is_missed

    rows = [("a", "<b>क</b> __TERM_0__ क", False), ("a", "STYLE_PLACEHOLDER_1 क IMG_PLACEHOLDER_2", False), ("a", "[[some words here]] क", False),
            ("a", "1,000.5% Ltd. GST क", False), ("a", "ab क cd", True), ("12", "12", False), ("ab", "ab", True), ("a", "xx yy [ < 1 क", True)]
    df = spark.createDataFrame([(o, t) for o, t, _ in rows], "o string, t string")
    missed = df.select("t", is_missed("o", "t").alias("m"))
    assert {r.t: r.m for r in missed.collect()} == {t: m for _, t, m in rows}
    assert "(?=[<_" in missed._jdf.queryExecution().analyzed().toString()
