"""Quality checks of translations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docloom.functions.fixed import CHECK_GLYPHS, PROTECTED_TERMS
from docloom.operators import quality
from docloom.operators.segment import segments
from docloom.plans.common import SEGS, documents, pages
from docloom.plans.registry import query

# translations of different quality: none, none in every second line, all letters, a few
_TRANSLATED = (
    "CASE lang WHEN 'en' THEN translate(text, 'aeiou', 'अएइओउ') WHEN 'fr' THEN text "
    "WHEN 'de' THEN concat('अनुवाद __TERM_3__ [[Key Word]] GST 12/03 ', substr(text, 1, 0), 'समाप्त') "
    "ELSE concat('एक दो तीन ', text) END"
)
_TERMS = "|".join(re.escape(t) for t in PROTECTED_TERMS)
_BARE = f"regexp_replace(translated, '<[^>]*>|{quality.TOKEN}|{_TERMS}|{quality.NUMBER}', ' ', 'g')"
_JUDGED = f"""
SELECT *, len(words) > 0 AND (text = translated OR
  len(list_filter(words, lambda w: regexp_full_match(w, '\\p{{Latin}}+'))) / len(words) > 0.5) AS missed
FROM (SELECT *, regexp_extract_all({_BARE}, '[\\p{{L}}\\p{{M}}]+') AS words
      FROM (SELECT doc_id, seg_no, text, {_TRANSLATED} AS translated FROM ({SEGS})))
"""


def _translated(spark, sf_dir):
    segs = segments(documents(spark, sf_dir), keep=["lang"])
    return segs.selectExpr("doc_id", "seg_no", "text", f"{_TRANSLATED} AS translated")


@query("missed_segments", f"SELECT doc_id, seg_no, text, translated FROM ({_JUDGED}) WHERE missed")
def missed_segments(spark, sf_dir):
    return quality.missed_segments(_translated(spark, sf_dir))


def _reviewer_down(texts):
    if any("é" in t for t in texts):
        raise ValueError("reviewer refused")
    return ["[r1] " + t for t in texts]


def _reviewer_spare(texts):
    if any("ñ" in t for t in texts):
        raise ValueError("reviewer refused")
    return ["[r2] " + t for t in texts]


@query("review_pass", f"""
SELECT doc_id, seg_no, CASE WHEN NOT missed THEN translated WHEN NOT contains(translated, 'é')
    THEN '[r1] ' || translated WHEN NOT contains(translated, 'ñ') THEN '[r2] ' || translated ELSE translated END
    AS translated,
  missed AND NOT (contains(translated, 'é') AND contains(translated, 'ñ')) AS reviewed
FROM ({_JUDGED})
""")
def review_pass(spark, sf_dir):
    """Missed segments go to the first reviewer that answers. One segment a call, so the
    outcome does not depend on who shares a batch; a low threshold takes the spread join."""
    done = quality.review_pass(
        _translated(spark, sf_dir), [_reviewer_down, _reviewer_spare], batch_size=1, min_hot_uses=3)
    return done.select("doc_id", "seg_no", "translated", "reviewed")


# damage to pages: a list item lost, a class renamed, a cell and a row added, or none
_DAMAGED = (
    "CASE WHEN contains(html, 'lang=\"fr\"') THEN replace(html, '<li>', '') "
    "WHEN contains(html, 'lang=\"de\"') THEN replace(html, 'class=\"ad\"', 'class=\"AD\"') "
    "WHEN contains(html, 'lang=\"es\"') THEN replace(html, '<article>', '<article><table><tr><td>x</td></tr></table>') "
    "ELSE replace(html, 'the', 'THE') END"
)
_TAGS = "lower(array_to_string(regexp_extract_all({x}, '(?i)</?[a-z][a-z0-9]*'), ' '))"
_ATTRS = "array_to_string(regexp_extract_all({x}, '(?i)\\s(?:class|id|style|src)=(?:\"[^\"]*\"|''[^'']*'')'), chr(10))"
_COUNT = "len(regexp_extract_all({x}, '(?i)<{tag}[\\s/>]'))"


def _equal(expr: str, **kw) -> str:
    return f"{expr.format(x='original_html', **kw)} = {expr.format(x='html', **kw)}"


@query("check_structure", f"""
SELECT page_id, {_equal(_TAGS)} AS same_tags, {_equal(_COUNT, tag="tr")} AS same_rows,
  {_equal(_COUNT, tag="td")} AS same_cells, {_equal(_ATTRS)} AS same_attributes
FROM (SELECT page_id, html AS original_html, {_DAMAGED} AS html FROM pages)
""")
def check_structure(spark, sf_dir):
    html = pages(spark, sf_dir).selectExpr(
        "page_id", "html AS original_html", f"{_DAMAGED} AS html")
    return quality.check_structure(html).drop("html", "original_html")


# tokens put into the lines, and a translation that loses or changes some
_TOKENS = (
    "concat(replace(replace(text, ' the ', ' 12/03/2024 '), ' que ', ' [[Id]] 5% '), "
    "CASE WHEN contains(text, 'und') THEN ' ☑ GST ☑' ELSE '' END)"
)
_LOSSY = (
    "CASE WHEN length(text) > 250 THEN replace(tokened, '2024', '2025') "
    "WHEN length(text) > 150 THEN replace(tokened, ' GST ☑', '') ELSE concat('नया ', tokened) END"
)


def _held(x: str) -> str:
    return f"list_sort(regexp_extract_all({x}, '{quality.TOKEN}|{_TERMS}|{quality.NUMBER}|[{CHECK_GLYPHS}]'))"


@query("check_preserved", f"""
WITH t AS (SELECT doc_id, seg_no, text, {_TOKENS} AS tokened
           FROM ({SEGS})),
p AS (SELECT doc_id, seg_no, {_held("tokened")} AS o, {_held(f"({_LOSSY})")} AS n FROM t)
SELECT doc_id, seg_no, o = n AS preserved,
  array_to_string(list_sort(list_filter(list_distinct(o), lambda x:
    len(list_filter(o, lambda y: y = x)) > len(list_filter(n, lambda y: y = x)))), ' ') AS lost
FROM p
""")
def check_preserved(spark, sf_dir):
    pairs = segments(documents(spark, sf_dir)).selectExpr("doc_id", "seg_no", "text", f"{_TOKENS} AS tokened").selectExpr(
        "doc_id", "seg_no", "tokened", f"{_LOSSY} AS translated")
    checked = quality.check_preserved(pairs, "tokened")
    return checked.select("doc_id", "seg_no", "preserved", F.array_join(F.array_sort("lost"), " ").alias("lost"))


_RESULT = (
    "CASE WHEN length(html) > 6000 THEN html WHEN contains(html, 'lang=\"fr\"') THEN substr(html, 1, 90) "
    "ELSE replace(html, 'the', 'THE') END"
)
_LANGUAGE = "CASE WHEN contains(html, 'lang=\"de\"') THEN NULL ELSE 'hi' END"
_ENCODED = "CASE WHEN contains(html, 'lang=\"es\"') THEN '' WHEN contains(html, 'lang=\"en\"') THEN 'QUJD' END"


@query("check_result", f"""
SELECT page_id, concat_ws('; ', CASE WHEN language IS NULL THEN 'missing language' END,
  CASE WHEN length(html) <= 100 THEN 'html too short' END,
  CASE WHEN html = original_html THEN 'html unchanged' END,
  CASE WHEN pdf = '' THEN 'pdf does not decode' END) AS violations
FROM (SELECT page_id, html AS original_html, {_RESULT} AS html, {_LANGUAGE} AS language, {_ENCODED} AS pdf FROM pages)
""")
def check_result(spark, sf_dir):
    rows = pages(spark, sf_dir).selectExpr(
        "page_id", "html AS original_html", f"{_RESULT} AS html", f"{_LANGUAGE} AS language", f"{_ENCODED} AS pdf")
    return quality.check_result(rows, encoded=("pdf",)).select(
        "page_id", F.array_join("violations", "; ").alias("violations"))
