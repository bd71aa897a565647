"""Masking and restoring, and HTML read as blocks, runs and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import masking
from docloom.functions.fixed import PROTECTED_TERMS
from docloom.functions.text import escape_html, trim_ws
from docloom.operators import html as H
from docloom.plans.common import SEGS, WS, documents, pages, sql_text
from docloom.plans.registry import query

# ------------------------------------------------------------------ placeholders

# a style block and an image of either quote kind in front of every paragraph
_STYLED = "replace(html, '<p>', concat('<style media=\"x\">p{', chr(10), '}</style><p>'))"
_PICTURED = (
    "replace(replace(html, '<p>', concat('<p><img src=\"data:image/png;base64,QU', "
    "CAST(page_id AS VARCHAR(20)), '\">')), '<li>', '<li><img src=''data:image/gif;base64,R0lG''>')"
)


def _numbered_sql(source: str, pattern: str, shown: str) -> str:
    """Masked text and the list of matches; ``shown`` sees the match m and its number k."""
    return f"""
SELECT page_id, found, array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(found)
  THEN {shown.replace('{k}', '(i - 1)').replace('{m}', 'found[i]')} ELSE '' END), '') AS html
FROM (SELECT page_id, string_split_regex(src, {sql_text(pattern)}) AS parts,
             regexp_extract_all(src, {sql_text(pattern)}) AS found
      FROM (SELECT page_id, {source} AS src FROM pages))"""


_STYLE_SQL = _numbered_sql(_STYLED, masking.STYLE, "'<div class=\"STYLE_PLACEHOLDER_' || {k} || '\"></div>'")
_IMAGE_SQL = _numbered_sql(
    _PICTURED, masking.IMAGE,
    "substr({m}, 1, 5) || 'IMG_PLACEHOLDER_' || {k} || substr({m}, 5, 1)")


def _pages(spark, sf_dir, source="html"):
    return pages(spark, sf_dir).selectExpr("page_id", f"{source} AS html")


@query("mask_styles", f"SELECT page_id, html, len(found) AS masked, found[1] AS first_style FROM ({_STYLE_SQL})")
def mask_styles(spark, sf_dir):
    m = _pages(spark, sf_dir, _STYLED).select("page_id", masking.mask_styles("html").alias("m"))
    return m.select(
        "page_id", F.col("m.text").alias("html"), F.size("m.term_map").cast("long").alias("masked"),
        F.get("m.term_map", F.lit(0))["original"].alias("first_style"))


@query("mask_images", f"""
SELECT page_id, html, len(found) AS masked, array_to_string(list_transform(found,
  lambda m: substr(m, 6, length(m) - 6)), ' ') AS images FROM ({_IMAGE_SQL})
""")
def mask_images(spark, sf_dir):
    m = _pages(spark, sf_dir, _PICTURED).select("page_id", masking.mask_images("html").alias("m"))
    return m.select(
        "page_id", F.col("m.text").alias("html"), F.size("m.term_map").cast("long").alias("masked"),
        F.array_join(F.transform("m.term_map", lambda e: e["original"]), " ").alias("images"))


# what a translator may do to the empty divs: nothing, add blanks, or rename the attribute
_DAMAGE = (
    "CASE WHEN contains(html, 'lang=\"fr\"') THEN replace(html, '\"></div>', '\" > </div>') "
    "WHEN contains(html, 'lang=\"de\"') THEN replace(html, '<div class=\"STYLE', '<div id=\"STYLE') ELSE html END"
)


@query("unmask_styles", f"""
SELECT page_id, CASE WHEN contains(html, 'lang="de"')
  THEN array_to_string(found, '') || regexp_replace({_DAMAGE}, 'STYLE_PLACEHOLDER_[0-9]+', '', 'g')
  ELSE src END AS html
FROM ({_STYLE_SQL}) JOIN (SELECT page_id, {_STYLED} AS src FROM pages) USING (page_id)
""")
def unmask_styles(spark, sf_dir):
    """Whole divs become styles again; where only the token survived, styles move to the front."""
    m = _pages(spark, sf_dir, _STYLED).select("page_id", masking.mask_styles("html").alias("m"))
    sent = m.select("page_id", F.col("m.text").alias("html"), F.col("m.term_map").alias("styles"))
    back = sent.selectExpr("page_id", "styles", f"{_DAMAGE} AS html")
    return back.select("page_id", masking.unmask_styles("html", "styles").alias("html"))


@query("unmask_images", f"SELECT page_id, {_PICTURED} AS html FROM pages")
def unmask_images(spark, sf_dir):
    m = _pages(spark, sf_dir, _PICTURED).select("page_id", masking.mask_images("html").alias("m"))
    return m.select("page_id", masking.unmask_images("m.text", "m.term_map").alias("html"))


# ---------------------------------------------------------------- terms and brackets

# words of the tables that serve as terms: overlapping, inside words, with a blank
DATA_TERMS = ["the the", "the", "tion", "ing ", "que", "der", "La ", "é"]
# words turned into protected terms and bracket tokens
_TERMED = (
    "regexp_replace(replace(replace(replace(replace(text, ' the ', ' L&T Finance '), ' of ', ' COMPANY PAN '), "
    "' und ', ' Pvt. Ltd. '), ' que ', ' GST '), '([A-Za-z]+)[.]', {ref}{flag})"
)
_TERMED_SPARK = _TERMED.format(ref="'[[$1]].'", flag="")
_TERMED_DUCK = _TERMED.format(ref="'[[\\1]].'", flag=", 'g'")


def _terms_sql(source: str, terms: list[str]) -> str:
    """One replacement a level; ``h{i}`` counts the hits of term i at its turn."""
    sql = f"SELECT doc_id, {source} AS t FROM documents"
    for i, term in enumerate(terms):
        lit, counts = sql_text(term), "".join(f", h{k}" for k in range(i))
        sql = (f"SELECT doc_id, replace(t, {lit}, '__TERM_{i}__') AS t{counts}, "
               f"(length(t) - length(replace(t, {lit}, ''))) // {len(term)} AS h{i} FROM ({sql})")
    return sql


def _sum_sql(terms: list[str]) -> str:
    return " + ".join(f"CASE WHEN h{i} > 0 THEN 1 ELSE 0 END" for i in range(len(terms)))


@query("mask_terms", f"""
SELECT doc_id, t AS text, {_sum_sql(DATA_TERMS)} AS found FROM ({_terms_sql("text", DATA_TERMS)})
""")
def mask_terms(spark, sf_dir):
    m = documents(spark, sf_dir).select("doc_id", masking.mask_terms("text", DATA_TERMS).alias("m"))
    return m.select("doc_id", "m.text", F.size("m.term_map").cast("long").alias("found"))


@query("mask_protected_terms", f"""
SELECT doc_id, t AS text, {_sum_sql(PROTECTED_TERMS)} AS found FROM ({_terms_sql(_TERMED_DUCK, PROTECTED_TERMS)})
""")
def mask_protected_terms(spark, sf_dir):
    docs = documents(spark, sf_dir).selectExpr("doc_id", f"{_TERMED_SPARK} AS text")
    m = docs.select("doc_id", masking.mask_terms("text").alias("m"))
    return m.select("doc_id", "m.text", F.size("m.term_map").cast("long").alias("found"))


_HITS = ", ".join(
    f"{{'term_id': {i}, 'term': {sql_text(t)}, 'n': h{i}}}" for i, t in enumerate(PROTECTED_TERMS))


@query("term_hits", f"""
SELECT doc_id, h.term_id AS term_id, h.term AS term, h.n AS n
FROM (SELECT doc_id, unnest([{_HITS}]) AS h FROM ({_terms_sql(_TERMED_DUCK, PROTECTED_TERMS)})) WHERE h.n > 0
""")
def term_hits(spark, sf_dir):
    docs = documents(spark, sf_dir).selectExpr("doc_id", f"{_TERMED_SPARK} AS text")
    hits = docs.select("doc_id", F.explode(masking.term_hits("text")).alias("h"))
    return hits.select("doc_id", F.col("h.term_id").cast("long").alias("term_id"), "h.term",
                       F.col("h.n").cast("long").alias("n"))


_BRACKETS = "\\[\\[[^\\n]*?\\]\\]"


@query("mask_brackets", f"""
SELECT doc_id, array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(found)
  THEN '__BRACKET_' || (i - 1) || '__' ELSE '' END), '') AS text, len(found) AS masked
FROM (SELECT doc_id, string_split_regex(t, '{_BRACKETS}') AS parts, regexp_extract_all(t, '{_BRACKETS}') AS found
      FROM (SELECT doc_id, {_TERMED_DUCK} AS t FROM documents))
""")
def mask_brackets(spark, sf_dir):
    docs = documents(spark, sf_dir).selectExpr("doc_id", f"{_TERMED_SPARK} AS text")
    m = docs.select("doc_id", masking.mask_brackets("text").alias("m"))
    return m.select("doc_id", "m.text", F.size("m.term_map").cast("long").alias("masked"))


@query("unmask_protected", f"SELECT doc_id, {_TERMED_DUCK} AS text FROM documents")
def unmask_protected(spark, sf_dir):
    """Terms and brackets hidden and restored: nothing changes."""
    docs = documents(spark, sf_dir).selectExpr("doc_id", f"{_TERMED_SPARK} AS text")
    m = docs.select("doc_id", masking.mask_protected("text", prefix="R").alias("m"))
    return m.select("doc_id", masking.unmask("m.text", "m.term_map").alias("text"))


def _whole_word(text: str, word: str, token: str) -> str:
    """Letters and digits of any script bound a word. Neighbours share an edge: twice."""
    for _ in range(2):
        text = (f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}]){word}($|[^\\p{{L}}\\p{{N}}])', "
                f"'\\1{token}\\2', 'g')")
    return text


@query("mask_whole_words", f"""
SELECT doc_id, {_whole_word(_whole_word("text", "de", "__TERM_0__"), "la", "__TERM_1__")} AS text FROM documents
""")
def mask_whole_words(spark, sf_dir):
    """The option that leaves terms inside longer words alone, next to letters of any script."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    m = docs.select("doc_id", masking.mask_terms("text", ["de", "la"], whole_word=True).alias("m"))
    return m.select("doc_id", "m.text")


# --------------------------------------------------------------------- HTML blocks

_CSS = (
    "CASE WHEN contains(html, 'lang=\"en\"') THEN 'text-align: center' "
    "WHEN contains(html, 'lang=\"fr\"') THEN 'text-align: right; width: 12.5pt' "
    "WHEN contains(html, 'lang=\"de\"') THEN 'background-color: #A0b1c2; text-align: justify' ELSE 'x' END"
)
_RICH = (
    "replace(replace(replace(html, '<article>', '<div class=\"docx-header\"><p>Top &amp; more</p></div><article>'),"
    f" '<p>', concat('<p style=\"', {_CSS}, '\">')), ' the ', ' <img src=\"a.png\" style=\"width: 7pt\"> <i>the</i> ')"
)
_TEXT = "regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
_UNESCAPE = (
    "replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
    "'&#x27;', ''''), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
)


def _blocks_sql(source: str) -> str:
    tag, noise = sql_text(H.BLOCK_TAG), sql_text(H.NOISE)
    head, foot = sql_text(H.HEADER_DIV), sql_text(H.FOOTER_DIV)
    text = _UNESCAPE.format(x=_TEXT.format(x="raw"))
    style = "regexp_extract({t}, '(?i)\\sstyle=\"([^\"]*)\"', 1)"
    return f"""
WITH s AS (SELECT page_id, regexp_replace({source}, {noise}, '', 'g') AS h FROM pages),
p AS (SELECT page_id, 1 AS part, 'header' AS section, regexp_extract(h, {head}, 1) AS h FROM s
  UNION ALL SELECT page_id, 2, 'footer', regexp_extract(h, {foot}, 1) FROM s
  UNION ALL SELECT page_id, 3, 'body', regexp_replace(regexp_replace(h, {head}, '', 'g'), {foot}, '', 'g') FROM s),
t AS (SELECT page_id, part, section, unnest(tags) AS tag, unnest(pieces[2:]) AS raw,
             unnest(range(len(tags))) AS i
      FROM (SELECT *, regexp_extract_all(h, {tag}) AS tags, string_split_regex(h, {tag}) AS pieces FROM p)),
k AS (SELECT *, lower(regexp_extract(tag, '(?i)^<(h[1-6]|p|li|td|th)[\\s/>]', 1)) AS kind FROM t),
b AS (SELECT page_id, part, section, i, 0 AS j, kind,
        CASE WHEN kind LIKE 'h%' THEN CAST(substr(kind, 2, 1) AS INTEGER) END AS level,
        {style.format(t="tag")} AS style, raw, trim({text}, {WS}) AS text FROM k WHERE kind <> ''
  UNION ALL
  SELECT page_id, part, section, i, j, 'img', NULL, {style.format(t="m")}, m,
    regexp_extract(m, '(?i)\\ssrc=["'']([^"'']*)["'']', 1)
  FROM (SELECT *, unnest(regexp_extract_all(raw, '(?i)<img[^>]*>')) AS m,
               unnest(range(1, 1 + len(regexp_extract_all(raw, '(?i)<img[^>]*>')))) AS j FROM k))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part, i, j) - 1 AS block_no,
       section, kind, level, style, raw, text FROM b"""


@query("html_blocks", _blocks_sql(_RICH))
def html_blocks(spark, sf_dir):
    return H.html_blocks(_pages(spark, sf_dir, _RICH))


@query("block_styles", f"""
SELECT page_id, block_no, CASE WHEN contains(style, 'text-align: center') THEN 'center'
    WHEN contains(style, 'text-align: right') THEN 'right'
    WHEN contains(style, 'text-align: justify') THEN 'justify' END AS align,
  nullif(regexp_extract(style, 'background-color:\\s*#([0-9a-fA-F]+)', 1), '') AS background,
  TRY_CAST(regexp_extract(style, 'width:\\s*([\\d.]+)pt', 1) AS DOUBLE) AS width_pt
FROM ({_blocks_sql(_RICH)})
""")
def block_styles(spark, sf_dir):
    return H.block_styles(H.html_blocks(_pages(spark, sf_dir, _RICH))).select(
        "page_id", "block_no", "align", "background", "width_pt")


# formatting inside text; the pages also have bold that is never closed
_FORMATTED = (
    "replace(replace(replace(html, ' the ', ' <i>the</i> '), ' of ', "
    "' <span style=\"font-weight: bold; text-decoration: underline\">of <u>and</u><br></span><br/>'), "
    "' que ', ' <a href=\"x\">que</a> <em></em>')"
)


@query("inline_runs", f"""
WITH t AS (SELECT page_id, block_no, unnest(toks) AS t, unnest(range(len(toks))) AS pos
  FROM (SELECT page_id, block_no, regexp_extract_all(raw, '<[^>]*>|[^<]+|<') AS toks
        FROM ({_blocks_sql(_FORMATTED)}))),
g AS (SELECT *, lower(regexp_extract(t, '(?i)^</?(strong|b|em|i|u|span)(?:\\s[^>]*)?>$', 1)) AS tag,
             starts_with(t, '</') AS closing FROM t),
d AS (SELECT *, sum(CASE WHEN tag = '' THEN 0 WHEN closing THEN -1 ELSE 1 END)
        OVER (PARTITION BY page_id, block_no ORDER BY pos) AS depth FROM g),
r AS (SELECT *, max(CASE WHEN tag <> '' AND NOT closing AND depth = 1 THEN pos END)
        OVER (PARTITION BY page_id, block_no ORDER BY pos) AS opened FROM d),
x AS (SELECT page_id, block_no, pos, CASE WHEN depth > 0 THEN opened ELSE pos END AS grp,
        CASE WHEN depth > 0 AND pos = opened THEN t END AS opener,
        CASE WHEN tag <> '' THEN '' WHEN regexp_matches(t, '(?i)^<br\\s*/?>$') THEN
               CASE WHEN depth > 0 THEN '' ELSE chr(10) END
             WHEN starts_with(t, '<') AND length(t) > 1 THEN NULL ELSE {_UNESCAPE.format(x="t")} END AS txt
      FROM r WHERE NOT (tag <> '' AND depth = 0)),
o AS (SELECT page_id, block_no, grp, coalesce(max(opener), '') AS opener, string_agg(txt, '' ORDER BY pos) AS text
      FROM x WHERE txt IS NOT NULL GROUP BY page_id, block_no, grp),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_no ORDER BY grp) - 1 AS run_no FROM o)
SELECT page_id, block_no, run_no, text,
  starts_with(opener, '<b') OR starts_with(opener, '<strong') OR contains(opener, 'font-weight: bold') AS bold,
  opener IN ('<i>', '<em>') OR contains(opener, 'font-style: italic') AS italic,
  opener = '<u>' OR contains(opener, 'text-decoration: underline') AS underline
FROM n WHERE text <> ''
""")
def inline_runs(spark, sf_dir):
    blocks = H.html_blocks(_pages(spark, sf_dir, _FORMATTED))
    return H.inline_runs(blocks, ["page_id", "block_no"])


# --------------------------------------------------------------------------- tables

def document_tables(spark, sf_dir):
    """A document as a table: a row for each line, a nested table where it starts with E."""
    def row(line):
        nested = F.when(F.startswith(line, F.lit("E")), "<table><tr><td>inner</td><td>cell</td></tr></table>tail</td>")
        return F.concat(
            F.lit('<tr><td style="color: red; background-color: #A0b1c2">row</td>\n <td>'), escape_html(line),
            nested.otherwise("</td><th> head</th>"), F.lit("</tr>"))

    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: trim_ws(x)), lambda x: x != "")
    return documents(spark, sf_dir).select("doc_id", F.concat(
        F.lit('<p>before</p><table class="docx-table">'), F.array_join(F.transform(lines, row), ""),
        F.lit("</table><table></table><p>x</p><TABLE><TR><TD></TD></TR></TABLE>after")).alias("html"))


@query("table_cells", f"""
WITH s AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS row_no FROM ({SEGS})),
c AS (
  SELECT doc_id, 0 AS table_no, row_no, 0 AS col_no, 'td' AS kind, 'row' AS text, 'A0b1c2' AS background FROM s
  UNION ALL SELECT doc_id, 0, row_no, 1, 'td', text || CASE WHEN starts_with(text, 'E')
    THEN 'innercelltail' ELSE '' END, NULL FROM s
  UNION ALL SELECT doc_id, 0, row_no, 2, 'th', 'head', NULL FROM s WHERE NOT starts_with(text, 'E')
  UNION ALL SELECT doc_id, 2, 0, 0, 'td', '', NULL FROM documents)
SELECT *, max(col_no) OVER (PARTITION BY doc_id, table_no) + 1 AS n_cols FROM c
""")
def table_cells(spark, sf_dir):
    return H.table_cells(document_tables(spark, sf_dir))
