"""Layout blocks: pages, lists, paragraphs, runs and merged cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.fixed import SYMBOLS_FROM
from docloom.operators import layout
from docloom.operators.segment import segments
from docloom.plans.common import SEGS, documents
from docloom.plans.registry import query
from docloom.sources.requests import read_table


def _turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


_PAGED = """
SELECT *, 1 + sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS page_no FROM conversations
"""


@query("assign_pages", f"SELECT conv_id, turn, CAST(page_no AS BIGINT) AS page_no FROM ({_PAGED})")
def assign_pages(spark, sf_dir):
    """A question starts a page."""
    turns = _turns(spark, sf_dir).select("conv_id", "turn", "role")
    return layout.assign_pages(turns, "conv_id", "turn", F.col("role") == "user").drop("role")


@query("render_pages", f"""
SELECT conv_id, CAST(page_no AS BIGINT) AS page_no, 0 AS part_no, 1 AS part_total, '<div class="page"><div class="docx-header">' || conv_id
  || '</div>' || string_agg('<p>' || text || '</p>', '' ORDER BY turn)
  || '<div class="docx-footer">end</div></div>' AS html
FROM ({_PAGED}) GROUP BY conv_id, page_no
""")
def render_pages(spark, sf_dir):
    paged = layout.assign_pages(_turns(spark, sf_dir), "conv_id", "turn", F.col("role") == "user")
    blocks = paged.select(
        "conv_id", "page_no", "turn", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"),
        F.concat(F.lit('<div class="docx-header">'), F.col("conv_id").cast("string"), F.lit("</div>"))
        .alias("header_html"),
        F.lit('<div class="docx-footer">end</div>').alias("footer_html"))
    return layout.render_pages(blocks, "conv_id", order="turn")


# a line that starts with e or i is a bullet, with d or l a number, others close the list
_KIND = (
    "CASE WHEN lower(substr(text, 1, 1)) IN ('e', 'i') THEN 'unordered' "
    "WHEN lower(substr(text, 1, 1)) IN ('d', 'l') THEN 'ordered' END"
)


@query("list_runs", f"""
WITH k AS (SELECT doc_id, seg_no, {_KIND} AS list_kind FROM ({SEGS})),
p AS (SELECT *, lag(list_kind) OVER (PARTITION BY doc_id ORDER BY seg_no) AS before FROM k),
s AS (SELECT *, sum(CASE WHEN list_kind IS NOT NULL AND list_kind IS DISTINCT FROM before THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING) AS n FROM p)
SELECT doc_id, seg_no, list_kind, CASE WHEN list_kind IS NOT NULL THEN CAST(n AS BIGINT) END AS list_no FROM s
""")
def list_runs(spark, sf_dir):
    segs = segments(documents(spark, sf_dir)).selectExpr("doc_id", "seg_no", f"{_KIND} AS list_kind")
    return layout.list_runs(segs, "doc_id", "seg_no")


# paragraph properties that the tables lack, from the line's position and length
_PROPS = {
    "style_name": "CASE WHEN seg_no = 0 THEN 'Heading 1' WHEN length(text) < 60 THEN 'My heading 3' ELSE 'Normal' END",
    "list_kind": _KIND,
    "align": "CASE WHEN length(text) < 80 THEN 'center' WHEN length(text) < 160 THEN 'right' "
             "WHEN length(text) < 240 THEN 'justify' WHEN length(text) < 300 THEN 'left' END",
    "left_pt": "CAST(seg_no * 18 AS DOUBLE)",
    "right_pt": "CASE WHEN length(text) > 200 THEN CAST(length(text) AS DOUBLE) / 8 END",
    "first_line_pt": "CASE WHEN length(text) > 300 THEN -CAST(length(text) AS DOUBLE) / 16 "
                     "WHEN length(text) > 150 THEN CAST(36 AS DOUBLE) END",
    "before_pt": "CAST(CASE WHEN seg_no = 0 THEN 0 ELSE 6 END AS DOUBLE)",
    "after_pt": "CASE WHEN seg_no > 2 THEN CAST(length(text) AS DOUBLE) / 4 END",
}
_PROP_LIST = ", ".join(f"{e} AS {n}" for n, e in _PROPS.items())


def _pt(name: str, column: str) -> str:
    return f"CASE WHEN {column} <> 0 THEN '{name}: ' || CAST({column} AS VARCHAR) || 'pt;' END"


@query("render_blocks", f"""
WITH b AS (SELECT doc_id, seg_no, text, {_PROP_LIST} FROM ({SEGS})),
c AS (SELECT *, concat_ws(' ',
    CASE WHEN length(text) < 40 THEN 'border-top: 1px solid #000; padding: 5px; '
      || 'border-bottom: 1px solid #000; padding: 5px;' END,
    CASE WHEN align IN ('center', 'right', 'justify') THEN 'text-align: ' || align || ';' END,
    {_pt("margin-left", "left_pt")}, {_pt("margin-right", "right_pt")}, {_pt("text-indent", "first_line_pt")},
    CASE WHEN first_line_pt < 0 THEN 'padding-left: 0;' END,
    {_pt("margin-top", "before_pt")}, {_pt("margin-bottom", "after_pt")}) AS css,
  CASE WHEN list_kind IS NOT NULL THEN 'li' WHEN style_name = 'Heading 1' THEN 'h1'
       WHEN style_name = 'My heading 3' THEN 'h3' ELSE 'p' END AS tag FROM b)
SELECT doc_id, seg_no, '<' || tag || CASE WHEN css <> '' THEN ' style="' || css || '"' ELSE '' END || '>'
  || text || '</' || tag || '>' AS html FROM c
""")
def render_blocks(spark, sf_dir):
    segs = segments(documents(spark, sf_dir)).selectExpr(
        "doc_id", "seg_no", "text", *[f"{e} AS {n}" for n, e in _PROPS.items()])
    sides = F.when(F.length("text") < 40, F.array(F.lit("top"), F.lit("between"))).otherwise(
        F.array().cast("array<string>"))
    return layout.render_blocks(segs.withColumn("borders", sides), "text").select("doc_id", "seg_no", "html")


# run properties: unset, on or off at each of the three levels
_RUN_PROPS = {
    "bold": "CASE WHEN length(text) > 90 THEN true WHEN length(text) > 80 THEN false END",
    "bold_rpr": "CASE WHEN length(text) > 60 THEN 'off' WHEN length(text) > 50 THEN '1' END",
    "bold_ppr": "CASE WHEN run_no = 0 THEN 'True' WHEN run_no = 1 THEN '0' END",
    "italic": "CAST(NULL AS BOOLEAN)",
    "italic_rpr": "CASE WHEN starts_with(text, 'e') THEN '' WHEN starts_with(text, 'd') THEN 'FALSE' END",
    "italic_ppr": "CASE WHEN run_no > 2 THEN 'on' END",
    "underline": "CASE WHEN run_no = 3 THEN true WHEN run_no = 4 THEN false END",
    "size_pt": "CASE WHEN run_no = 0 THEN CAST(length(text) AS DOUBLE) / 4 WHEN run_no = 1 THEN CAST(0 AS DOUBLE) END",
    "color": "CASE WHEN run_no = 2 THEN 'FF0000' END",
    "font": "CASE WHEN run_no = 1 THEN 'Wingdings' ELSE 'Arial' END",
}
_RUN_SQL = f"""
SELECT *, {", ".join(f"{e} AS {n}" for n, e in _RUN_PROPS.items())}
FROM (SELECT doc_id, seg_no, unnest(string_split(text, ', ')) AS text,
             unnest(range(len(string_split(text, ', ')))) AS run_no FROM ({SEGS}))
"""
_ESC = (
    "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
    "'\"', '&quot;'), '''', '&#x27;')"
)


def _tri(name: str) -> str:
    def on(c: str) -> str:
        return f"lower({c}) NOT IN ('0', 'false', 'off')"

    return f"coalesce({name}, {on(name + '_rpr')}, {on(name + '_ppr')}, false)"


_RUN_HTML = f"""
SELECT doc_id, seg_no, run_no, CASE WHEN body = '' THEN '' WHEN css = '' THEN body
  ELSE '<span style="' || css || '">' || body || '</span>' END AS html
FROM (SELECT doc_id, seg_no, run_no,
  {_ESC.format(x="CASE WHEN font = 'Wingdings' THEN translate(text, '.-', '☑☐') ELSE replace(replace(text, '.', chr(61607)), '-', chr(61608)) END")} AS body,
  concat_ws(' ', CASE WHEN {_tri("bold")} THEN 'font-weight: bold;' END,
    CASE WHEN {_tri("italic")} THEN 'font-style: italic;' END,
    CASE WHEN underline THEN 'text-decoration: underline;' END,
    CASE WHEN size_pt <> 0 THEN 'font-size: ' || CAST(size_pt AS VARCHAR) || 'pt;' END,
    CASE WHEN color IS NOT NULL THEN 'color: #' || color || ';' END) AS css FROM ({_RUN_SQL}))
"""


def _rendered_runs(spark, sf_dir):
    """Lines cut at commas; full stop and hyphen stand for two symbol-font glyphs."""
    pieces = segments(documents(spark, sf_dir)).select(
        "doc_id", "seg_no", F.posexplode(F.split("text", ", ", -1)).alias("run_no", "text"))
    runs = pieces.selectExpr(
        "doc_id", "seg_no", "CAST(run_no AS BIGINT) AS run_no", "text",
        *[f"{e.replace('starts_with', 'startswith')} AS {n}" for n, e in _RUN_PROPS.items()])
    return layout.render_runs(runs.withColumn("text", F.translate("text", ".-", SYMBOLS_FROM[:2])))


@query("render_runs", _RUN_HTML)
def render_runs(spark, sf_dir):
    return _rendered_runs(spark, sf_dir).select("doc_id", "seg_no", "run_no", "html")


@query("join_runs", f"""
SELECT doc_id, seg_no, string_agg(html, '' ORDER BY run_no) AS text_html FROM ({_RUN_HTML}) GROUP BY doc_id, seg_no
""")
def join_runs(spark, sf_dir):
    """The inner HTML of each paragraph."""
    return layout.join_runs(_rendered_runs(spark, sf_dir), ["doc_id", "seg_no"])


# a document is a table, its lines are rows; equal values below one another are merged, and
# the last two columns are one wide cell where the line starts with d, e or i
_LETTER = "lower(substr(text, 1, 1))"
_BAND = "CASE WHEN length(text) < 150 THEN 'short' ELSE 'long' END"
_ROWS = f"SELECT doc_id, seg_no, {_LETTER} AS a, {_BAND} AS b, {_LETTER} IN ('d', 'e', 'i') AS wide FROM ({SEGS})"
_CELLS = f"""
SELECT doc_id, seg_no, 0 AS col_no, concat('m', b) AS cell_id, 1 AS grid_span, b AS text, 'auto' AS shading
FROM ({_ROWS})
UNION ALL SELECT doc_id, seg_no, 1, concat(CASE WHEN wide THEN 'w' ELSE 'f' END, a),
  CASE WHEN wide THEN 2 ELSE 1 END, a, 'D9D9D9' FROM ({_ROWS})
UNION ALL SELECT doc_id, seg_no, 2, CASE WHEN wide THEN concat('w', a) ELSE concat('s', b) END, 1,
  CASE WHEN wide THEN '' ELSE b END, NULL FROM ({_ROWS})
"""
_SPANS = f"""
WITH c AS (SELECT *, lag(cell_id) OVER (PARTITION BY doc_id, col_no ORDER BY seg_no) AS above,
    lag(cell_id) OVER (PARTITION BY doc_id, seg_no ORDER BY col_no) AS beside FROM ({_CELLS})),
r AS (SELECT *, sum(CASE WHEN cell_id IS DISTINCT FROM above THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, col_no ORDER BY seg_no) AS run FROM c),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, col_no, run) AS rowspan FROM r)
SELECT doc_id, seg_no, col_no, cell_id, text, shading, grid_span AS colspan, rowspan
FROM s WHERE cell_id IS DISTINCT FROM above AND cell_id IS DISTINCT FROM beside
"""


def _cells(spark, sf_dir):
    rows = segments(documents(spark, sf_dir)).selectExpr(
        "doc_id", "seg_no", f"{_LETTER} AS a", f"{_BAND} AS b", f"{_LETTER} IN ('d', 'e', 'i') AS wide")
    wide_id = F.concat(F.lit("w"), "a")

    def cell(n, cell_id, span, text, shading):
        return F.struct(F.lit(n).alias("col_no"), cell_id.alias("cell_id"), span.alias("grid_span"),
                        text.alias("text"), F.lit(shading).cast("string").alias("shading"))

    row = F.array(
        cell(0, F.concat(F.lit("m"), "b"), F.lit(1), F.col("b"), "auto"),
        cell(1, F.when(F.col("wide"), wide_id).otherwise(F.concat(F.lit("f"), "a")),
             F.when(F.col("wide"), 2).otherwise(1), F.col("a"), "D9D9D9"),
        cell(2, F.when(F.col("wide"), wide_id).otherwise(F.concat(F.lit("s"), "b")), F.lit(1),
             F.when(F.col("wide"), "").otherwise(F.col("b")), None))
    return rows.select("doc_id", "seg_no", F.inline(row))


@query("cell_spans", _SPANS)
def cell_spans(spark, sf_dir):
    return layout.cell_spans(_cells(spark, sf_dir), ["doc_id"], "seg_no").select(
        "doc_id", "seg_no", "col_no", "cell_id", "text", "shading", "colspan", "rowspan")


@query("render_cells", f"""
SELECT doc_id, seg_no, col_no, '<td'
  || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END
  || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END
  || CASE WHEN shading <> 'auto' THEN ' style="background-color: #' || shading || '"' ELSE '' END
  || '>' || CASE WHEN trim(text) = '' THEN '&nbsp;' ELSE text END || '</td>' AS html FROM ({_SPANS})
""")
def render_cells(spark, sf_dir):
    spans = layout.cell_spans(_cells(spark, sf_dir), ["doc_id"], "seg_no")
    return layout.render_cells(spans).select("doc_id", "seg_no", "col_no", "html")


# lines with a comma after four letters are tables of one row; others are blocks, some in lists
_IS_TABLE = "substr(text, 5, 1) = ','"
_NUMBER = "CASE WHEN list_kind = 'ordered' THEN '%1' || (seg_no + 1) || '.' END"
_DOC_KIND = f"CASE WHEN lower(substr(text, 2, 1)) = 'n' THEN 'ordered-a' ELSE {_KIND} END"


@query("render_document", f"""
WITH l AS (SELECT doc_id, seg_no, text, {_IS_TABLE} AS is_table, CASE WHEN {_IS_TABLE} THEN NULL ELSE {_DOC_KIND} END AS list_kind
           FROM ({SEGS})),
h AS (SELECT *, CASE WHEN is_table THEN '{layout.TABLE_OPEN}<tr>' || array_to_string(list_transform(string_split(text, ','),
    lambda x: '<td class="has-border-top has-border-left has-border-bottom has-border-right">'
      || CASE WHEN trim(x, ' ') = '' THEN '&nbsp;' ELSE x END || '</td>'), '') || '</tr></table>'
  WHEN list_kind IS NULL THEN '<p>' || text || '</p>'
  ELSE '<li>' || CASE WHEN list_kind = 'ordered' THEN '<span class="list-number" style="margin-right: 1.5em; '
      || 'min-width: 1.5em; display: inline-block;">' || (seg_no + 1) || '.</span>' ELSE '' END || text || '</li>' END AS html,
  lag(list_kind) OVER w AS before, lead(list_kind) OVER w AS after
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no))
SELECT doc_id, string_agg(
  CASE WHEN list_kind IS NULL OR list_kind IS NOT DISTINCT FROM before THEN '' WHEN list_kind = 'unordered' THEN '<ul>'
    WHEN list_kind = 'ordered' THEN '<ol>' ELSE '<ol type="a">' END || html ||
  CASE WHEN list_kind IS NULL OR list_kind IS NOT DISTINCT FROM after THEN '' WHEN list_kind = 'unordered' THEN '</ul>'
    ELSE '</ol>' END, '' ORDER BY seg_no) AS html FROM h GROUP BY doc_id
""")
def render_document(spark, sf_dir):
    """Lists, list numbers and tables with borders put together in the order of the document."""
    lines = segments(documents(spark, sf_dir)).selectExpr("*", f"{_IS_TABLE} AS is_table")
    plain = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in (
        ("style_name", "STRING"), ("align", "STRING"), ("left_pt", "DOUBLE"), ("right_pt", "DOUBLE"),
        ("first_line_pt", "DOUBLE"), ("before_pt", "DOUBLE"), ("after_pt", "DOUBLE"), ("borders", "ARRAY<STRING>")))
    blocks = lines.where("NOT is_table").selectExpr("*", f"{_DOC_KIND} AS list_kind", *plain.split(", ")).selectExpr(
        "*", f"{_NUMBER} AS number_text", "'tab' AS number_suffix")
    cells = lines.where("is_table").select(
        "doc_id", "seg_no", F.lit(0).alias("row_no"), F.posexplode(F.split("text", ",")).alias("col_no", "text"))
    cells = cells.selectExpr("*", "CAST(NULL AS STRING) AS cell_id", "1 AS grid_span", "CAST(NULL AS STRING) AS shading",
                             "CAST(NULL AS ARRAY<STRING>) AS borders", "true AS table_borders")
    spans = layout.render_cells(layout.cell_spans(cells, ["doc_id", "seg_no"]))
    tables = layout.render_tables(spans, ["doc_id", "seg_no"])
    return layout.render_document(layout.render_blocks(blocks, "text"), tables, "doc_id", "seg_no")
