"""Word-style layout blocks as HTML: pages, lists, paragraphs, runs and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import escape_html, map_symbols
from docloom.operators.assemble import assemble, assemble_parts
from docloom.operators.ordering import number_islands, number_rows, running_sums, with_extremes

# --- fixed values: how lists, list numbers and tables are written ------------
LIST_TAGS = {"unordered": ("<ul>", "</ul>"), "ordered": ("<ol>", "</ol>"), "ordered-a": ('<ol type="a">', "</ol>")}
NUMBER_SPACING = {"space": "0.3em", "nothing": "0", "tab": "1.5em"}
TABLE_OPEN = '<table class="docx-table" style="width: 100% !important; border-collapse: collapse; table-layout: auto;">'
BORDER_SIDES = ("top", "left", "bottom", "right")


def assign_pages(blocks: DataFrame, id_col: str, order: str, breaks: Column) -> DataFrame:
    """Add ``page_no``: a page starts at each flagged block. Page 1 is open before the
    first block, so a flag on that one leaves page 1 empty."""
    flag = F.when(breaks, 1).otherwise(0)
    return running_sums(blocks, id_col, order, {"page_no": flag}).withColumn(
        "page_no", F.col("page_no") + 1)


def list_runs(blocks: DataFrame, id_col: str, order: str, kind: str = "list_kind") -> DataFrame:
    """Add ``list_no`` (1, 2, …; null outside lists): adjacent items of one kind are a list."""
    counted = number_islands(blocks, id_col, order, kind, "list_no", count_null=False)
    return counted.withColumn("list_no", F.when(F.col(kind).isNotNull(), F.col("list_no")))


def _rule(name: str, value: Column) -> Column:
    """A CSS rule in points, only for a value that is set and not zero."""
    return F.when(value != 0, F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("pt;")))


def block_tag(style_name: Column, is_list: Column) -> Column:
    tag = F.lit("p")
    for level in range(6, 0, -1):
        tag = F.when(F.contains(F.lower(style_name), F.lit(f"heading {level}")), f"h{level}").otherwise(tag)
    return F.when(is_list, "li").otherwise(tag)


def block_css(b: dict[str, Column]) -> Column:
    """CSS of a paragraph, null when nothing is set. Order: borders, alignment, indents, spacing."""
    borders = F.array_join(F.transform(
        b["borders"],
        lambda side: F.concat(
            F.lit("border-"), F.when(side == "between", "bottom").otherwise(side),
            F.lit(": 1px solid #000; padding: 5px;"))), " ")
    align = F.when(b["align"].isin("center", "right", "justify"),
                   F.concat(F.lit("text-align: "), b["align"], F.lit(";")))
    css = F.concat_ws(
        " ",
        F.when(borders != "", borders), align,
        _rule("margin-left", b["left_pt"]), _rule("margin-right", b["right_pt"]),
        _rule("text-indent", b["first_line_pt"]),
        F.when(b["first_line_pt"] < 0, "padding-left: 0;"),
        _rule("margin-top", b["before_pt"]), _rule("margin-bottom", b["after_pt"]),
    )
    return F.when(css != "", css)


def _open_tag(tag: Column, css: Column) -> Column:
    attr = F.coalesce(F.concat(F.lit(' style="'), css, F.lit('"')), F.lit(""))
    return F.concat(F.lit("<"), tag, attr, F.lit(">"))


def list_number(number: Column, suffix: Column) -> Column:
    """The span in front of a numbered block; nothing where the number is only a pattern."""
    plain = F.trim(F.regexp_replace(number, "%[123]", ""))
    spacing = F.lit("0.5em")
    for name, value in NUMBER_SPACING.items():
        spacing = F.when(suffix == name, value).otherwise(spacing)
    span = F.concat(F.lit('<span class="list-number" style="margin-right: '), spacing,
                    F.lit('; min-width: 1.5em; display: inline-block;">'), plain, F.lit("</span>"))
    return F.when(plain != "", span).otherwise("")


def wrap_lists(blocks: DataFrame, id_col: str, order: str, kind: str = "list_kind", html: str = "html") -> DataFrame:
    """Put ``<ul>`` or ``<ol>`` around each list in the HTML of its first and last item.

    Items of one kind that follow each other are a list; another kind, a block that is no
    item (a table too) and the end of the document close it.
    """
    numbered = list_runs(blocks, id_col, order, kind).withColumn("list_no", F.coalesce("list_no", F.lit(0)))
    ends = with_extremes(numbered, [id_col, "list_no"], order, {"__first": F.col(order)}, {"__last": F.col(order)})

    def tag(which: int) -> Column:
        out = F.lit("")
        for name, tags in LIST_TAGS.items():
            out = F.when(F.col(kind) == name, tags[which]).otherwise(out)
        return out

    opening = F.when(F.col(order) == F.col("__first"), tag(0)).otherwise("")
    closing = F.when(F.col(order) == F.col("__last"), tag(1)).otherwise("")
    return ends.withColumn(html, F.concat(opening, html, closing)).drop("__first", "__last", "list_no")


def render_blocks(blocks: DataFrame, body: str = "text_html", out: str = "html") -> DataFrame:
    """Add the HTML of each layout block (columns as in the ``blocks`` fixture; a number in
    ``number_text`` and its ``number_suffix`` may be there)."""
    is_list = F.col("list_kind").isNotNull()
    tag = block_tag(F.col("style_name"), is_list)
    css = block_css({c: F.col(c) for c in (
        "borders", "align", "left_pt", "right_pt", "first_line_pt", "before_pt", "after_pt")})
    number = list_number(F.col("number_text"), F.col("number_suffix")) if "number_text" in blocks.columns else F.lit("")
    return blocks.withColumn(out, F.concat(
        _open_tag(tag, css), F.coalesce(number, F.lit("")), F.coalesce(F.col(body), F.lit("")), F.lit("</"), tag, F.lit(">")))


def _switched_on(value: str) -> Column:
    """An XML on/off value: a bare element means on."""
    return ~F.lower(F.col(value)).isin("0", "false", "off")


def tri_state(run: str, rpr: str, ppr: str) -> Column:
    """Run value, else run property, else paragraph property, else off."""
    return F.coalesce(F.col(run), _switched_on(rpr), _switched_on(ppr), F.lit(False))


def render_runs(runs: DataFrame, out: str = "html") -> DataFrame:
    """Add the HTML of each text run; a span only where a style applies, '' for empty text."""
    text = escape_html(map_symbols("text", font="font"))
    css = F.concat_ws(
        " ",
        F.when(tri_state("bold", "bold_rpr", "bold_ppr"), "font-weight: bold;"),
        F.when(tri_state("italic", "italic_rpr", "italic_ppr"), "font-style: italic;"),
        F.when(F.col("underline"), "text-decoration: underline;"),
        F.when(F.col("size_pt") != 0,
               F.concat(F.lit("font-size: "), F.col("size_pt").cast("string"), F.lit("pt;"))),
        F.when(F.col("color").isNotNull(), F.concat(F.lit("color: #"), F.col("color"), F.lit(";"))),
    )
    span = F.concat(F.lit('<span style="'), css, F.lit('">'), text, F.lit("</span>"))
    return runs.withColumn(out, F.when(text == "", "").when(css == "", text).otherwise(span))


def join_runs(rendered: DataFrame, keys: list[str], order: str = "run_no", html: str = "html") -> DataFrame:
    """Runs of a paragraph as its inner HTML."""
    return assemble(rendered, keys, order, html, out="text_html")


def cell_spans(cells: DataFrame, keys: list[str], row: str = "row_no", col: str = "col_no") -> DataFrame:
    """First cell of each merged area with ``colspan`` and ``rowspan``.

    A cell continues the one above when both have the same ``cell_id``, and the one to the
    left likewise; a cell without an id is never merged. Rows of one column are ranked in blocks, so a table of any length works.
    """
    ids = keys + [col]
    alone = F.concat(F.lit("\0"), F.col(row).cast("string"), F.lit(":"), F.col(col).cast("string"))
    cells = cells.withColumn("__cell", F.coalesce(F.col("cell_id").cast("string"), alone))
    runs = number_islands(cells, ids, row, "__cell", "__run")
    # a merged run folds map-side; only its first row carries the cell's own values
    own = [c for c in cells.columns if c not in keys + [row, col]]
    tops = runs.groupBy(*ids, "__run").agg(
        F.min(row).alias(row), F.count(F.lit(1)).alias("rowspan"),
        F.min_by(F.struct(*own), row).alias("__own"),
    ).select(*ids, row, "rowspan", "__own.*")
    left = F.lag("__cell").over(Window.partitionBy(*keys, row).orderBy(col))
    return (
        tops.withColumn("__left", left)
        .where(~F.col("__cell").eqNullSafe(F.col("__left")))
        .withColumn("colspan", F.greatest(F.coalesce("grid_span", F.lit(1)), F.lit(1)).cast("long"))
        .drop("__left", "__cell", "grid_span")
    )


def render_cells(cells: DataFrame, text: str = "text", shading: str = "shading", out: str = "html") -> DataFrame:
    """HTML of each first cell; an empty one gets a blank so that its border shows.

    With a column ``borders`` (the cell's own sides, null where it names none) and
    ``table_borders`` (whether the table has any), a cell gets a class for each side.
    """
    def span(name: str) -> Column:
        return F.when(F.col(name) > 1, F.concat(F.lit(f'{name}="'), F.col(name).cast("string"), F.lit('"')))

    colour = F.when(F.col(shading) != "auto",
                    F.concat(F.lit('style="background-color: #'), F.col(shading), F.lit('"')))
    classes = F.lit(None).cast("string")
    if "borders" in cells.columns:
        every = F.array(*[F.lit(s) for s in BORDER_SIDES])
        sides = F.coalesce(F.col("borders"), F.when(F.col("table_borders"), every))
        named = F.array_join(F.transform(F.array_intersect(every, sides), lambda s: F.concat(F.lit("has-border-"), s)), " ")
        classes = F.when(named != "", F.concat(F.lit('class="'), named, F.lit('"')))
    attrs = F.concat_ws(" ", span("colspan"), span("rowspan"), classes, colour)
    body = F.coalesce(F.when(F.trim(F.col(text)) != "", F.col(text)), F.lit("&nbsp;"))
    return cells.withColumn(out, F.concat(
        F.lit("<td"), F.when(attrs != "", F.concat(F.lit(" "), attrs)).otherwise(""),
        F.lit(">"), body, F.lit("</td>")))


def render_tables(cells: DataFrame, keys: list[str], row: str = "row_no", col: str = "col_no",
                  html: str = "html") -> DataFrame:
    """``(keys, html)``: the rendered cells of a table in their rows.

    A table is one block of a document, so it fits a cell; rows are joined first.
    """
    rows = assemble(cells, [*keys, row], col, html, header="<tr>", footer="</tr>", out="html")
    return assemble(rows, keys, row, "html", header=TABLE_OPEN, footer="</table>", out="html")


def render_document(blocks: DataFrame, tables: DataFrame, id_col: str, order: str) -> DataFrame:
    """``(id, html)``: rendered blocks (id, order, list_kind, html) and tables (id, order, html)
    of a document in their order, lists wrapped."""
    both = blocks.select(id_col, order, "list_kind", "html").unionByName(
        tables.select(id_col, order, F.lit(None).cast("string").alias("list_kind"), "html"))
    return assemble(wrap_lists(both, id_col, order), id_col, order, "html", out="html")


def render_pages(blocks: DataFrame, id_col: str, page: str = "page_no", order: str = "block_no",
                 html: str = "html", header: str = "header_html", footer: str = "footer_html") -> DataFrame:
    """``(id, page_no, part_no, part_total, html)``: the blocks of a page between the
    document's header and footer. A page of very many blocks comes in several parts."""
    placed = number_rows(blocks, [id_col, page], order, "__i", total="__n")
    opening = F.concat(F.lit('<div class="page">'), F.coalesce(header, F.lit("")))
    closing = F.concat(F.coalesce(footer, F.lit("")), F.lit("</div>"))
    return assemble_parts(placed, [id_col, page], "__i", "__n", html, header=opening, footer=closing)
