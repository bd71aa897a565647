"""Read HTML documents as blocks, inline runs and table cells.

A block starts at a block-level tag and ends at the next one, so unclosed
paragraphs are well defined. Scripts, styles and comments are removed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import trim_ws, unescape_html

NOISE = r"(?i)<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>|<!--[\s\S]*?-->"
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form"
    r"|h[1-6]|head|header|hr|html|li|main|meta|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead"
    r"|title|tr|ul)(?:\s[^>]*)?/?>"
)
KEPT_TAG = r"(?i)^<(h[1-6]|p|li|td|th)[\s/>]"
IMG_TAG = r"(?i)<img[^>]*>"
ANY_TAG = r"</?[a-zA-Z!][^<>]*>"
STYLE_ATTR = r"""(?i)\sstyle=(?:"([^"]*)"|'([^']*)')"""
HEADER_DIV = r'<div class="docx-header">([\s\S]*?)</div>'
FOOTER_DIV = r'<div class="docx-footer">([\s\S]*?)</div>'
TABLE_TAG = r"(?i)<(/?)(table|tr|td|th)(?:\s[^>]*)?>"


def _style(tag: Column) -> Column:
    return F.concat(F.regexp_extract(tag, STYLE_ATTR, 1), F.regexp_extract(tag, STYLE_ATTR, 2))


def inline_text(piece: Column) -> Column:
    """Text of an inline fragment: line breaks kept, tags dropped, entities decoded."""
    broken = F.regexp_replace(piece, r"(?i)<br\s*/?>", "\n")
    return unescape_html(F.regexp_replace(broken, ANY_TAG, ""))


def _block(section: Column, kind: Column, level: Column, style: Column, raw: Column, text: Column) -> Column:
    return F.struct(
        section.alias("section"), kind.alias("kind"), level.alias("level"),
        style.alias("style"), raw.alias("raw"), text.alias("text"))


def _blocks_of(section: str, html: str) -> Column:
    """Array of blocks of one HTML column; images follow the block that holds them."""
    tags = F.regexp_extract_all(F.col(html), F.lit(BLOCK_TAG), F.lit(0))
    after = F.slice(F.split(F.col(html), BLOCK_TAG, -1), F.lit(2), F.length(html) + 1)
    none = F.lit(None).cast("int")
    read = F.transform(
        F.arrays_zip(tags.alias("tag"), after.alias("raw")),
        lambda x: F.struct(
            x["tag"].alias("tag"), x["raw"].alias("raw"),
            F.lower(F.regexp_extract(x["tag"], KEPT_TAG, 1)).alias("kind")),
    )

    def rows(x: Column) -> Column:
        kind = x["kind"]
        level = F.when(F.startswith(kind, F.lit("h")), F.substring(kind, 2, 1).cast("int")).otherwise(none)
        block = _block(F.lit(section), kind, level, _style(x["tag"]), x["raw"], trim_ws(inline_text(x["raw"])))
        images = F.transform(
            F.regexp_extract_all(x["raw"], F.lit(IMG_TAG), F.lit(0)),
            lambda m: _block(F.lit(section), F.lit("img"), none, _style(m), m,
                             F.regexp_extract(m, r"""(?i)\ssrc=["']([^"']*)["']""", 1)),
        )
        return F.when(kind != "", F.concat(F.array(block), images)).otherwise(images)

    return F.flatten(F.transform(read, rows))


def html_blocks(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, block_no, section, kind, level, style, raw, text)``: one row for each heading,
    paragraph, list item, cell or image, in order. Header and footer divs come first as
    their own sections. All inside one row of input, so nothing is shuffled."""
    clean = df.select(id_col, F.regexp_replace(F.col(html_col), NOISE, "").alias("__html"))
    parts = clean.select(
        id_col,
        F.regexp_extract("__html", HEADER_DIV, 1).alias("__header"),
        F.regexp_extract("__html", FOOTER_DIV, 1).alias("__footer"),
        F.regexp_replace(F.regexp_replace("__html", HEADER_DIV, ""), FOOTER_DIV, "").alias("__body"),
    )
    blocks = F.concat(_blocks_of("header", "__header"), _blocks_of("footer", "__footer"),
                      _blocks_of("body", "__body"))
    rows = parts.select(id_col, F.posexplode(blocks).alias("block_no", "b"))
    return rows.select(id_col, F.col("block_no").cast("long").alias("block_no"), "b.*")


def block_styles(df: DataFrame, style_col: str = "style") -> DataFrame:
    """Alignment (first known one), background colour and width in points from inline CSS."""
    s = F.col(style_col)
    align = F.lit(None).cast("string")
    for name in ("justify", "right", "center"):
        align = F.when(F.contains(s, F.lit(f"text-align: {name}")), name).otherwise(align)
    colour = F.regexp_extract(s, r"background-color:\s*#([0-9a-fA-F]+)", 1)
    width = F.regexp_extract(s, r"width:\s*([\d.]+)pt", 1)
    return df.select(
        "*", align.alias("align"),
        F.when(colour != "", colour).alias("background"),
        width.try_cast("double").alias("width_pt"),
    )


INLINE_TOKEN = f"{ANY_TAG}|[^<]+|<"
RUN_TAG = r"(?i)^<(/?)(strong|b|em|i|u|span)(?:\s[^>]*)?>$"


FOLD = 128
_CUT, _KEPT = "\x01", "\x01\x02"


def _fold_in_groups(items: Column, start: Column, step, emitted: str) -> Column:
    """``aggregate`` for a state that collects in the array field ``emitted``.

    Appending to an array copies it, so one plain fold takes quadratic time on a long list.
    Groups of ``FOLD`` items are folded on their own and joined group by group.
    """
    grouped = F.get(F.transform(F.array(items), lambda t: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(t) / FOLD).cast("int")),
        lambda g: F.slice(t, g * FOLD + 1, F.lit(FOLD)))), F.lit(0))

    def one_group(acc: Column, group: Column) -> Column:
        fresh = acc.withField(emitted, F.slice(acc[emitted], F.lit(1), F.lit(0)))
        inner = F.aggregate(group, fresh, step)
        return F.get(F.transform(F.array(inner), lambda r: r.withField(
            emitted, F.concat(acc[emitted], r[emitted]))), F.lit(0))

    return F.aggregate(grouped, start, one_group)


def inline_runs(blocks: DataFrame, keys: list[str], raw_col: str = "raw") -> DataFrame:
    """``(keys, run_no, text, bold, italic, underline)`` of each block.

    The outermost formatting tag wins and swallows what is nested in it; other tags are
    transparent; a line break outside a formatting tag is a run of its own. A fold over
    the tokens of one block, without a shuffle.
    """
    piece = "array<struct<text:string,first:boolean,tag:string,attrs:string>>"
    blank = F.lit("")
    # each token is read once here; the fold below only looks at the fields
    tokens = F.transform(
        F.regexp_extract_all(F.col(raw_col), F.lit(INLINE_TOKEN), F.lit(0)),
        lambda t: F.struct(
            F.when(F.length(t) > 1, F.when(F.startswith(t, F.lit("<")), t)).alias("markup"),
            F.lower(F.regexp_extract(t, RUN_TAG, 2)).alias("tag"),
            F.startswith(t, F.lit("</")).alias("closing"),
            F.regexp_like(t, F.lit(r"(?i)^<br\s*/?>$")).alias("is_break"),
            F.replace(unescape_html(t), F.lit(_CUT), F.lit(_KEPT)).alias("text")),
    )

    def state(tag, attrs, depth, pieces):
        return F.struct(tag.alias("tag"), attrs.alias("attrs"), depth.alias("depth"), pieces.alias("pieces"))

    def add(pieces, text, first, tag, attrs):
        return F.concat(pieces, F.array(F.struct(
            text.alias("text"), F.lit(first).alias("first"), tag.alias("tag"), attrs.alias("attrs"))))

    def step(acc: Column, t: Column) -> Column:
        tag, closing, text = t["tag"], t["closing"], t["text"]
        inside = acc["depth"] > 0
        same = inside & (tag == acc["tag"])
        deeper = state(acc["tag"], acc["attrs"], acc["depth"] + F.when(closing, -1).otherwise(1), acc["pieces"])
        opened = state(tag, t["markup"], F.lit(1), add(acc["pieces"], blank, True, tag, t["markup"]))
        broken = state(blank, blank, acc["depth"], add(acc["pieces"], F.lit("\n"), True, blank, blank))
        grown = state(acc["tag"], acc["attrs"], acc["depth"], add(acc["pieces"], text, False, blank, blank))
        plain = state(blank, blank, acc["depth"], add(acc["pieces"], text, True, blank, blank))
        return (
            F.when(same, deeper)
            .when(~inside & (tag != "") & ~closing, opened)
            .when(~inside & t["is_break"], broken)
            .when(t["markup"].isNotNull(), acc)
            .when(inside, grown)
            .otherwise(plain)
        )

    start = state(blank, blank, F.lit(0), F.array().cast(piece))
    pieces = blocks.select(*keys, _fold_in_groups(tokens, start, step, "pieces")["pieces"].alias("__p"))
    # pieces of one run become one text: mark where runs start, join, and cut at the marks
    marked = F.array_join(F.transform("__p", lambda p: F.when(
        p["first"], F.concat(F.lit(_CUT), p["text"])).otherwise(p["text"])), "")
    texts = F.slice(F.split(marked, f"{_CUT}(?!\x02)", -1), F.lit(2), F.size("__p") + 1)
    runs = pieces.select(*keys, F.posexplode(F.arrays_zip(
        texts.alias("text"), F.filter("__p", lambda p: p["first"]).alias("p"))).alias("run_no", "r"))
    css = F.when(F.col("r.p.tag") == "span", _style(F.col("r.p.attrs"))).otherwise("")

    def styled(tags: list[str], rule: str) -> Column:
        return F.col("r.p.tag").isin(tags) | F.contains(css, F.lit(rule))

    return runs.where(F.col("r.text") != "").select(
        *keys, F.col("run_no").cast("long").alias("run_no"),
        F.replace("r.text", F.lit(_KEPT), F.lit(_CUT)).alias("text"),
        styled(["strong", "b"], "font-weight: bold").alias("bold"),
        styled(["em", "i"], "font-style: italic").alias("italic"),
        styled(["u"], "text-decoration: underline").alias("underline"),
    )


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table_cells(df: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """``(id, table_no, row_no, col_no, kind, text, background, n_cols)`` of outermost tables.

    A table inside a cell is text of that cell. Tables without cells give no rows. One fold over
    the table tags of a document, inside its row: nothing is shuffled, and rows that share an id
    are documents of their own.
    """
    holds = F.contains(F.lower(F.col(html_col)), F.lit("<table"))
    docs = df.where(holds).select(id_col, F.regexp_replace(F.col(html_col), NOISE, "").alias("__html"))
    html = F.col("__html")
    tokens = F.transform(F.arrays_zip(
        F.regexp_extract_all(html, F.lit(TABLE_TAG), F.lit(0)).alias("tag"),
        F.slice(F.split(html, TABLE_TAG, -1), F.lit(2), F.length(html) + 1).alias("piece"),
    ), lambda t: F.struct(
        t["tag"].alias("tag"), F.replace(t["piece"], F.lit(_CUT), F.lit(_KEPT)).alias("piece"),
        F.lower(F.regexp_extract(t["tag"], TABLE_TAG, 2)).alias("name"),
        (F.regexp_extract(t["tag"], TABLE_TAG, 1) == "").alias("opening")))

    # what is collected: the pieces of cells, the first of each with the cell's place, and at
    # the end of each table how wide it was (then ``kind`` is null)
    piece = "array<struct<text:string,first:boolean,table_no:int,row_no:int,col_no:int,kind:string,tag:string,width:int>>"

    def state(depth, table_no, row, cell_row, row_no, col_no, width, in_cell, pieces) -> Column:
        return F.struct(
            depth.alias("depth"), table_no.alias("table_no"), row.alias("row"), cell_row.alias("cell_row"),
            row_no.alias("row_no"), col_no.alias("col_no"), width.alias("width"), in_cell.alias("in_cell"), pieces.alias("pieces"))

    def end_of_table(acc: Column) -> Column:
        none = F.lit(None)
        return F.array(F.struct(
            F.lit("").alias("text"), F.lit(False).alias("first"), acc["table_no"].alias("table_no"), none.cast("int").alias("row_no"),
            none.cast("int").alias("col_no"), none.cast("string").alias("kind"), none.cast("string").alias("tag"),
            acc["width"].alias("width")))

    def step(acc: Column, t: Column) -> Column:
        table, opening = t["name"] == "table", t["opening"]
        depth = acc["depth"] + F.when(table, F.when(opening, 1).otherwise(-1)).otherwise(0)

        def seen(depth: Column) -> Column:
            outer = depth == 1
            opens = outer & opening
            return F.struct(
                depth.alias("depth"), (opens & table).alias("table"), (opens & (t["name"] == "tr")).alias("row"),
                (opens & t["name"].isin("td", "th")).alias("cell"),
                # a piece goes to the cell before it unless a tag of the outermost table stands between
                ((outer & (~table | opening)) | (depth <= 0)).alias("edge"))

        def placed(e: Column) -> Column:
            row = acc["row"] + e["row"].cast("int")
            same = acc["cell_row"] == row
            return F.struct(
                e["depth"].alias("depth"), e["table"].alias("table"), e["cell"].alias("cell"),
                (acc["table_no"] + e["table"].cast("int")).alias("table_no"), row.alias("row"),
                F.when(e["table"], -1).when(e["cell"], row).otherwise(acc["cell_row"]).alias("cell_row"),
                F.when(e["table"], -1).when(e["cell"] & ~same, acc["row_no"] + 1).otherwise(acc["row_no"]).alias("row_no"),
                F.when(e["cell"], F.when(same, acc["col_no"] + 1).otherwise(0)).otherwise(acc["col_no"]).alias("col_no"),
                F.when(e["edge"], e["cell"]).otherwise(acc["in_cell"]).alias("in_cell"))

        def next_state(n: Column) -> Column:
            new = F.array(F.struct(
                t["piece"].alias("text"), n["cell"].alias("first"), n["table_no"].alias("table_no"), n["row_no"].alias("row_no"),
                n["col_no"].alias("col_no"), t["name"].alias("kind"), t["tag"].alias("tag"), F.lit(0).alias("width")))
            pieces = F.when(n["table"], F.concat(acc["pieces"], end_of_table(acc))).when(
                n["in_cell"], F.concat(acc["pieces"], new)).otherwise(acc["pieces"])
            width = F.when(n["table"], 0).when(n["cell"], F.greatest(acc["width"], n["col_no"] + 1)).otherwise(acc["width"])
            return state(n["depth"], n["table_no"], n["row"], n["cell_row"], n["row_no"], n["col_no"], width, n["in_cell"], pieces)

        return _bound(_bound(_bound(depth, seen), placed), next_state)

    zero, below = F.lit(0), F.lit(-1)
    start = state(zero, below, zero, below, below, zero, zero, F.lit(False), F.array().cast(piece))
    folded = docs.select(id_col, _fold_in_groups(tokens, start, step, "pieces").alias("__s"))
    collected = folded.select(id_col, F.concat("__s.pieces", end_of_table(F.col("__s"))).alias("__p")).select(
        id_col, F.filter("__p", lambda p: p["kind"].isNotNull()).alias("__p"),
        # the first width is that of what stands before any table
        F.transform(F.filter("__p", lambda p: p["kind"].isNull()), lambda p: p["width"]).alias("__w"))
    marked = F.array_join(F.transform("__p", lambda p: F.when(
        p["first"], F.concat(F.lit(_CUT), p["text"])).otherwise(p["text"])), "")
    bodies = F.slice(F.split(marked, f"{_CUT}(?!\x02)", -1), F.lit(2), F.size("__p") + 1)
    cells = collected.select(id_col, "__w", F.explode(F.arrays_zip(
        bodies.alias("body"), F.filter("__p", lambda p: p["first"]).alias("c"))).alias("x"))
    colour = F.regexp_extract(_style(F.col("x.c.tag")), r"background-color:\s*#([0-9a-fA-F]+)", 1)
    return cells.select(
        id_col, F.col("x.c.table_no").cast("long").alias("table_no"), F.col("x.c.row_no").cast("long").alias("row_no"),
        F.col("x.c.col_no").cast("long").alias("col_no"), F.col("x.c.kind").alias("kind"),
        trim_ws(inline_text(F.replace("x.body", F.lit(_KEPT), F.lit(_CUT)))).alias("text"),
        F.when(colour != "", colour).alias("background"),
        F.get("__w", F.col("x.c.table_no") + 1).cast("long").alias("n_cols"))
