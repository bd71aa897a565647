"""Cut documents into segments, batches and page chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.text import trim_ws
from docloom.operators.ordering import number_rows

DENSE_BLOCK = 256


def segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             trim: bool = True, keep: list[str] | None = None) -> DataFrame:
    """One row for each non-blank line: ``(id, seg_no, text)``. No shuffle. A null text has
    no lines."""
    lines = df.select(
        id_col, *(keep or []), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("seg_no", "__line")
    )
    trimmed = trim_ws("__line")
    return lines.where(trimmed != "").select(
        id_col, *(keep or []), F.col("seg_no").cast("long").alias("seg_no"),
        (trimmed if trim else F.col("__line")).alias("text"),
    )


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line, so that a document can be put together whole: ``(id, seg_no, text, blank)``.

    ``text`` is the trimmed segment, null for a blank line, which stands in ``blank``. A null
    text is one blank line, so its document does not get lost.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    lines = df.select(id_col, F.posexplode(F.split(whole, "\n", -1)).alias("seg_no", "__line"))
    trimmed = trim_ws("__line")
    return lines.select(
        id_col, F.col("seg_no").cast("long").alias("seg_no"),
        F.when(trimmed != "", trimmed).alias("text"),
        F.when(trimmed == "", F.col("__line")).alias("blank"))


def distinct_segments(segs: DataFrame, scope: str = "corpus", id_col: str = "doc_id",
                      text_col: str = "text", order: str = "seg_no") -> DataFrame:
    """Each text once, per document or over the corpus, with its number of uses.

    A plain grouped count: repeated lines are folded before the shuffle, so a line
    that makes up a third of the corpus is one row for each map task.
    """
    if scope == "doc":
        return segs.groupBy(id_col, text_col).agg(
            F.count(F.lit(1)).alias("uses"), F.min(order).alias("first_seg"))
    if scope != "corpus":
        raise ValueError("scope is 'doc' or 'corpus'")
    return segs.groupBy(text_col).agg(
        F.count(F.lit(1)).alias("uses"), F.min(id_col).alias("first_doc"))


def batch_segments(segs: DataFrame, size: int, id_col: str = "doc_id",
                   order: str = "first_seg") -> DataFrame:
    """Consecutive groups of ``size`` segments of a document, by first position."""
    ranked = number_rows(segs, id_col, order, "__rank")
    return ranked.withColumn("batch_no", F.floor(F.col("__rank") / size).cast("long")).withColumn(
        "pos", (F.col("__rank") % size).cast("long")).drop("__rank")


def _not_dense(id_col: str):
    return F.raise_error(F.concat(F.lit("page numbers are not 0, 1, 2, ... in document "), F.col(id_col).cast("string")))


def _whole(n: int):
    """A chunk of dense pages has every number once."""
    numbers = F.transform("__pages", lambda x: x["o"])
    expected = F.least(F.lit(n).cast("long"), F.col("__n") - F.col("chunk_index") * n)
    return (F.size(numbers) == expected) & (F.size(F.array_distinct(numbers)) == expected)


def chunk_pages(pages: DataFrame, id_col: str = "doc_id", order: str = "page_no",
                html: str = "html", n: int = fixed.PAGES_PER_CHUNK, dense: bool = False) -> DataFrame:
    """``n`` consecutive pages for each row: ``(id, chunk_index, chunk_total, pages)``.

    ``dense`` says that page numbers are 0, 1, 2, … without gaps, so the position is the
    number itself and the page bodies are shuffled once instead of twice. A document whose
    numbers have gaps or repeats raises an error.
    """
    body = pages.select(id_col, order, html)
    if dense:
        # a block holds whole chunks, so the join's partitioning serves the grouping too
        blk = F.floor(F.col(order) / (n * DENSE_BLOCK)).cast("long")
        totals = (
            pages.groupBy(id_col).agg((F.max(order) + 1).alias("__n"), F.count(F.lit(1)).alias("__rows"))
            .withColumn("__n", F.when(F.col("__rows") == F.col("__n"), F.col("__n")).otherwise(_not_dense(id_col)))
            .select(id_col, "__n", F.explode(
                F.sequence(F.lit(0).cast("long"),
                           F.floor((F.col("__n") - 1) / (n * DENSE_BLOCK)).cast("long"))).alias("__blk"))
        )
        ranked = body.withColumn("__blk", blk).join(totals, [id_col, "__blk"]).withColumn(
            "__rank", F.col(order).cast("long"))
        keys = [id_col, "__blk", "chunk_index"]
    else:
        ranked = number_rows(body, id_col, order, "__rank", total="__n")
        keys = [id_col, "chunk_index"]
    return (
        ranked.withColumn("chunk_index", F.floor(F.col("__rank") / n).cast("long"))
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("o"), F.col(html).alias("p"))))
            .alias("__pages"),
            F.max("__n").alias("__n"),
        )
        .where(F.when(_whole(n) if dense else F.lit(True), True).otherwise(_not_dense(id_col)).cast("boolean"))
        .select(
            id_col, "chunk_index", F.ceil(F.col("__n") / n).cast("long").alias("chunk_total"),
            F.transform("__pages", lambda x: x["p"]).alias("pages"),
        )
    )


def wrap_chunk(chunks: DataFrame, pages: str = "pages", out: str = "html") -> DataFrame:
    """A chunk as one HTML document."""
    return chunks.withColumn(
        out, F.concat(F.lit(fixed.HTML_HEADER), F.array_join(pages, ""), F.lit(fixed.HTML_FOOTER)))
