"""Put translated parts back together, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators.ordering import join_in_order


def assemble(df: DataFrame, ids: str | list[str], order: str, part: str | dict[str, str] = "html",
             sep: str = "", header: str = "", footer: str = "", out: str = "html") -> DataFrame:
    """One row for each document with its parts joined in order.

    ``part`` may name several columns, as ``{out: column}``: original and translation come
    from one shuffle. For documents that came from one row and so fit one cell again; a page
    list without such a bound goes through :func:`assemble_parts`.
    """
    ids = [ids] if isinstance(ids, str) else ids
    parts = part if isinstance(part, dict) else {out: part}
    body = df.groupBy(*ids).agg(*[join_in_order(order, c, sep).alias(name) for name, c in parts.items()])
    return body.select(*ids, *[
        F.concat(F.lit(header), F.col(name), F.lit(footer)).alias(name) for name in parts])


def assemble_parts(df: DataFrame, ids: str | list[str], index: str = "chunk_index",
                   total: str = "chunk_total", part: str = "html", per_part: int = 1024,
                   header: str | Column = fixed.HTML_HEADER,
                   footer: str | Column = fixed.HTML_FOOTER) -> DataFrame:
    """``(ids, part_no, part_total, html)``; the parts joined by number are the document.

    A part holds ``per_part`` consecutive chunks, so no task ever holds more, however
    long a document is. Nearly all documents have just part 0, which is then the whole.
    ``index`` counts from 0 without gaps and ``total`` is the count, as chunking gives them.
    A header or footer column has one value within a document.
    """
    ids = [ids] if isinstance(ids, str) else ids
    header = header if isinstance(header, Column) else F.lit(header)
    footer = footer if isinstance(footer, Column) else F.lit(footer)
    parts = (
        df.withColumn("part_no", F.floor(F.col(index) / per_part).cast("long"))
        .groupBy(*ids, "part_no")
        .agg(join_in_order(index, part).alias("__body"),
             F.ceil(F.max(total) / per_part).cast("long").alias("part_total"),
             F.coalesce(F.max(header), F.lit("")).alias("__head"),
             F.coalesce(F.max(footer), F.lit("")).alias("__foot"))
    )
    first = F.when(F.col("part_no") == 0, F.col("__head")).otherwise("")
    last = F.when(F.col("part_no") == F.col("part_total") - 1, F.col("__foot")).otherwise("")
    return parts.select(
        *ids, "part_no", "part_total", F.concat(first, F.col("__body"), last).alias("html"))
