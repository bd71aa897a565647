"""The event log of a translation stream: one ``data:`` line for each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import trim_ws
from docloom.operators.ordering import running_sums

EVENT_SCHEMA = (
    "type string, index long, total long, done long, html string, original_html string, "
    "language string, provider string, translated_pdf_b64 string"
)


def format_event(event: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(event))


def parse_event_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of the ``data:`` lines; comments and keep-alive lines are skipped."""
    others = [c for c in lines.columns if c != value]
    rows = lines.where(F.startswith(value, F.lit("data:")))
    event = F.from_json(trim_ws(F.substr(value, F.lit(6))), EVENT_SCHEMA)
    return rows.select(*others, event.alias("e")).select(*others, "e.*")


REQUIRED_DONE = ("html", "original_html", "language", "provider")


def check_event_order(events: DataFrame, id_col: str = "doc_id", pos: str = "pos") -> DataFrame:
    """One row for each stream: are the chunk indices 0, 1, 2, …, is there exactly one
    ``done`` and is it last, does it have its keys?

    Everything folds into one grouped aggregate once each chunk knows its rank, so a very
    long stream is never in one task.
    """
    is_chunk, is_done = F.col("type") == "chunk", F.col("type") == "done"
    ranked = running_sums(events, id_col, pos, {"__rank": F.when(is_chunk, 1).otherwise(0)})
    keys = [F.col(k).isNotNull() for k in REQUIRED_DONE]
    complete = keys[0] & keys[1] & keys[2] & keys[3]
    agg = ranked.groupBy(id_col).agg(
        F.count_if(is_chunk).alias("chunks"),
        F.count_if(is_chunk & ~F.col("index").eqNullSafe(F.col("__rank") - 1)).alias("misplaced"),
        F.count_if(is_done).alias("dones"),
        F.count_if(is_done & ~complete).alias("incomplete"),
        F.max(F.when(is_done, F.col(pos))).alias("done_at"),
        F.max(pos).alias("last_at"),
    )
    return agg.select(
        id_col, "chunks",
        (F.col("misplaced") == 0).alias("contiguous"),
        (F.col("dones") == 1).alias("one_done"),
        F.coalesce(F.col("done_at") == F.col("last_at"), F.lit(False)).alias("done_last"),
        ((F.col("dones") > 0) & (F.col("incomplete") == 0)).alias("keys_present"),
    )
