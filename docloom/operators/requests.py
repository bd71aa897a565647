"""How many model requests a corpus needs, and how long pacing alone takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.fixed import CHUNK_GAP_S, ENGINES, PAGES_PER_CHUNK
from docloom.operators.translate import Engine, default_partitions, lanes_of


def plan_requests(segs: DataFrame, id_col: str = "doc_id",
                  engines: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """``(id, provider, segments, requests, paced_s)`` for each document and engine.

    The engines are a handful of literals, exploded next to each counted document.
    """
    table = F.array(*[
        F.struct(F.lit(n).alias("provider"), F.lit(size).alias("size"), F.lit(gap).alias("gap"))
        for n, size, gap in (engines or ENGINES)
    ])
    counted = segs.groupBy(id_col).agg(F.count(F.lit(1)).alias("segments"))
    rows = counted.select(id_col, "segments", F.explode(table).alias("e"))
    requests = F.ceil(F.col("segments") / F.col("e.size")).cast("long")
    return rows.select(
        id_col, F.col("e.provider").alias("provider"), "segments", requests.alias("requests"),
        ((requests - 1) * F.col("e.gap")).cast("long").alias("paced_s"))


def plan_rates(segs: DataFrame, engines: dict[str, Engine], engine_col: str = "llm_provider",
               language_col: str = "target_language", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """What :func:`translate_by_engine` will ask for: ``(engine, segments, requests, lanes, paced_s)``.

    ``segs`` are the distinct rows it will be given. Requests are exact: they are counted by
    language and by the task in which they will be formed. ``paced_s`` is what the gaps alone take
    for all tasks of the engine together; retries and split batches come on top.
    """
    n = default_partitions(segs, partitions)
    plan, _ = lanes_of({name: e.policy for name, e in engines.items()}, n)
    facts = F.create_map(*[x for name, e in engines.items() for x in (F.lit(name), F.struct(
        F.lit(e.batch_size).alias("size"), F.lit(plan[name][1]).alias("lanes"), F.lit(float(e.policy.gap)).alias("gap")))])
    fact = F.try_element_at(facts, F.col(engine_col))
    lane = F.pmod(F.xxhash64(engine_col, language_col, text_col), fact["lanes"])
    groups = segs.where(F.col(engine_col).isin(list(engines))).groupBy(engine_col, language_col, lane.alias("__lane")).agg(
        F.count(F.lit(1)).alias("n"))
    totals = groups.groupBy(engine_col).agg(
        F.sum("n").alias("segments"), F.sum(F.ceil(F.col("n") / fact["size"])).alias("requests"))
    return totals.select(engine_col, "segments", "requests", fact["lanes"].cast("long").alias("lanes"),
                         ((F.col("requests") - 1) * fact["gap"]).alias("paced_s"))


def plan_chunk_stream(pages: DataFrame, id_col: str = "doc_id", per_chunk: int = PAGES_PER_CHUNK,
                      gap: int = CHUNK_GAP_S) -> DataFrame:
    """The same for page lists sent in chunks: ``(id, pages, requests, paced_s)``."""
    requests = F.ceil(F.col("pages") / per_chunk).cast("long")
    return pages.groupBy(id_col).agg(F.count(F.lit(1)).alias("pages")).select(
        id_col, "pages", requests.alias("requests"), ((requests - 1) * gap).cast("long").alias("paced_s"))
