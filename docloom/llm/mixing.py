"""Mixing sources to target weights: whole passes plus a subset whose sizes sum to the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import saved, shuffle_partitions, table, uniform

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 17
#: budget that the dynamic programme fits exactly, in words; cells of the draw of each size
DP_WORDS, CELLS = 1 << 16, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many of the ``counts[i]`` documents of ``sizes[i]`` words to take so that their words
    sum to ``budget`` as nearly as possible from below.

    Most of the budget is spread over all sizes in proportion. What is left goes to one more
    document of a size, largest first, down to ``dp_words``; the remainder is a bounded
    knapsack, each size's stock split into powers of two, over all sums up to the remainder.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if total == 0 or budget <= 0:
        return take
    if budget >= total:
        return counts.copy()
    take = (counts * (budget / total)).astype(np.int64)  # below a share of one, so never over budget
    rest = budget - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= dp_words:
            break
        if sizes[i]:
            more = min(int(counts[i] - take[i]), (rest - dp_words // 2) // int(sizes[i]))
            if more > 0:
                take[i] += more
                rest -= more * int(sizes[i])
    rest_dp = min(rest, 4 * dp_words)
    reached = np.zeros(rest_dp + 1, bool)
    reached[0] = True
    first = np.full(rest_dp + 1, -1, np.int32)
    parcels: list[tuple[int, int]] = []
    for i in np.argsort(sizes, kind="stable"):
        stock, size, k = int(counts[i] - take[i]), int(sizes[i]), 1
        while size and stock > 0 and size * min(k, stock) <= rest_dp and not reached[rest_dp]:
            k = min(k, stock)
            new = np.zeros_like(reached)
            new[k * size:] = reached[:-k * size] if k * size else reached
            new &= ~reached
            first[new] = len(parcels)
            reached |= new
            parcels.append((int(i), k))
            stock -= k
            k *= 2
        if reached[rest_dp]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s > 0:  # a sum's parcel is later than those of the sum below it: none is used twice
        i, k = parcels[first[s]]
        take[i] += k
        s -= k * int(sizes[i])
    return take


def _fit(batches_of_source: pd.DataFrame) -> pd.DataFrame:
    h = batches_of_source.sort_values("size")
    take = fit_counts(h["size"].to_numpy(), h["n"].to_numpy(), int(h["budget"].iloc[0]))
    return pd.DataFrame({"key": h["key"], "size": h["size"], "take": take})


def _numbered(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Each source with its weight by its place in code point order, null last."""
    spread = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    spread = saved(spread, "sources")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    before = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = spread.withColumn("r", inside).join(before.select("part", "before"), "part")
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("r") + F.col("before") - 1) % len(weights) + 1).cast("int"))
    return place.select("key", "source", "source_size", of.alias("weight"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source, source_size) to the same with ``target``.

    All sizes together are shared by weight; a target stops at ``most`` times its source's
    size, and the excess is shared again by weight among the others, until none is above.
    """
    named = saved(_numbered(sources, weights), "sources")
    cap = F.col("source_size") * float(most)
    total = float(named.agg(F.sum("source_size")).first()[0] or 0)
    capped = F.lit(False)
    while True:
        row = named.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
                        F.count(F.when(capped, 1))).first()
        rate = (total - (row[0] or 0.0)) / row[1] if row[1] else 0.0
        now = capped | (F.col("weight") * rate > cap)
        if named.where(now).count() == row[2]:
            return named.select("key", "source", "source_size", F.when(capped, cap).otherwise(F.col("weight") * rate).alias("target"))
        # the capped set only grows with the rate, so the last rate tells it
        capped = F.col("weight") * rate > cap


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with columns size, source_size, target, repeats, taken (docs' columns first).

    Sources are weighed by ``weights`` in turn, in code point order, null last. A source's
    target is met by whole passes over it, as many as fit, and a subset for the rest: its
    documents are counted by exact size, and a bounded knapsack over these counts says how
    many of each size go in once more; those are drawn by a seeded hash of id and text. So a
    source misses its target by less than a word where the sizes allow it. ``repeats`` is how
    often a document stands in the mix, ``taken`` its words there.

    A null or wordless text has size 0 and is never drawn beyond the passes. A null source is
    a source of its own, the last. Rows that agree in id and text go in together. A column
    named like an added one is replaced. An empty table gives an empty one; reruns agree.
    """
    extra = ["size", "source_size", "target", "repeats", "taken"]
    plain = [c for c in docs.columns if c not in extra]
    base = docs.select(*plain, word_count(F.col(text_col)).alias("size")).withColumn(
        "__key", F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))))
    u = uniform(F.lit(seed), F.col(id_col), F.col(text_col))
    base = base.withColumn("__u", u)
    slim = saved(base.select(F.col("__key").alias("key"), F.col(source_col).cast("string").alias("source"), "size",
                             F.col("__u").alias("u"), F.floor(F.col("__u") * CELLS).cast("int").alias("cell")), "sizes")
    by_cell = saved(slim.groupBy("key", "source", "size", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    counts = saved(by_cell.groupBy("key", "source", "size").agg(F.sum("n").alias("n")), "counts")
    sources = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    targets = saved(source_targets(sources, weights, most).withColumn("passes", passes).withColumn(
        "budget", F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long")), "targets")
    take = saved(counts.join(targets.select("key", "budget"), "key").select("key", "size", "n", "budget")
                 .repartition(shuffle_partitions(docs), "key").groupBy("key").applyInPandas(_fit, "key string, size long, take long"), "take")

    # the draw: whole cells of a size go in, in order; of the one cell where its number of
    # documents is reached, the rows of the least u
    upto = Window.partitionBy("key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = by_cell.join(take.where("take > 0"), ["key", "size"]).withColumn("upto", F.sum("n").over(upto))
    cells = saved(cells.withColumn("left", F.col("take") - (F.col("upto") - F.col("n"))).where("left > 0"), "drawn")
    edge = cells.where("left < n").select("key", "size", "cell", "left")
    ranked = slim.join(edge, ["key", "size", "cell"]).withColumn(
        "r", F.row_number().over(Window.partitionBy("key", "size").orderBy("u"))).where("r = left")
    whole = cells.where("left >= n").groupBy("key", "size").agg(F.max("cell").alias("last_cell"))
    plan = saved(
        counts.select("key", "size").join(whole, ["key", "size"], "left")
        .join(ranked.select("key", "size", F.col("u").alias("last_u")), ["key", "size"], "left")
        .join(targets.select("key", "source_size", "target", "passes"), "key"), "plan")
    out = base.withColumnRenamed("__key", "key").join(plan, ["key", "size"])
    drawn = (F.floor(F.col("__u") * CELLS) <= F.coalesce("last_cell", F.lit(-1))) | (F.col("__u") <= F.coalesce("last_u", F.lit(-1.0)))
    repeats = F.col("passes") + drawn.cast("long")
    return out.select(*plain, "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, columns as they are."""
    return mix(docs, seed=seed).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).where(
        "repeats > 0").select(docs.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_source_mix": op5_source_mix}
