"""Shards by vector bin packing: bytes, tokens and rows balanced together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import saved, table
from docloom.llm.mixing import word_count

SHARDS, ITEMS, SEED = 16, 4096, 5


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each item, a row of (bytes, tokens, rows).

    All sizes are shares of the mean shard. Large items go first, each to the shard where the
    dot product of its sizes with what the shard has left is highest, of those whose bytes it
    fits; where it fits none, to the one with the most bytes left. So the bytes of the shards
    differ by a small item at most. Ties go to the lower shard.
    """
    total = items.sum(0).astype(float)
    share = items * (shards / np.where(total > 0, total, 1))
    left = np.ones((shards, items.shape[1])) * (total > 0)
    out = np.zeros(len(items), np.int32)
    for i in np.lexsort((np.arange(len(items)), -share.sum(1))):
        fits = left[:, 0] >= share[i, 0]
        s = int(np.argmax(np.where(fits, left @ share[i], -np.inf) if fits.any() else left[:, 0]))
        out[i] = s
        left[s] -= share[i]
    return out


def _place(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "item", "piece"]).reset_index(drop=True)
        rows["shard"] = place(rows[["bytes", "tokens", "rows"]].to_numpy(), shards)
        return rows[["kind", "item", "piece", "shard", "rows"]]

    return run


def pack_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    items: int = ITEMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """(id, size, tokens, text_crc32, shard, slot): shards of nearly equal bytes, words and rows.

    Documents of equal text are a group, and a group stays in one shard. What is placed are
    at most about 2 * ``items`` items, whatever the table's size: groups with a share of over
    1 / ``items`` of all bytes or rows are items of their own, the others are dealt by the hash
    of their text to ``items`` items. Only a group of over half a mean shard is cut into
    pieces of that size, by the hash of the id: left whole, it would unbalance the shards.
    ``place`` puts the items into shards. A slot numbers a shard's rows without gaps, by item,
    then by a hash of the id; rows are numbered inside small blocks of an item.

    A null or empty text has size 1 (its end), no words and crc32 0; null and empty texts are
    one group. Rows with equal ids are rows of their own; a null id is a value like any other.
    Other columns are not read; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = saved(docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        word_count(text).alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(seed), text).alias("b"),
        F.xxhash64(F.lit(seed + 1), F.col(id_col)).alias("h")), "documents")
    groups = base.groupBy("a", "b").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                        F.sum("tokens").alias("tokens"))
    groups = saved(groups, "groups")
    total = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    all_bytes, all_rows = total[0] or 1, total[1] or 1
    load = F.greatest(F.col("bytes") / F.lit(float(all_bytes)), F.col("rows") / F.lit(float(all_rows)))
    heavy = saved(groups.withColumn("load", load).where(F.col("load") > 1 / items).select(
        "a", "b", F.greatest(F.lit(1), F.ceil(F.col("load") * (2 * shards))).cast("int").alias("pieces")), "heavy")
    # a heavy group has its share of the whole, so there are at most 2 * items of them
    named = base.join(F.broadcast(heavy), ["a", "b"], "left")
    is_heavy = F.col("pieces").isNotNull()
    named = saved(named.select(
        "id", "size", "tokens", "text_crc32", "h", F.when(is_heavy, 1).otherwise(0).alias("kind"),
        F.when(is_heavy, F.xxhash64("a", "b")).otherwise(F.pmod("a", F.lit(items))).alias("item"),
        F.when(is_heavy, F.pmod("h", "pieces")).otherwise(0).cast("int").alias("piece")), "named")
    keys = ["kind", "item", "piece"]
    loads = named.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"),
                                     F.count(F.lit(1)).alias("rows"))
    placed = saved(loads.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        _place(shards), "kind int, item long, piece int, shard int, rows long"), "placed")
    # an item's rows are numbered in blocks of about 1 / items of all rows
    in_blocks = F.ceil(F.col("rows") * items / F.lit(all_rows)).cast("int")
    dealt = saved(named.join(F.broadcast(placed), keys).withColumn(
        "block", F.pmod(F.shiftright("h", 20), in_blocks).cast("int")).drop("rows"), "dealt")
    order = Window.partitionBy("shard").orderBy(*keys, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("shard", *keys, "block").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("shard", *keys, "block").orderBy("h", "id"))
    return (
        dealt.withColumn("number", number - 1)
        .join(F.broadcast(blocks.select(*keys, "block", "before")), [*keys, "block"])  # about 3 * items rows
        .select(F.col("id").alias(id_col), "size", "tokens", "text_crc32", "shard",
                (F.col("before") + F.col("number")).alias("slot"))
    )


def op8_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_vector_shards": op8_vector_shards}
