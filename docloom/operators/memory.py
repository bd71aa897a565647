"""Translation memory: look texts up, find what is missing, write results back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ordering import with_extremes

SALTS = 64
MAX_HOT = 10_000
MIN_HOT_USES = 10_000


def apply_memory(segs: DataFrame, memory: DataFrame, on: list[str] | None = None,
                 value: str = "translated", hot: DataFrame | None = None) -> DataFrame:
    """Left join on the exact text (or its key): adds ``value``, null where unknown.

    ``memory`` holds each key once. A text may make up a third of all segments; pass
    ``hot`` (from :func:`hot_keys`) to spread such keys over ``SALTS`` tasks. Without it
    adaptive execution still splits a skewed join partition.
    """
    on = on or ["text"]
    right = memory.select(*on, value)
    if hot is None:
        return segs.join(right, on, "left")
    # hot_keys gives at most MAX_HOT hashes of 8 bytes, whatever the size of the corpus. A
    # hash collision only salts one more key; the join itself compares the keys.
    h = F.xxhash64(*on)
    marks = F.broadcast(hot.select(F.col("__h").alias("__hot")))
    others = [c for c in segs.columns if c not in on] or on
    zero = F.lit(0).cast("long")
    # rows without a key match nothing and would all meet in one task: spread them too
    anywhere = F.col("__hot").isNotNull() | F.col(on[0]).isNull()
    left = (
        segs.withColumn("__h", h).join(marks, F.col("__h") == F.col("__hot"), "left")
        .withColumn("__salt", F.when(anywhere, F.pmod(F.xxhash64(*others), F.lit(SALTS))).otherwise(zero))
        .drop("__h", "__hot")
    )
    copies = F.when(F.col("__hot").isNotNull(), F.sequence(zero, F.lit(SALTS - 1).cast("long"))
                    ).otherwise(F.array(zero))
    spread = (
        right.withColumn("__h", h).join(marks, F.col("__h") == F.col("__hot"), "left")
        .select(*on, value, F.explode(copies).alias("__salt"))
    )
    return left.join(spread, on + ["__salt"], "left").drop("__salt")


def hot_keys(counted: DataFrame, on: list[str] | None = None, uses: str = "uses",
             min_uses: int = MIN_HOT_USES) -> DataFrame:
    """Hashes of the keys that make up more than 1 / MAX_HOT of all rows, from a counted
    distinct table. By that share there are at most MAX_HOT of them. Keys used less than
    ``min_uses`` times hurt no task and are left out."""
    total = counted.agg(F.sum(uses)).scalar()
    heavy = (F.col(uses) * MAX_HOT > total) & (F.col(uses) >= min_uses)
    return counted.where(heavy).select(F.xxhash64(*(on or ["text"])).alias("__h")).distinct()


def pending_segments(distinct: DataFrame, memory: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Distinct segments without a known translation."""
    on = on or ["text"]
    return distinct.join(memory.select(*on), on, "left_anti")


def apply_translations(segs: DataFrame, translations: DataFrame, on: list[str] | None = None,
                       text: str = "text", out: str = "translated",
                       hot: DataFrame | None = None) -> DataFrame:
    """Each segment takes its translation, else keeps its own text."""
    joined = apply_memory(segs, translations, on, "translated", hot)
    return joined.withColumn(out, F.coalesce("translated", text))


def place_in_runs(runs: DataFrame, keys: list[str], translated: str = "translated",
                  order: str = "run_no", text: str = "text", drawing: str = "has_drawing") -> DataFrame:
    """The first text run of a paragraph takes the whole translation, its other text runs
    become empty, runs with drawings stay. A paragraph of drawings only keeps them; its
    translation is added as one more run. A null translation changes nothing.
    ``keys`` name the paragraph.
    """
    is_text = ~F.coalesce(F.col(drawing), F.lit(False))
    placed = with_extremes(
        runs, keys, order, {"__first": F.when(is_text, F.col(order))}, {"__last": F.col(order)})
    new = (
        F.when(F.col(translated).isNull() | ~is_text, F.col(text))
        .when(F.col(order) == F.col("__first"), F.col(translated)).otherwise("")
    )
    own = F.struct(F.col(order).alias("o"), new.alias("t"), F.col(drawing).alias("d"))
    added = F.struct((F.col(order) + 1).alias("o"), F.col(translated).alias("t"), F.lit(False).alias("d"))
    needs_run = F.col("__first").isNull() & F.col(translated).isNotNull() & (F.col(order) == F.col("__last"))
    rows = placed.select(
        *keys, F.explode(F.when(needs_run, F.array(own, added)).otherwise(F.array(own))).alias("r"))
    return rows.select(*keys, F.col("r.o").alias(order), F.col("r.t").alias(text), F.col("r.d").alias(drawing))


def read_memory(spark: SparkSession, path: str, on: list[str] | None = None) -> DataFrame:
    """A stored memory with one row for each key, whatever was appended to it.

    Of several rows of a key the least stays, so every reader sees the same one.
    """
    table = spark.read.parquet(path)
    on = on or ["text"]
    rest = [c for c in table.columns if c not in on]
    return table.groupBy(*on).agg(F.min(F.struct(*rest)).alias("__r")).select(*on, "__r.*")


def write_memory(translations: DataFrame, path: str, on: list[str] | None = None, new: bool = False) -> DataFrame:
    """Append finished translations whose key is not stored yet; the memory, read back.

    A model call costs money and a lost executor would repeat it for every reader; readers
    of the table never do. Failed segments are left out, so they stay pending. ``on`` is the
    key and should hold the language wherever a memory serves several. Pass the
    translations of :func:`pending_segments`, so that nothing known is translated again; with
    ``new`` they are taken to be those, each key once and none stored, and no text moves to be
    compared again.
    """
    on = on or ["text"]
    spark = translations.sparkSession
    rows, first = translations.where(F.col("status") == "ok"), not _exists(spark, path)
    if not new:
        rows = rows.dropDuplicates(on)
        if stored(spark, path):
            rows = rows.join(spark.read.parquet(path).select(*on), on, "left_anti")
    rows.write.mode("append").option("compression", "zstd").parquet(path)
    if first:  # what one writer has just written has each key once
        return spark.read.schema(rows.schema).parquet(path)
    return read_memory(spark, path, on)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a memory has been written there."""
    return _exists(spark, f"{path}/_SUCCESS")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
