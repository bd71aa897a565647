"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    """A set number for repartition: adaptive execution would merge small rows of much work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_crc32(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def bucket_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Deal the rows of each ``bucket`` to pairs of blocks, sorted, for ``each_bucket``.

    A bucket of n rows gets ceil(n / block) blocks; a row of block b goes to every pair of
    blocks that holds b, so two rows of a bucket meet in exactly one (``lo``, ``hi``) and a
    pair of blocks is all that one task must hold. Buckets of one row are left out.
    """
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / block).cast("int")
    dealt = (
        rows.join(sizes, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("block", "__other"))
        .withColumn("hi", F.greatest("block", "__other"))
        .drop("__n", "__other")
    )
    return dealt.repartition(shuffle_partitions(rows), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def each_bucket(batches: Iterator[pd.DataFrame], small: int = 48) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """From batches of ``bucket_blocks``: (rows, i, j) with all pairs i, j that meet there.

    Groups of up to ``small`` rows come together, larger ones one by one.
    """
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        cut = _starts(batch)[-1] if len(batch) else 0
        rest = batch.iloc[cut:].reset_index(drop=True)
        yield from _groups(batch.iloc[:cut].reset_index(drop=True), small)
    if rest is not None:
        yield from _groups(rest, small)


def _starts(rows: pd.DataFrame) -> np.ndarray:
    key = rows[["bucket", "lo", "hi"]].to_numpy()
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])


def _groups(rows: pd.DataFrame, small: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    if not len(rows):
        return
    starts = _starts(rows)
    sizes = np.diff(np.r_[starts, len(rows)])
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        group = rows.iloc[s:s + n].reset_index(drop=True)
        block, lo, hi = group["block"].to_numpy(), group["lo"].iloc[0], group["hi"].iloc[0]
        if lo == hi:
            i, j = np.triu_indices(n, 1)
        else:
            a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
        yield group, i, j
    few = rows[np.repeat(sizes <= small, sizes)].reset_index(drop=True)
    if not len(few):
        return
    number = np.repeat(np.arange(len(sizes)), sizes)[np.repeat(sizes <= small, sizes)]
    cross = (few["lo"] != few["hi"]).to_numpy()
    block = few["block"].to_numpy()
    left, right = [], []
    for d in range(1, small):
        i = np.flatnonzero(number[:-d] == number[d:])
        if not len(i):
            break
        i = i[~cross[i] | (block[i] != block[i + d])]
        left.append(i)
        right.append(i + d)
    if left:
        yield few, np.concatenate(left), np.concatenate(right)


def matrix(column: pd.Series, dtype: str) -> np.ndarray:
    """Binary cells of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


