"""Positions inside a document without putting a document into one task.

A window over ``partitionBy(doc)`` sorts a whole document in one task, and one
document may hold a third of all rows. These helpers cut every document into
blocks of consecutive order values. Rows are ranked or summed inside a block; the
per-block totals are accumulated the same way, in blocks of blocks; and the levels are
joined on (document, block). However far apart the order values lie (time stamps, ids),
a window holds at most ``block`` rows, or a row each of ``FAN`` blocks. Ids and order values must not be
null; order values must be whole numbers, distinct within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

BLOCK = 1024
FAN = 1 << 20
_BLK = "__blk"


def _as_list(ids: str | list[str]) -> list[str]:
    return [ids] if isinstance(ids, str) else list(ids)


def _check_new(df: DataFrame, names) -> None:
    taken = set(names) & set(df.columns)
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")


def with_block(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    return df.withColumn(_BLK, F.floor(F.col(order) / F.lit(block)).cast("long"))


def _levels(df: DataFrame, order: str) -> int:
    """How often blocks are put into blocks before a document is looked at as a whole. Four bytes
    hold four million blocks at most; of time stamps in microseconds, a century has three million
    blocks of blocks."""
    return 0 if isinstance(df.schema[order].dataType, (ByteType, ShortType, IntegerType)) else 1


def before_blocks(heads: DataFrame, ids: list[str], at: str, sums: list[str], lasts: list[str], levels: int) -> DataFrame:
    """``heads``, one row for each block ``at``, with what comes before the block in its document:
    ``__off_x``, the sum of x over the blocks before, and ``__prev_x``, x of the one before."""
    group = [*ids, f"__up{levels}"] if levels else ids
    grouped = heads.withColumn(group[-1], F.floor(F.col(at) / FAN).cast("long")) if levels else heads
    here = Window.partitionBy(*group).orderBy(at)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.select(
        "*", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__off_{n}") for n in sums],
        *[F.lag(n).over(here).alias(f"__prev_{n}") for n in lasts])
    if not levels:
        return local
    parents = grouped.groupBy(*group).agg(
        *[F.sum(n).alias(n) for n in sums], *[F.max_by(n, at).alias(n) for n in lasts])
    above = before_blocks(parents, ids, group[-1], sums, lasts, levels - 1).select(
        *group, *[F.col(f"__off_{n}").alias(f"__above_{n}") for n in sums],
        *[F.col(f"__prev_{n}").alias(f"__above_{n}") for n in lasts])
    return local.join(above, group).select(
        *heads.columns, *[(F.col(f"__off_{n}") + F.col(f"__above_{n}")).alias(f"__off_{n}") for n in sums],
        *[F.coalesce(f"__prev_{n}", f"__above_{n}").alias(f"__prev_{n}") for n in lasts])


def running_sums(
    df: DataFrame, ids: str | list[str], order: str, sums: dict[str, Column],
    totals: dict[str, str] | None = None, block: int = BLOCK,
) -> DataFrame:
    """Add inclusive running sums; ``totals`` maps an output name to a key of ``sums``."""
    ids = _as_list(ids)
    _check_new(df, [*sums, *(totals or {})])
    keys = ids + [_BLK]
    blocked = with_block(df, order, block)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    heads = blocked.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    offsets = before_blocks(heads, ids, _BLK, list(sums), [], _levels(df, order)).drop(*sums)
    if totals:
        whole = heads.groupBy(*ids).agg(*[F.sum(n).alias(out) for out, n in totals.items()])
        offsets = offsets.join(whole, ids)
    local = blocked.select("*", *[F.sum(e).over(w).alias(f"__in_{n}") for n, e in sums.items()])
    joined = local.join(offsets, keys)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__in_{n}") + F.col(f"__off_{n}")).cast("long").alias(n) for n in sums],
        *[F.col(out).cast("long").alias(out) for out in (totals or {})],
    )


def number_rows(
    df: DataFrame, ids: str | list[str], order: str, out: str,
    total: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """0-based rank of each row inside its document, and optionally the row count."""
    ranked = running_sums(
        df, ids, order, {out: F.lit(1)}, {total: out} if total else None, block
    )
    return ranked.withColumn(out, F.col(out) - 1)


def with_extremes(df: DataFrame, ids: str | list[str], order: str,
                  mins: dict[str, Column], maxs: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add the least and greatest values of a group to each of its rows."""
    ids = _as_list(ids)
    _check_new(df, [*mins, *maxs])
    keys = ids + [_BLK]
    blocked = with_block(df, order, block)
    heads = blocked.groupBy(*keys).agg(
        *[F.min(e).alias(n) for n, e in mins.items()], *[F.max(e).alias(n) for n, e in maxs.items()])
    extremes = heads.select(*keys).join(heads.groupBy(*ids).agg(
        *[F.min(n).alias(n) for n in mins], *[F.max(n).alias(n) for n in maxs]), ids)
    return blocked.join(extremes, keys).select(*df.columns, *mins, *maxs)


def number_islands(df: DataFrame, ids: str | list[str], order: str, value: str, out: str,
                   count_null: bool = True, block: int = BLOCK) -> DataFrame:
    """Number the runs of equal adjacent values of a document: 1, 2, …

    A run may cross blocks: a block starts a new run only when its first value differs from
    the last value of the block before. With ``count_null=False`` runs of null separate the
    others but take no number.
    """
    ids = _as_list(ids)
    _check_new(df, [out])
    keys = ids + [_BLK]
    in_block = Window.partitionBy(*keys).orderBy(order)
    here = F.struct(F.col(value).alias("v"))
    counts = F.lit(True) if count_null else F.col(value).isNotNull()

    changed = F.col("__prev").isNotNull() & ~F.col("__prev.v").eqNullSafe(F.col(value)) & counts
    local = (
        with_block(df, order, block)
        .withColumn("__prev", F.lag(here).over(in_block))
        .withColumn("__in", F.sum(F.when(changed, 1).otherwise(0)).over(
            in_block.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # placed by (ids, block) already, so this grouping moves nothing
    heads = local.groupBy(*keys).agg(
        F.min_by(here, order).alias("__first"), F.max_by(here, order).alias("__last"),
        F.max("__in").alias("__n"))
    levels = _levels(df, order)
    starts = ~F.col("__first").eqNullSafe(F.col("__prev___last"))
    if not count_null:
        starts = starts & F.col("__first.v").isNotNull()
    # a block counts its own runs after the first, and that one where it goes on from no other
    counted = before_blocks(heads, ids, _BLK, [], ["__last"], levels).select(
        *keys, F.when(starts, 1).otherwise(0).alias("__start"), (F.col("__n") + F.when(starts, 1).otherwise(0)).alias("__all"))
    offsets = before_blocks(counted, ids, _BLK, ["__all"], [], levels).select(
        *keys, (F.col("__off___all") + F.col("__start")).alias("__off"))
    return local.join(offsets, keys).select(
        *[F.col(c) for c in df.columns], (F.col("__in") + F.col("__off")).cast("long").alias(out))


def join_in_order(order: str, part: str, sep: str = "") -> Column:
    """Aggregate: the parts of a group as one string, by ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part).alias("p"))))
    return F.array_join(F.transform(rows, lambda x: x["p"]), sep)
