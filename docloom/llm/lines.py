"""Repeated line runs: a suffix array over line ids by prefix doubling. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import saved, table

MIN_WORDS, RANK_SLICES = 10, 1024
#: a group of over 1 / HOT of all places is joined by broadcast: there are fewer than twice HOT of them
HOT, NO_ID = 1000, (1 << 63) - 1
#: a document's key: its id, and its number among the rows whose id is no key (else 0)
_DOC = ("doc", "copy")
_SPACE = " \t\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, copy, pos, a, b, words): every line, trimmed, as a 128-bit id and a number of words."""
    parts = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)))
    return docs.select(*_DOC, F.posexplode(parts).alias("pos", "line")).select(
        *_DOC, F.col("pos").cast("long").alias("pos"), F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit(7), "line").alias("b"), F.regexp_count("line", F.lit(_WORD)).alias("words"))


def _ranked(groups: DataFrame, keys: list[str], slice_: Column) -> DataFrame:
    """Distinct keys to dense global ranks in their order: ranks inside slices, plus offsets.

    ``slice_`` must not fall as the keys rise; it keeps any one window small.
    """
    cut = groups.withColumn("slice", slice_)
    inside = cut.withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy(*keys)))
    sizes = cut.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))  # at most RANK_SLICES rows
    before = sizes.withColumn("before", F.sum("n").over(
        Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(F.broadcast(before.select("slice", F.coalesce("before", F.lit(0)).alias("before"))), "slice").select(
        *[c for c in groups.columns], (F.col("r") + F.col("before") - 1).alias("rank"))


def _met(rows: DataFrame, groups: DataFrame, keys: list[str], value: str, total: int) -> DataFrame:
    """``rows`` with the ``value`` of their group (keys, value, n), null where they have none.

    Groups of over ``total`` / HOT rows meet theirs by broadcast, and these rows are spread
    over the tasks of the other groups' join, so no task gets a hot group.
    """
    hot = groups.where(F.col("n") * HOT > total).select(*[F.col(k).alias(f"hot_{k}") for k in keys], F.col(value).alias("__hot"))
    here = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"hot_{k}") for k in keys], "left")
    spread = [F.when(F.col("__hot").isNull(), F.col(k)).otherwise(F.xxhash64(F.lit(i), *_DOC, "pos")).alias(f"__{i}")
              for i, k in enumerate(keys)]
    rest = groups.where(F.col("n") * HOT <= total).select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], value)
    met = here.select(*rows.columns, "__hot", *spread).join(rest, [f"__{i}" for i in range(len(keys))], "left")
    return met.select(*rows.columns, F.coalesce("__hot", value).alias(value))


def _suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For each level k, (doc, copy, pos, rank): the place in the suffix order of the 2**k lines there.

    Level 0 ranks the lines, level k + 1 the pairs of ranks at pos and pos + 2**k. A run that
    occurs once has found its place and is left out; the levels end when no run is left.
    """
    def level_of(pairs: DataFrame, slice_: Column, *more: str) -> tuple[DataFrame, int]:
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        groups = saved(_ranked(saved(counted, "groups"), ["a", "b"], slice_), "groups")
        sums = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not sums[0]:
            return groups, 0
        met = _met(pairs, groups, ["a", "b"], "rank", sums[1]).where("rank is not null")
        return saved(met.select(*_DOC, "pos", "rank", *more), "level"), sums[0]

    # line ids are hashes: their top bits cut them evenly
    level, ranks = level_of(lines, F.shiftright("a", 54) + 512, "words")
    if not ranks:
        return []
    levels = [level]
    while True:
        step = 1 << (len(levels) - 1)
        ahead = level.select(*_DOC, (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = level.select(*_DOC, "pos", F.col("rank").alias("a")).join(ahead, [*_DOC, "pos"])
        # the level before has so many ranks
        level, ranks = level_of(saved(pairs, "pairs"), F.floor(F.col("a") * RANK_SLICES / ranks).cast("int"))
        if not ranks:
            return levels
        levels.append(level)


def repeated_runs(lines: DataFrame) -> DataFrame:
    """``lines`` (doc, copy, pos, a, b, words) to (doc, copy, pos, run, words): later copies of line runs.

    The ``run`` >= 1 lines from ``pos`` on, of ``words`` words, also stand at an earlier
    (doc, copy, pos), and run + 1 lines do not.

    The places whose first n lines agree are a longest-common-prefix interval of depth n. The
    intervals are walked from large steps to small: inside an interval, places that also agree
    in the next 2**k lines form a deeper one. Its first place stays in the outer interval, for
    the others there, and stands in the deeper one as what the rest repeats; the rest moves
    into the deeper one. So each place ends in the deepest interval with an earlier place,
    in as many rounds as there are levels, and no interval is ever held in one task.
    """
    place = F.struct(*_DOC, "pos")
    levels = _suffix_ranks(lines)
    if not levels:
        return lines.where("false").select(*_DOC, "pos", F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("words"))
    total = levels[0].count()
    nothing = F.lit(0).cast("long")
    now = levels[0].select(*_DOC, "pos", nothing.alias("run"), nothing.alias("x"), nothing.alias("y"), F.lit(False).alias("first"))
    for k in range(len(levels) - 1, -1, -1):
        ranks = levels[k].select(*_DOC, F.col("pos").alias("at"), F.col("rank").alias("r"))
        tried = saved(
            now.withColumn("at", F.col("pos") + F.col("run")).join(ranks, [*_DOC, "at"], "left")
            .select(*_DOC, "pos", "run", "x", "y", "first", F.col("r").isNotNull().alias("known"),
                    F.xxhash64(F.lit(1), "run", "x", "y", "r").alias("x2"),
                    F.xxhash64(F.lit(2), "run", "x", "y", "r").alias("y2")), "tried")
        deeper = saved(tried.where("known").groupBy("x2", "y2").agg(
            F.min(place).alias("start"), F.count(F.lit(1)).alias("n")).where("n > 1"), "deeper")
        met = _met(tried, deeper, ["x2", "y2"], "start", total)
        same = [F.col(c) for c in ("run", "x", "y", "first")]
        down = [F.col("run") + (1 << k), F.col("x2"), F.col("y2")]
        names = ("run", "x", "y", "first")

        def row(values):
            return F.struct(*[v.alias(n) for v, n in zip(values, names)])

        stay, move, lead = row(same), row([*down, F.col("first")]), row([*down, F.lit(True)])
        rows = F.when(F.col("start").isNull() | ~F.col("known"), F.array(stay)).when(
            place == F.col("start"), F.array(stay, lead)).otherwise(F.array(move))
        now = saved(met.select(*_DOC, "pos", F.explode(rows).alias("row")).select(*_DOC, "pos", "row.*"), "runs")
    own = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = levels[0].select(*_DOC, "pos", "words", F.sum("words").over(own).alias("upto"))
    ends = upto.select(*_DOC, F.col("pos").alias("last"), F.col("upto").alias("to"))
    return (
        now.where("not first and run > 0").select(*_DOC, "pos", "run", (F.col("pos") + F.col("run") - 1).alias("last"))
        .join(upto, [*_DOC, "pos"]).join(ends, [*_DOC, "last"])
        .select(*_DOC, "pos", "run", (F.col("to") - F.col("upto") + F.col("words")).alias("words"))
    )


def _keyed(base: DataFrame) -> DataFrame:
    """(doc, text) rows as (doc, copy, text, no_id), all keys different, their order that of the ids.

    A row whose id no other row has is copy 0. The others, and those without an id (NO_ID,
    so they come last), are numbered in the order of id and text. They alone are written down:
    equal rows may change places from one evaluation to the next.
    """
    twice = saved(base.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), "twice")
    several = not twice.isEmpty()
    alone = base.where("doc is not null")
    others = base.where("doc is null")
    if several:
        others = others.unionByName(alone.join(twice, "doc"))
        alone = alone.join(twice, "doc", "left_anti")
    order = ["doc", "a", "b", "row"]  # the row cuts what is equal, so no part holds all of it
    others = others.select(
        F.coalesce("doc", F.lit(NO_ID)).alias("doc"), F.col("doc").isNull().alias("no_id"), "text", F.xxhash64("text").alias("a"),
        F.xxhash64(F.lit(7), "text").alias("b"), F.monotonically_increasing_id().alias("row"))
    numbered = saved(others.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc", (F.monotonically_increasing_id() + 1).alias("copy"), "text", "no_id"), "shared", "zstd")
    alone = alone.select("doc", F.lit(0).cast("long").alias("copy"), "text", F.lit(False).alias("no_id"))
    return alone.unionByName(numbered)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Texts without the later copies of repeated line runs of at least ``min_words`` words.

    Returns (id, text, n_lines, n_removed). Lines are compared without white space at their
    ends. Places are ordered by id, then line. A line goes if a run of lines that covers it,
    taken as long as it repeats, stands at an earlier place too and has ``min_words`` words or
    more; so the first place keeps every line, and a run may continue into its own copy.

    A null text stays null with 0 lines, an empty one is one empty line. Rows that share an id
    come in the order of their texts' hashes, rows without an id after all others; of rows
    that agree in both, one is the first. Other columns are not read; an empty table gives an
    empty one.
    """
    base = _keyed(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")))
    held = base.where("text is not null")
    lines = saved(_lines(held), "lines")

    # a later copy of a whole text repeats nothing that its first copy does not: only first
    # copies go on, and all lines of the others go if they have words enough
    texts = saved(held.select(*_DOC, F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")), "texts")
    firsts = saved(texts.groupBy("a", "b").agg(F.min(F.struct(*_DOC)).alias("start"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1"), "firsts")
    met = _met(texts.withColumn("pos", F.lit(0)), firsts, ["a", "b"], "start", max(1, texts.count()))
    copies = saved(met.where(F.struct(*_DOC) != F.col("start")).select(*_DOC), "copies")
    whole = (
        lines.join(copies, [*_DOC]).groupBy(*_DOC).agg(F.count(F.lit(1)).alias("end"), F.sum("words").alias("words"))
        .where(F.col("words") >= min_words)
        .select(*_DOC, F.array(F.struct(F.lit(0).cast("long").alias("pos"), "end")).alias("gone"), F.col("end").alias("n_removed"))
    )
    runs = repeated_runs(lines.join(copies, [*_DOC], "left_anti")).where(F.col("words") >= min_words)

    # ends never fall from one place of a document to the next, so touching runs join in order
    in_order = Window.partitionBy(*_DOC).orderBy("pos")
    spans = (
        runs.select(*_DOC, "pos", (F.col("pos") + F.col("run")).alias("end"))
        .withColumn("new", (F.col("pos") > F.coalesce(F.lag("end").over(in_order), F.lit(-1))).cast("int"))
        .withColumn("piece", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*_DOC, "piece").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
        .groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("pos", "end"))).alias("gone"),
                            F.sum(F.col("end") - F.col("pos")).alias("n_removed"))
    )
    # spans grow with the data: merged at every size, never broadcast
    joined = base.join(saved(spans.unionByName(whole), "spans").hint("merge"), [*_DOC], "left").withColumn("parts", F.split("text", "\n"))
    n = F.size("parts").cast("long")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("gone", lambda s: s["end"]))
    ends = F.concat(F.transform("gone", lambda s: s["pos"]), F.array(n))
    left = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice("parts", (b + 1).cast("int"), (e - b).cast("int"))))
    return joined.select(
        F.when(~F.col("no_id"), F.col("doc")).alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
