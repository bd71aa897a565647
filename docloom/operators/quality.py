"""Checks of a translation against its original. Built-in expressions, no joins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.masking import terms_pattern
from docloom.functions.text import col, segment_key, strip_code_fence, trim_ws
from docloom.operators.memory import MIN_HOT_USES, apply_memory, hot_keys
from docloom.operators.policy import RetryPolicy
from docloom.operators.translate import Engine, call_stage, masked, unmasked
from docloom.session import work_dir

TOKEN = r"__R?(?:TERM|BRACKET)_[0-9]+A?__|\[\[[^\n]*?\]\]|(?:STYLE|IMG)_PLACEHOLDER_[0-9]+"
NUMBER = r"[0-9]+(?:[.,/:\-][0-9]+)*%?"
WORD = r"[\p{L}\p{M}]++"
LATIN_WORD = r"(?<![\p{L}\p{M}])\p{IsLatin}+(?![\p{L}\p{M}])"


def is_missed(original: str, translated: str, threshold: float = 0.5,
              terms: list[str] | None = None) -> Column:
    """True where a segment still reads as the source language: it did not change, or more
    than ``threshold`` of its words are Latin. Tags, tokens, protected terms and numbers
    do not count as words."""
    # a look at the character rejects most positions at once
    heads = "".join(sorted({re.escape(t[0]) for t in (fixed.PROTECTED_TERMS if terms is None else terms)}))
    aside = rf"(?=[<_\[SI0-9{heads}])(?:<[^>]*>|{TOKEN}|{terms_pattern(terms)}|{NUMBER})"
    bare = F.regexp_replace(F.col(translated), aside, " ")

    def judge(b: Column) -> Column:
        words = F.regexp_count(b, F.lit(WORD))
        latin = F.regexp_count(b, F.lit(LATIN_WORD))
        return (words > 0) & ((F.col(original) == F.col(translated)) | (latin > threshold * words))

    # the text is bound once, not computed for each count
    return F.get(F.transform(F.array(bare), judge), F.lit(0))


def missed_segments(df: DataFrame, original: str = "text", translated: str = "translated",
                    threshold: float = 0.5, terms: list[str] | None = None) -> DataFrame:
    return df.where(is_missed(original, translated, threshold, terms))


def first_success(fns: list[Callable]) -> Callable:
    """Try the reviewers in order; the first that answers wins, the last error is raised."""
    def call(texts: list[str], *language: str) -> list[str]:
        error = RuntimeError("no reviewer")
        for fn in fns:
            try:
                return fn(texts, *language)
            except Exception as e:  # noqa: BLE001
                error = e
        raise error

    return call


def review_pass(df: DataFrame, fns: list[Callable], original: str = "text",
                translated: str = "translated", threshold: float = 0.5,
                policy: RetryPolicy | None = None, batch_size: int = 25,
                min_hot_uses: int = MIN_HOT_USES, by: tuple[str, ...] = (), mask: bool = True) -> DataFrame:
    """Translate the missed segments once more; others, and those that fail, stay.

    ``by`` names what a request must not mix, the language last; a reviewer is called as
    ``fn(texts)``, or as ``fn(texts, language)`` when ``by`` is given. An answer is used only for
    equal texts of the same ``by``. ``mask`` hides protected terms and ``[[…]]`` from reviewers.

    Missed rows alone are stored and joined, by a key; the others are not moved. ``df`` is read
    twice, for the missed rows at once and for the others with the result: give a written table
    when it holds a model call. A row without a translation stays.
    """
    marked = df.withColumn("__missed", F.coalesce(is_missed(original, translated, threshold), F.lit(False)))
    others = marked.where(~F.col("__missed")).drop("__missed").withColumn("reviewed", F.lit(False))
    marked.where("__missed").drop("__missed").withColumn("__key", segment_key(translated)).write.parquet(
        path := work_dir(df.sparkSession, "missed"))
    missed = df.sparkSession.read.parquet(path)
    groups = list(by)
    distinct = missed.groupBy(*groups, translated).agg(F.count(F.lit(1)).alias("uses")).withColumnRenamed(
        translated, "__text").withColumn("__sent", masked("__text", mask, "R"))
    ask = first_success(fns)
    engine = Engine(ask if by else (lambda texts, _: ask(texts)), batch_size, policy or RetryPolicy())
    answers = call_stage(distinct, "__sent", groups, engine, None).where("status = 'ok'")
    reviewed = answers.select(
        *groups, segment_key("__text").alias("__key"), unmasked("translated", "__text", mask, "R").alias("__new"), "uses")
    keyed = distinct.withColumn("__key", segment_key("__text"))
    on = [*groups, "__key"]
    joined = apply_memory(missed, reviewed, on, "__new", hot_keys(keyed, on, min_uses=min_hot_uses))
    done = joined.withColumn(translated, F.coalesce("__new", translated)).withColumn(
        "reviewed", F.col("__new").isNotNull()).drop("__new", "__key")
    return others.unionByName(done)


_TAG = r"(?i)</?[a-z][a-z0-9]*"
_ATTR = r"""(?i)\s(?:class|id|style|src)=(?:"[^"]*"|'[^']*')"""


def _count_tag(html: Column, name: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{name}[\s/>]"))


def check_structure(df: DataFrame, original: str = "original_html", translated: str = "html") -> DataFrame:
    """Add ``same_tags``, ``same_rows``, ``same_cells`` and ``same_attributes``."""
    o, t = col(original), col(translated)

    def names(c: Column) -> Column:
        return F.lower(F.array_join(F.regexp_extract_all(c, F.lit(_TAG), F.lit(0)), " "))

    def attributes(c: Column) -> Column:
        return F.array_join(F.regexp_extract_all(c, F.lit(_ATTR), F.lit(0)), "\n")

    return df.select(
        "*",
        (names(o) == names(t)).alias("same_tags"),
        (_count_tag(o, "tr") == _count_tag(t, "tr")).alias("same_rows"),
        (_count_tag(o, "td") == _count_tag(t, "td")).alias("same_cells"),
        (attributes(o) == attributes(t)).alias("same_attributes"),
    )


def preserved_tokens(c: Column, terms: list[str] | None = None) -> Column:
    """What must survive, with repeats: tokens, protected terms, numbers and check glyphs."""
    pattern = f"{TOKEN}|{terms_pattern(terms)}|{NUMBER}|[{fixed.CHECK_GLYPHS}]"
    return F.array_sort(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def check_preserved(df: DataFrame, original: str = "text", translated: str = "translated",
                    terms: list[str] | None = None) -> DataFrame:
    """Add ``preserved`` (equal as multisets) and ``lost``, the tokens that occur less often."""
    both = df.withColumn("__o", preserved_tokens(F.col(original), terms)).withColumn(
        "__t", preserved_tokens(F.col(translated), terms))

    def times(arr: str, x: Column) -> Column:
        return F.size(F.filter(F.col(arr), lambda y: y == x))

    fewer = F.filter(F.array_distinct("__o"), lambda x: times("__o", x) > times("__t", x))
    same = F.col("__o") == F.col("__t")
    return both.withColumn("preserved", same).withColumn(
        "lost", F.when(same, F.array().cast("array<string>")).otherwise(fewer)).drop("__o", "__t")


def check_counts(batches: DataFrame, segments: str = "segments", response: str = "response") -> DataFrame:
    """Lines returned against segments sent."""
    lines = F.filter(F.split(strip_code_fence(response, "batch"), "\n", -1), lambda x: trim_ws(x) != "")
    return batches.select(
        "*", F.size(segments).cast("long").alias("sent"), F.size(lines).cast("long").alias("returned"),
        (F.size(lines) == F.size(segments)).alias("aligned"))


def check_result(df: DataFrame, required: tuple[str, ...] = ("html", "original_html", "language"),
                 html: str = "html", original: str = "original_html",
                 encoded: tuple[str, ...] = ()) -> DataFrame:
    """Add ``violations``: what makes a result row unfit to hand out."""
    rules = [(F.col(c).isNull(), f"missing {c}") for c in required]
    rules += [
        (F.length(html) <= 100, "html too short"),
        (F.col(html) == F.col(original), "html unchanged"),
    ]
    for c in encoded:
        decoded = F.try_to_binary(F.col(c), F.lit("base64"))
        rules.append((F.col(c).isNotNull() & (F.coalesce(F.length(decoded), F.lit(0)) == 0),
                      f"{c} does not decode"))
    found = F.array(*[F.when(cond, text) for cond, text in rules])
    return df.withColumn("violations", F.array_compact(found))
