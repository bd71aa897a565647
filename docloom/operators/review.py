"""Judging a translation, reading the judgement, and applying its corrections."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.fixed import EVALUATION_FAILED
from docloom.functions.text import col, segment_key, strip_code_fence, strip_tags, trim_ws
from docloom.operators.memory import apply_memory, hot_keys
from docloom.operators.policy import Pace, RetryPolicy, in_order
from docloom.operators.translate import default_partitions, in_lanes

REVIEW_SCHEMA = (
    "score string, accuracy string, tone string, issues array<string>, suggestion string, "
    "corrections array<struct<incorrect_snippet:string,suggested_fix:string,reason:string>>, "
    "error string, _bad string"
)


def evaluate(df: DataFrame, judge: Callable[[str, str, str], str], original: str = "original_text",
             translated: str = "translated_text", language: str = "target_language",
             policy: RetryPolicy | None = None, keep: tuple[str, ...] = (),
             partitions: int | None = None) -> DataFrame:
    """Add ``raw``, the judge's JSON text. A failing call gives score 0 and the error, or
    stops the job when the policy says ``raise``.

    Equal (original, translation, language) are judged once and spread over all tasks; the
    answers are joined back by a key.
    """
    policy = policy or RetryPolicy()
    asked = [original, translated, language]
    n = default_partitions(df, partitions)
    lanes = policy.lanes(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paces: dict[int, Pace] = {}

        def ask(job: tuple) -> str:
            *texts, lane = job
            try:
                return policy.call(judge, *texts, before=paces[lane].wait)[0]
            except Exception as e:  # noqa: BLE001
                if policy.on_error == "raise":
                    raise
                return json.dumps(
                    {"score": 0, "error": str(e), "suggestion": EVALUATION_FAILED}, ensure_ascii=False)

        for pdf in batches:
            paces |= {k: Pace(policy, k, lanes) for k in set(pdf["__lane"]) - set(paces)}
            jobs = zip(pdf[original], pdf[translated], pdf[language], pdf["__lane"])
            yield pd.DataFrame({"__pair": pdf["__pair"], "raw": list(in_order(jobs, ask, policy.in_flight))})

    pair = segment_key(F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(asked)])))
    src = df.select(*keep, *asked).withColumn("__pair", pair)
    # folded by the key: equal pairs move their texts once for each task that reads them
    distinct = src.groupBy("__pair").agg(*[F.first(c).alias(c) for c in asked], F.count(F.lit(1)).alias("uses"))
    placed = in_lanes(distinct, F.xxhash64("__pair"), {None: policy}, n)
    judged = placed.mapInPandas(run, "__pair binary, raw string")
    return apply_memory(src, judged, ["__pair"], "raw", hot_keys(distinct, ["__pair"])).drop("__pair")


def evaluate_requests(df: DataFrame, judges: dict[str, Callable[[str, str, str], str]],
                      reviewer: str = "reviewer_provider", original: str = "original_text",
                      translated: str = "translated_text", language: str = "target_language",
                      policy: RetryPolicy | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row judged by the reviewer it names: ``(keep, reviewer, status, detail, raw)``.

    Judges read both texts without tags. A reviewer that is not registered gives status 503
    and no answer; so does a missing one.
    """
    known = F.coalesce(F.col(reviewer).isin(list(judges)), F.lit(False))
    rows = df.select(*keep, reviewer, language, trim_ws(strip_tags(original)).alias(original),
                     trim_ws(strip_tags(translated)).alias(translated))
    detail = F.concat(F.lit("Reviewer '"), F.coalesce(F.col(reviewer), F.lit("")), F.lit("' not configured"))
    out = rows.where(~known).select(*keep, reviewer, F.lit(503).alias("status"), detail.alias("detail"),
                                    F.lit(None).cast("string").alias("raw"))
    for name, judge in judges.items():
        judged = evaluate(rows.where(F.col(reviewer) == name), judge, original, translated, language, policy, (*keep, reviewer))
        out = out.unionByName(judged.select(
            *keep, reviewer, F.lit(200).alias("status"), F.lit(None).cast("string").alias("detail"), "raw"))
    return out


def parse_reviews(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Fence off, then JSON. Text that is not a JSON object becomes score 0 with an error."""
    text = strip_code_fence(raw, "review")
    parsed = F.from_json(text, REVIEW_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    rows = df.withColumn("__text", text).withColumn("__r", parsed)
    bad = (
        F.col("__r").isNull() | F.col("__r._bad").isNotNull()
        | ~F.startswith("__text", F.lit("{")) | ~F.endswith("__text", F.lit("}"))
    )
    ok = F.when(~F.col("__off"), F.col("__r"))
    return rows.withColumn("__off", F.coalesce(bad, F.lit(True))).select(
        *[c for c in df.columns],
        F.when(F.col("__off"), 0.0).otherwise(F.col("__r.score").try_cast("double")).alias("score"),
        ok["accuracy"].alias("accuracy"), ok["tone"].alias("tone"), ok["issues"].alias("issues"),
        F.when(F.col("__off"), EVALUATION_FAILED).otherwise(F.col("__r.suggestion")).alias("suggestion"),
        ok["corrections"].alias("corrections"),
        F.when(F.col("__off"), "malformed JSON").otherwise(F.col("__r.error")).alias("error"),
    )


def score_band(score: str | Column = "score") -> Column:
    s = col(score)
    return F.when(s >= 8, "good").when(s >= 5, "fair").otherwise("poor")


def explode_issues(reviews: DataFrame, keys: list[str]) -> DataFrame:
    rows = reviews.select(*keys, F.posexplode("issues").alias("pos", "issue"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def explode_corrections(reviews: DataFrame, keys: list[str]) -> DataFrame:
    rows = reviews.select(*keys, F.posexplode("corrections").alias("pos", "c"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), "c.*")


def usable(snippet: Column, fix: Column) -> Column:
    """A correction with an empty side is ignored."""
    return (F.coalesce(snippet, F.lit("")) != "") & (F.coalesce(fix, F.lit("")) != "")


def valid_corrections(df: DataFrame, html: str = "html", snippet: str = "incorrect_snippet",
                      fix: str = "suggested_fix") -> DataFrame:
    """Corrections whose snippet is an exact part of the translated text."""
    return df.where(usable(F.col(snippet), F.col(fix)) & F.contains(html, F.col(snippet)))


def fix_exact(html: Column, snippet: Column, fix: Column) -> Column:
    """Replace the first occurrence; the fix is taken literally."""
    at = F.locate_col(html, snippet) if hasattr(F, "locate_col") else F.position(snippet, html)
    return F.when(
        at > 0,
        F.concat(F.substr(html, F.lit(1), at - 1), fix, F.substr(html, at + F.length(snippet))),
    ).otherwise(html)


def fuzzy_pattern(snippet: Column) -> Column:
    """A pattern that lets tags stand between characters, and any run of white space or
    ``&nbsp;`` for a blank."""
    chars = F.regexp_extract_all(snippet, F.lit(r"(?s)."), F.lit(0))
    parts = F.transform(
        chars,
        lambda ch: F.when(ch == " ", r"(?:\s|&nbsp;)+").otherwise(
            F.regexp_replace(ch, r"([.*+?^${}()|\[\]\\])", r"\\$1")),
    )
    return F.array_join(parts, "(?:<[^>]+>)*")


def fuzzy_allowed(snippet: Column) -> Column:
    return ~F.contains(snippet, F.lit("<")) | (
        F.startswith(snippet, F.lit("<")) & F.endswith(snippet, F.lit(">")))


def fix_fuzzy(html: Column, snippet: Column, fix: Column) -> Column:
    """Replace every loose match; the fix is taken literally."""
    literal = F.regexp_replace(fix, r"([\\$])", r"\\$1")
    return F.when(fuzzy_allowed(snippet), F.regexp_replace(html, fuzzy_pattern(snippet), literal)).otherwise(html)


def _fold(html: Column, corrections: Column) -> Column:
    """Apply corrections in order, each to the result of the last: ``(html, outcome[])``."""
    start = F.struct(html.alias("html"), F.array().cast("array<string>").alias("outcome"))

    def note(text: Column, acc: Column, how: str) -> Column:
        return F.struct(text.alias("html"), F.concat(acc["outcome"], F.array(F.lit(how))).alias("outcome"))

    def step(acc: Column, c: Column) -> Column:
        snippet, fix = c["incorrect_snippet"], c["suggested_fix"]
        exact = fix_exact(acc["html"], snippet, fix)
        loose = F.array(fix_fuzzy(acc["html"], snippet, fix))
        fuzzy = F.get(F.transform(
            loose,
            lambda t: F.when(t != acc["html"], note(t, acc, "fuzzy")).otherwise(
                note(acc["html"], acc, "unmatched"))), F.lit(0))
        return (
            F.when(~usable(snippet, fix), note(acc["html"], acc, "ignored"))
            .when(F.contains(acc["html"], snippet), note(exact, acc, "exact"))
            .otherwise(fuzzy)
        )

    return F.aggregate(F.coalesce(corrections, F.array().cast(
        "array<struct<incorrect_snippet:string,suggested_fix:string,reason:string>>")), start, step)


def apply_fixes(df: DataFrame, html: str = "html", corrections: str = "corrections",
                out: str = "fixed_html") -> DataFrame:
    """Add the corrected text and ``outcome`` for each correction: exact, fuzzy, ignored or
    unmatched."""
    folded = df.withColumn("__f", _fold(F.col(html), F.col(corrections)))
    return folded.withColumn(out, F.col("__f.html")).withColumn(
        "outcome", F.col("__f.outcome")).drop("__f")


def unmatched_fixes(applied: DataFrame, keys: list[str], corrections: str = "corrections") -> DataFrame:
    """Corrections that neither way could place."""
    pairs = F.arrays_zip(F.col(corrections).alias("c"), F.col("outcome").alias("how"))
    rows = applied.select(*keys, F.posexplode(pairs).alias("pos", "p"))
    return rows.where(F.col("p.how") == "unmatched").select(
        *keys, F.col("pos").cast("long").alias("pos"), "p.c.*")


def dismiss(corrections: str | Column, index: int | Column) -> Column:
    """The list without its i-th entry (from 0)."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.filter(col(corrections), lambda c, k: k != i)
