"""The model calls. The model is a Python function of the user; all else is built-in.

A call stage is an exchange + ``mapInPandas``. Each engine has tasks of its own, as many as
its gap between calls leaves work for, and a row's task is computed, not hashed by Spark: so
all tasks together keep an engine's rate, and no other engine waits for it. Several calls of a
task may be in flight at once; answers come in the order of the requests.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.masking import (
    has_protected, mask_images, mask_protected, mask_styles, unmask, unmask_images, unmask_styles,
)
from docloom.functions.text import decode_entities, extract_body, map_symbols, strip_code_fence, trim_ws
from docloom.operators.policy import Pace, RetryPolicy, ask_batch, in_order
from docloom.operators.routing import language_name


CHUNKS_HELD = 256


@dataclass(frozen=True)
class Engine:
    """A translator: ``fn(texts, language)`` returns as many texts as it is given."""

    fn: Callable[[list[str], str], list[str]]
    batch_size: int = 25
    policy: RetryPolicy = field(default_factory=RetryPolicy)
    mask: bool = False
    symbols: bool = False  # symbol-font code points go to it as the glyphs they stand for


def lanes_of(policies: dict[str | None, RetryPolicy], partitions: int) -> tuple[dict[str | None, tuple[int, int]], int]:
    """For each engine its first task and how many it has; and all tasks. An engine with a gap
    has tasks of its own, those without share the rest."""
    plan, first = {}, 0
    for name, policy in policies.items():
        if policy.gap:
            plan[name] = (first, policy.lanes(partitions))
            first += plan[name][1]
    free = {name: (first, partitions) for name, policy in policies.items() if not policy.gap}
    return plan | free, first + (partitions if free else 0)


def in_lanes(src: DataFrame, key: Column, policies: dict[str | None, RetryPolicy], partitions: int,
             engine_col: str | None = None) -> DataFrame:
    """Place rows by engine and a hash of ``key``, and add ``__lane``, the row's task among its engine's."""
    plan, total = lanes_of(policies, partitions)
    if engine_col is None:
        (first, count), = plan.values()
        return src.withColumn("__lane", F.pmod(key, F.lit(count)).cast("int")).repartitionById(total, F.col("__lane"))
    first, count = F.lit(0), F.lit(1)
    for name, (f, c) in plan.items():
        first = F.when(F.col(engine_col) == name, f).otherwise(first)
        count = F.when(F.col(engine_col) == name, c).otherwise(count)
    return src.withColumn("__lane", F.pmod(key, count).cast("int")).repartitionById(
        total, (first + F.col("__lane")).cast("int"))


def default_partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _requests(batches: Iterator[pd.DataFrame], groups: list[str], sent: str,
              size_of: Callable[[tuple], int]) -> Iterator[tuple[tuple, list, object, pd.DataFrame, int]]:
    """(labels, texts, lane, rows, first) of each request: its rows are ``rows`` from ``first`` on. One
    may go on over the end of a batch of rows, so it does not depend on how many rows Spark hands
    over at once. Columns are read once a batch: a request of one text costs no work on frames."""
    rest = None
    for more in itertools.chain(batches, [None]):
        rows = more if rest is None else rest if more is None else pd.concat([rest, more], ignore_index=True)
        if rows is None:
            return
        labels = list(zip(*[rows[g].tolist() for g in groups])) if groups else [()] * len(rows)
        texts, lanes = rows[sent].tolist(), rows["__lane"].tolist() if "__lane" in rows else [0] * len(rows)
        at = 0
        while at < len(rows):
            end, size = at + 1, size_of(labels[at])
            while end < len(rows) and end - at < size and labels[end] == labels[at]:
                end += 1
            if end == len(rows) and end - at < size and more is not None:
                break
            yield labels[at], texts[at:end], lanes[at], rows, at
            at = end
        rest = rows.iloc[at:].reset_index(drop=True)


def call_stage(src: DataFrame, sent: str, groups: list[str], engines: Engine | dict[str, Engine],
               partitions: int | None, spread: bool = True) -> DataFrame:
    """Run the model over ``sent``; a request never mixes values of ``groups``. With several
    ``engines`` the first of these names a row's engine; an unknown one is an error.

    ``spread=False`` leaves rows in the tasks where they are, unless an engine has a gap: for rows
    that a shuffle has just dealt out, whose texts need not move again."""
    named = engines if isinstance(engines, dict) else {None: engines}
    policies = {name: e.policy for name, e in named.items()}
    n = default_partitions(src, partitions)
    plan, _ = lanes_of(policies, n)
    carried = [f.name for f in src.schema.fields if f.name != "__sent"]

    def engine_of(labels: tuple) -> str | None:
        return labels[0] if isinstance(engines, dict) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paces: dict[tuple, Pace] = {}

        def ask(job: tuple) -> tuple:
            labels, texts, lane, rows, first = job
            engine, pace = named[engine_of(labels)], paces[engine_of(labels), lane]
            return rows, first, ask_batch(
                engine.fn, engine.policy, texts, labels[-1] if groups else None, pace=pace)

        def opened(jobs: Iterator[tuple]) -> Iterator[tuple]:
            for job in jobs:
                name, lane = engine_of(job[0]), job[2]
                if (name, lane) not in paces:
                    paces[name, lane] = Pace(policies[name], lane, plan[name][1])
                yield job

        def made(rows: pd.DataFrame, first: int, columns: tuple[list, list, list]) -> pd.DataFrame:
            out = rows[carried].iloc[first:first + len(columns[0])].copy()
            out["translated"], out["status"], out["attempts"] = columns
            return out

        jobs = opened(_requests(batches, groups, sent, lambda labels: named[engine_of(labels)].batch_size))
        frame, begin, done = None, 0, ([], [], [])
        for name, own in itertools.groupby(jobs, key=lambda job: engine_of(job[0])):
            for rows, first, answers in in_order(own, ask, policies[name].in_flight):
                if rows is not frame or len(done[0]) >= 2000:  # requests of one frame follow each other
                    if done[0]:
                        yield made(frame, begin, done)
                    frame, begin, done = rows, first, ([], [], [])
                for column, values in zip(done, answers):
                    column += values
        if done[0]:
            yield made(frame, begin, done)

    schema = src.select(*carried).schema.add("translated", "string").add("status", "string").add("attempts", "integer")
    placed = src
    if spread or partitions or any(p.gap for p in policies.values()):
        placed = in_lanes(src, F.xxhash64(*groups, sent), policies, n, groups[0] if isinstance(engines, dict) else None)
    # sorted, so that a retried task forms the same batches again
    return placed.sortWithinPartitions(*groups, sent).mapInPandas(run, schema)


def masked(text_col: str, where: Column | bool = True, prefix: str = "", html: bool = False) -> Column:
    """What is sent: the text with its protected parts hidden. A text without any, which one
    look tells, is sent as it is."""
    hide = F.lit(where) if isinstance(where, bool) else where
    return F.when(hide & has_protected(text_col, html), mask_protected(text_col, prefix=prefix, html=html)["text"]
                  ).otherwise(F.col(text_col))


def unmasked(answer: str, text_col: str, where: Column | bool = True, prefix: str = "", html: bool = False) -> Column:
    """Undo :func:`masked` in an answer. The map is made again from the text: only strings
    travel through the Python stage."""
    hide = F.lit(where) if isinstance(where, bool) else where
    return F.when(hide & has_protected(text_col, html), unmask(
        answer, mask_protected(text_col, prefix=prefix, html=html)["term_map"], prefix)).otherwise(F.col(answer))


def translate_segments(
    segs: DataFrame, fn: Callable[[list[str]], list[str]], policy: RetryPolicy | None = None,
    batch_size: int = 25, partitions: int | None = None, mask: bool = False,
    text_col: str = "text", keep: list[str] | None = None, spread: bool = True,
) -> DataFrame:
    """``(text, translated, status, attempts)`` of distinct segments, one language, one engine.

    ``fn`` maps a list of texts to a list of equal length. Status is ``ok``, ``kept`` (the
    call failed) or ``misaligned``; in the last two the original stands in. ``keep`` names
    further columns of ``segs`` to carry through. ``spread=False`` is for ``segs`` that a shuffle
    has dealt out, see :func:`call_stage`.
    """
    engine = Engine(lambda texts, _: fn(texts), batch_size, policy or RetryPolicy())
    src = segs.select(text_col, *(keep or []))
    if mask:
        src = src.withColumn("__sent", masked(text_col))
    called = call_stage(src, "__sent" if mask else text_col, [], engine, partitions, spread)
    return called.withColumn("translated", unmasked("translated", text_col)) if mask else called


def translate_by_engine(
    segs: DataFrame, engines: dict[str, Engine], engine_col: str = "llm_provider",
    language_col: str = "target_language", text_col: str = "text", partitions: int | None = None,
    spread: bool = True,
) -> DataFrame:
    """The same for distinct (engine, language, text): every request goes to the engine its
    rows name, with that engine's batch size, retries, pace and masking."""
    src = segs.select(engine_col, language_col, text_col)
    masking, symbols = ([name for name, e in engines.items() if use(e)] for use in (lambda e: e.mask, lambda e: e.symbols))
    plain, sent = text_col, text_col  # one copy of a text moves and is sorted, unless it is changed before it goes out
    if symbols:
        plain = sent = "__plain"
        src = src.withColumn(plain, F.when(F.col(engine_col).isin(symbols), map_symbols(text_col)).otherwise(F.col(text_col)))
    if masking:
        sent, hidden = "__sent", F.col(engine_col).isin(masking)
        src = src.withColumn(sent, masked(plain, hidden))
    called = call_stage(src, sent, [engine_col, language_col], engines, partitions, spread)
    answer = unmasked("translated", plain, hidden) if masking else F.col("translated")
    restored = F.when(F.col("status") == "ok", answer).otherwise(F.col(text_col))
    return called.withColumn("translated", restored).drop("__plain")


def translate_chunks(
    chunks: DataFrame, fn: Callable[[str], str], policy: RetryPolicy | None = None,
    keys: tuple[str, ...] = ("doc_id", "chunk_index"), html: str = "html",
    original: Column | None = None, partitions: int | None = None, spread: bool = True,
    language: str | None = None, mask: bool = False,
) -> DataFrame:
    """Translate wrapped chunks one by one and keep the body of each answer.

    ``fn`` takes the HTML, and the language when a ``language`` column is named.

    On an error the original pages of that chunk stay (``original``, by default the body of
    the chunk). ``mask`` hides protected terms and ``[[…]]``, also in their escaped forms, and
    puts them back into the answer. ``spread=False`` is for streams, which are placed by their
    source unless the policy has a gap.
    """
    policy = policy or RetryPolicy()
    # one copy of a chunk goes through Python, two where it is masked: its body is cut out after the call
    src = chunks.withColumn("__sent", masked(html, html=True)) if mask else chunks
    src = src if original is None else src.withColumn("__original", original)
    src, sent = src.withColumnRenamed(html, "__source"), "__sent" if mask else "__source"
    names = [f.name for f in src.schema.fields if f.name != "__sent"]

    def one(texts: list[str], *extra) -> list[str]:
        return [fn(texts[0], *extra)]

    lanes = policy.lanes(n := default_partitions(chunks, partitions))
    paced = spread or bool(policy.gap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paces: dict[int, Pace] = {}

        def ask(job: tuple) -> tuple[list, list, list]:
            text, lane, extra = job
            return ask_batch(one, policy, [text], *extra, pace=paces[lane])

        for pdf in batches:
            own = pdf["__lane"].tolist() if paced else [0] * len(pdf)
            paces |= {k: Pace(policy, k, lanes) for k in set(own) - set(paces)}
            extra = pdf[[language]].values.tolist() if language else [[]] * len(pdf)
            answers = in_order(zip(pdf[sent].tolist(), own, extra), ask, policy.in_flight)
            for at in range(0, len(pdf), CHUNKS_HELD):  # answers go as they come, they do not wait for the batch
                out = pdf[names].iloc[at:at + CHUNKS_HELD].copy()
                done = list(itertools.islice(answers, len(out)))
                out["__answer"], out["status"], out["attempts"] = ([d[k][0] for d in done] for k in range(3))
                yield out

    schema = src.select(*names).schema.add("__answer", "string").add("status", "string").add("attempts", "integer")
    if paced:
        src = in_lanes(src, F.xxhash64(*keys), {None: policy}, n)
    called = src.mapInPandas(run, schema)
    if mask:
        called = called.withColumn("__answer", unmasked("__answer", "__source", html=True))
    # white space and a code fence around the answer go before the body is cut out
    called = called.withColumn("__answer", strip_code_fence("__answer", "plain"))
    whole = F.col("__original") if original is not None else extract_body("__source")
    return called.withColumn(
        html, F.when(F.col("status") == "ok", extract_body("__answer")).otherwise(whole)
    ).drop("__answer", "__original", "__source")


def translate_html(
    docs: DataFrame, engine: Engine, html: str = "html", language: str = "target_language",
    out: str = "translated", partitions: int | None = None,
) -> DataFrame:
    """Whole HTML documents, one a call, for an engine that reads HTML.

    Style blocks and image data are hidden before the call. After it the three entities that
    such an engine adds are decoded, and images and styles put back; a style whose place was
    damaged goes to the front. Adds ``out``, ``status`` and ``attempts``; on an error the
    document stays as it is. ``engine.fn`` is called as ``fn([html], language)``.
    """
    one = replace(engine, batch_size=1)
    hidden = docs.withColumn("__styled", mask_styles(html)["text"]).withColumn("__sent", mask_images("__styled")["text"])
    called = call_stage(hidden.drop("__styled"), "__sent", [language], one, partitions)
    # columns, not one expression: what is named more than once is computed once
    read = (
        called.withColumn("__styles", mask_styles(html))
        .withColumn("__images", mask_images("__styles.text")["term_map"])
        .withColumn("__answer", unmask_images(decode_entities("translated"), "__images"))
        .withColumn("__answer", unmask_styles("__answer", "__styles.term_map"))
    )
    done = F.when(F.col("status") == "ok", F.col("__answer")).otherwise(F.col(html))
    return read.withColumn("translated", done).drop("__styles", "__images", "__answer").withColumnRenamed("translated", out)


def align_lines(batches: DataFrame, segments: str = "segments", response: str = "response",
                keys: tuple[str, ...] = ("batch_no",)) -> DataFrame:
    """Pair the lines of an answer with the segments sent, by position.

    Blank lines are dropped, surplus on either side is dropped, as line-based engines are
    read. :func:`docloom.operators.quality.check_counts` tells which batches were off.
    """
    lines = F.filter(
        F.transform(F.split(strip_code_fence(response, "batch"), "\n", -1), lambda x: trim_ws(x)),
        lambda x: x != "")
    sized = batches.withColumn("__lines", lines)
    n = F.least(F.size(segments), F.size("__lines"))
    pairs = F.arrays_zip(F.slice(segments, F.lit(1), n).alias("text"),
                         F.slice("__lines", F.lit(1), n).alias("translated"))
    rows = sized.select(*keys, F.posexplode(pairs).alias("pos", "p"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"),
                       F.col("p")["text"].alias("text"), F.col("p")["translated"].alias("translated"))


TOKEN_NOTE = (
    "Copy every __TERM_N__ and __BRACKET_N__ token into the answer unchanged.\n"
)
SEGMENT_TEMPLATE = (
    "Translate each line into {language}. {note}"
    "Answer with exactly {count} lines, one for each input line, and nothing else.\n---\n{segments}\n---\n"
)
REVIEW_TEMPLATE = (
    "Parts of this {language} document may still be in the source language. {note}"
    "Translate only those {count} lines and return them in order.\n---\n{segments}\n---\n"
)


def build_prompts(batches: DataFrame, language: str, segments: str = "segments",
                  term_map: str | None = None, template: str = SEGMENT_TEMPLATE,
                  out: str = "prompt") -> DataFrame:
    """Fill a template for each batch: language name, size, segments, and the token note
    only when a term was masked."""
    note = F.lit("")
    if term_map:
        note = F.when(F.size(term_map) > 0, TOKEN_NOTE).otherwise("")
    values = {
        "language": language_name(language), "note": note,
        "count": F.size(segments).cast("string"), "segments": F.array_join(segments, "\n"),
    }
    # cut the template at its fields, so text that looks like a field stays as it is
    pieces, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        pieces.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(values[name])
    return batches.withColumn(out, F.concat(*pieces))
