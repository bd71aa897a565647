"""Language by cross-parsing: suffix automata of labelled text, fewest phrases wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import id_crc32, table, uniform

#: per language about SAMPLE_ROWS labelled rows are read, and SAMPLE_BYTES of their text
SAMPLE_ROWS, SAMPLE_BYTES, MAX_LANGUAGES = 96, 40_000, 64
WINDOW, CHUNK = 256, 1 << 22


def _plain_table() -> np.ndarray:
    """Bytes to bytes: ASCII letters and bytes of other characters stay, the rest is a space."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in range(128):
        if chr(c).isalpha():
            out[c] = c
    return out


_PLAIN = _plain_table()


def plain(text: str) -> np.ndarray:
    """Lower-cased UTF-8 bytes with one space for each run of ASCII non-letters."""
    raw = _PLAIN[np.frombuffer(f" {text} ".lower().encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    return raw[keep]


def automaton(symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix automaton of ``symbols``: next[state, symbol], -1 where no suffix goes on.

    Its states are reached by exactly the substrings of the text, so following it from the
    root gives the longest match of what is read.
    """
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table_ = np.full((len(step), alphabet), -1, np.int32)
    for s, moves in enumerate(step):
        for c, t in moves.items():
            table_[s, c] = t
    return table_, np.array(length)


class CrossParser:
    """Phrases of a text by each language's automaton, for many windows of text in step.

    The text is cut from left to right into the longest phrases that stand in a language's
    sample. Texts are parsed in windows of ``WINDOW`` bytes, so that all windows of a batch
    move in step; a window's border ends a phrase in every language alike. A language's
    entropy is phrases * log2(sample bytes) / bytes; the fewest normalised phrases win.
    """

    def __init__(self, samples: dict[str, np.ndarray]) -> None:
        self.languages = sorted(samples)
        used = np.zeros(256, bool)
        for s in samples.values():
            used[s] = True
        self.symbol = np.full(256, int(used.sum()), np.int32)  # bytes that no sample has
        self.symbol[used] = np.arange(used.sum())
        self.alphabet = int(used.sum()) + 2  # the last one: past the end
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.languages])
        self.moves = []
        for name in self.languages:
            nxt, _ = automaton(self.symbol[samples[name]], self.alphabet)
            broken = nxt < 0
            total = np.where(broken, np.maximum(nxt[0], 0), nxt)
            # an unknown symbol is a phrase of its own
            value = total.astype(np.int64) * self.alphabet * 2 + broken
            value[:, -1] = np.arange(len(nxt)) * self.alphabet * 2
            self.moves.append(value.astype(np.int32).ravel())

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases in bits for (text, language), and bytes of each text."""
        parts = [plain(t) for t in texts]
        sizes = np.array([len(p) for p in parts])
        phrases = np.zeros((len(texts), len(self.languages)))
        first = 0
        while first < len(texts):
            last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), CHUNK, "right")))
            counts = -(-sizes[first:last] // WINDOW)
            owner = np.repeat(np.arange(first, last), counts)
            flat = np.full(int(counts.sum()) * WINDOW, self.alphabet - 1, np.int32)
            at = 0
            for k in range(first, last):
                flat[at:at + sizes[k]] = self.symbol[parts[k]]
                at += int(counts[k - first]) * WINDOW
            steps = np.ascontiguousarray(flat.reshape(-1, WINDOW).T)
            for n, moves in enumerate(self.moves):
                state, broken = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
                for c in steps:
                    state += c
                    value = moves[state]
                    broken += value & 1
                    state = value >> 1
                broken += state != 0
                phrases[:, n] += np.bincount(owner, broken, len(texts))
            first = last
        return phrases * self.bits, sizes


def _samples(labelled: DataFrame, rows: int, size: int, most: int, seed: int) -> dict[str, np.ndarray]:
    """Per language, up to ``size`` bytes of about ``rows`` rows drawn by their id.

    The counts cover all rows. From each drawn text comes a stretch of size / rows bytes or
    more at a place drawn by the id, so that long texts do not crowd out the others.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages: raise max_languages")
    if not counts:
        return {}
    draw = uniform(F.lit(seed), F.col("id"))
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, rows / r["n"]))) for r in counts])
    stretch = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(4 * size // min(rows, r["n"]))) for r in counts])
    begin = (uniform(F.lit(seed + 1), F.col("id")) * F.greatest(F.length("text") - stretch, F.lit(0))).cast("int")
    drawn = labelled.where(draw < share).select(
        "lang", draw.alias("u"), "id", F.substring(F.col("text"), begin + 1, stretch).alias("text"))
    got: dict[str, list] = {}
    for r in drawn.collect():  # about rows * languages stretches of bounded length
        got.setdefault(r["lang"], []).append((r["u"], r["id"] or 0, r["text"]))
    out = {}
    for lang, some in got.items():
        each = max(1, -(-size // len(some)))
        pieces = [plain(t)[:each] for _, _, t in sorted(some)]
        text = np.concatenate(pieces)[:size]
        if len(text) > 2:
            out[lang] = text
    return out


def learn(
    docs: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    max_languages: int = MAX_LANGUAGES,
    seed: int = 3,
) -> CrossParser:
    """Automata of a bounded sample for each language: of about ``sample_rows`` rows, with text
    and language, for which ``learn_from`` holds, at most ``sample_bytes`` bytes."""
    labelled = docs.where(learn_from).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang")).where(
        r"lang is not null and text rlike '\\p{L}'")
    return CrossParser(_samples(labelled, sample_rows, sample_bytes, max_languages, seed))


def _judge(parser: CrossParser, texts: list[str | None], letters: list[bool]) -> tuple[list[str], np.ndarray]:
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    rows = [i for i, ok in enumerate(letters) if ok]
    if rows and parser.languages:
        bits, _ = parser.entropies([texts[i] for i in rows])
        order = np.argsort(bits, 1, kind="stable")
        share = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
        for k, i in enumerate(rows):
            names[i] = parser.languages[order[k, 0]]
            score[i] = 1 / share[k].sum()
    return names, score


def predict(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row, by the whole text.

    ``score`` is the winner's share of 2**-bits over the languages, bits being phrases *
    log2(sample bytes). A null text, one without a letter, and every text when nothing was
    learned get ``und`` and 0. Ties go to the first language by name. Equal rows give equal
    results each; other columns are not read; an empty table gives an empty one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 2048):
                part = batch.iloc[s:s + 2048]
                names, score = _judge(parser, list(part["text"]), list(part["letters"]))
                yield pd.DataFrame({"id": part["id"], "lang_pred": names, "score": score})

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = base.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInPandas(
        run, "id long, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, factor: float = 1.6, least: int = 300) -> DataFrame:
    """``docs`` (doc_id, text, lang and more) without what language identification rejects.

    Learns from rows with a language. A row goes that is called ``und``, having no letter, or
    whose ``lang`` is a learned one while its text, of ``least`` bytes or more, needs ``factor``
    times as many bits in it as in the predicted one: what it says of itself is wrong. Languages
    tie on a text of a word or two, and a line of a licence may be known in one language only,
    so short texts and close ones stay; so does a ``lang`` that is null or was not learned.
    Columns stay as they are. Where no row has a language nothing can be told apart,
    and rows without a letter go.
    """
    parser = learn(docs, F.lit(True))
    place = {lang: k for k, lang in enumerate(parser.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                letters, stated = (part.column(batch.num_columns - k).to_pylist() for k in (1, 2))
                texts = part.column(batch.schema.get_field_index("text")).to_pylist()
                keep = np.array(letters, bool)
                rows = np.flatnonzero(keep)
                if len(rows) and parser.languages:
                    bits, sizes = parser.entropies([texts[i] for i in rows])
                    own = np.array([place.get(stated[i], -1) for i in rows])
                    keep[rows] = (own < 0) | (sizes < least) | (bits[np.arange(len(rows)), own] < factor * bits.min(1))
                yield part.filter(pa.array(keep)).select(range(batch.num_columns - 2))

    marked = docs.withColumn("__stated", F.col("lang").cast("string")).withColumn(
        "__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_crc32("doc_id", 3)
    return predict(docs, learn(docs, fold != 1)).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
