"""Text quality by Bradley-Terry ranking: logistic loss on feature differences of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import id_crc32, table, uniform

#: about so many labelled rows are read, and so many preference pairs drawn from them
SAMPLE_ROWS, PAIRS, ROUNDS, THRESHOLD = 8_000, 100_000, 300, 0.7
MARKS = 64

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 ASCII punctuation
for _c in range(128):
    _KIND[_c] = (1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit()
                 else 4 if _c in (9, 10, 11, 12, 13, 32) else 5 if 33 <= _c < 127 else 0)
_KIND[128:] = 6
del _c


def features(texts: list[str | None]) -> np.ndarray:
    """A row of numbers for each text, from all of its bytes, words and lines."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), 24 + MARKS))
    for n, b in enumerate(raw):
        if not b:
            out[n, 0] = 1
            continue
        x = np.frombuffer(b, np.uint8)
        kind = _KIND[x]
        share = np.bincount(kind, minlength=7) / len(x)
        words = b.split()
        n_words = max(1, len(words))
        lines = b.split(b"\n")
        lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
        # how often one kind of character follows another, and the rate of each symbol
        turns = np.bincount(kind[:-1].astype(np.int64) * 7 + kind[1:], minlength=49)
        marks = np.bincount(x[kind == 5], minlength=128)
        distinct = len(set(words)) / n_words
        out[n, 1:8] = share
        out[n, 8:24] = (
            np.log1p(n_words), np.log1p(len(lines)), lengths.mean() / 10, lengths.std() / 10, distinct,
            len(set(lines)) / len(lines), np.log1p(lengths.max()), (lengths <= 2).mean(), (lengths >= 12).mean(),
            turns[2 * 7 + 2] / len(x), turns[5 * 7 + 5] / len(x), turns[1 * 7 + 2] / len(x), turns[4 * 7 + 5] / len(x),
            turns[5 * 7 + 4] / len(x), turns[1 * 7 + 3] / len(x), np.abs(marks).max() / max(1, marks.sum()),
        )
        out[n, 24:56] = np.log1p(1000 * (marks[32:64]) / len(x))
        out[n, 56:88] = np.log1p(1000 * np.bincount(x[kind == 5] & 31, minlength=32)[:32] / len(x))
    return out


class Ranking:
    """Scores of the Bradley-Terry model P(a preferred to b) = logistic(score(a) - score(b))."""

    def __init__(self, x: np.ndarray, label: np.ndarray, pairs: int, rounds: int, threshold: float, seed: int) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.weights = np.zeros(x.shape[1])
        self.shift = 0.0
        self.known = bool(len(x)) and 0 < label.sum() < len(label)
        if not self.known:
            return
        z = self._scaled(x)
        rng = np.random.default_rng(seed)
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]  # preferred minus other
        velocity = np.zeros_like(self.weights)
        for _ in range(rounds):
            miss = 1 / (1 + np.exp(np.clip(d @ self.weights, -30, 30)))
            gradient = -(d.T @ miss) / pairs + 1e-3 * self.weights
            velocity = 0.9 * velocity - 0.05 * gradient
            self.weights += velocity
        score = z @ self.weights
        # the quantile of the scores that the labels' share of 0 sets is where the threshold lies
        cut = float(np.quantile(score, 1 - label.mean()))
        low, high = np.median(score[label == 0]), np.median(score[label == 1])
        self.scale_out = 4 / max(1e-6, high - low)
        self.shift = float(np.log(threshold / (1 - threshold))) - cut * self.scale_out

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; everywhere 0.5 when the sample held one label only or none."""
        if not self.known:
            return np.full(len(texts), 0.5)
        raw = self._scaled(features(texts)) @ self.weights * self.scale_out + self.shift
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    sample_rows: int = SAMPLE_ROWS,
    pairs: int = PAIRS,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
    seed: int = 11,
) -> Ranking:
    """A ranking from preference pairs: a document of quality 1 is preferred to one of 0.

    Reads about ``sample_rows`` labelled rows for which ``learn_from`` holds, drawn by their
    id; ``pairs`` pairs are drawn from them. A document with several labels counts by their
    mean, a half as 1; null labels and ids do not count. The score is moved so that
    ``threshold`` lies at the quantile of the sample's scores that its share of 0 sets.
    """
    known = labels.where("doc_id is not null and quality is not null").where(learn_from).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("__label"))
    total = known.count()
    share = min(1.0, sample_rows / max(1, total))
    few = known.where(uniform(F.lit(seed), F.col("doc_id")) < share)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                x = features(part.column(1).to_pylist()).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    # the sample is bounded: about sample_rows ids are sent to the texts, and as many feature rows come back
    rows = texts.join(F.broadcast(few), "doc_id").select(
        F.col("doc_id").cast("long"), "text", "__label").mapInArrow(run, "id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    width = 24 + MARKS
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f4").reshape(-1, width).astype(float)
    return Ranking(x if len(x) else np.zeros((1, width)), np.array([r["label"] for r in rows]), pairs, rounds, threshold, seed)


def score_quality(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) for each row, by the whole text; predicted is 1 from ``threshold`` on.

    Null and empty texts are scored as texts without characters. Equal rows give equal results
    each; a null id is kept; other columns are not read; an empty table gives an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                score = ranking.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["id", "score", "predicted"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = id_crc32("doc_id", 4)
    ranking = learn(docs, labels, fold != 2)
    return score_quality(docs, ranking).select("doc_id", (fold == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_ranking": op10_quality_ranking}
