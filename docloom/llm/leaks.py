"""Benchmark passages in documents: CGK embedding, bit-sampling hashing, exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

SIMILARITY, REPETITIONS, MIN_WORDS, SEED = 0.8, 16, 1, 7
#: items under so many words leave the walks too few steps: they are found by their exact words first
WALKED = 5
MAX_ITEMS, CHUNK, GAP, SHORT = 100_000, 1 << 18, 3, 15

#: lower case; ASCII punctuation separates words
_PLAIN = bytes(
    ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else (32 if c < 128 else c) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


class Leaks:
    """Finds items in texts. Built once on the driver from the items, sent to the tasks.

    The embedding walks a window with a pointer: step j writes the word under the pointer and
    then moves on or stays, by a random bit drawn for (j, word). Equal words keep two walks
    together, and after an edit they find each other again, so few edits change few steps. A
    repetition draws new bits and five steps; a window that shows an item's words at
    all of them is a candidate. Every place of a text starts a window. Words that stand in no
    item count as one word.

    An item is entered at its first three words and at every GAP words to its end, so edits
    that lie together decide nothing wherever they are: walks begin behind them and between
    them. Four samples lie among the first steps behind an entry, the same for all items of a
    repetition: they drop most windows before the walk goes on; the fifth may lie anywhere
    behind them. Items under SHORT words have half as many repetitions more, of close samples:
    the words that edits leave together there are few. Items under WALKED words allow no edit
    at a similarity of 0.8 (one in five words), so they are looked up word by word as they are.
    """

    def __init__(self, items: list[tuple[int, str]], similarity: float, repetitions: int, seed: int,
                 min_words: int = MIN_WORDS) -> None:
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if len(w) >= max(min_words, 1)]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.short = self._short([(i, w) for i, w in split if len(w) < WALKED], similarity)
        split = [(i, w) for i, w in split if len(w) >= WALKED]
        self.ids = [i for i, _ in split]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in split]
        self.edits = [int(len(w) * (1 - similarity) + 1e-9) for w in self.words]
        rng = np.random.default_rng(seed)
        longest = max((len(w) for w in self.words), default=0)
        self.planes = 1 + 4 * longest // 64
        count = repetitions + repetitions // 2 if self.words else 0
        self.bits = rng.integers(0, 1 << 64, (count, self.planes, len(self.vocabulary) + 1), np.uint64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.spare = np.array(self.edits, np.int64)
        places = [sorted({*range(min(2, e) + 1), *range(0, len(w), GAP)}) for w, e in zip(self.words, self.edits)]
        item = np.repeat(np.arange(len(places)), [len(p) for p in places])
        offset = np.array([o for p in places for o in p], np.int64)
        self.tables = []
        entries: list[tuple[np.ndarray, ...]] = []  # item, offset, further step or -1, word there
        for r in range(count):
            early = np.cumsum([rng.integers(0, 4), *rng.integers(2, 5, 3)] if r < repetitions else [rng.integers(0, 2), *rng.integers(1, 3, 3)]).tolist()
            some = np.flatnonzero((r < repetitions) | (self.length[item] < SHORT))
            self.tables.append(self._table(r, early, 0.2 + 0.8 * rng.random(), item[some], offset[some], entries))
        self.item, self.offset, self.step, self.shown = (
            np.concatenate([e[k] for e in entries]).astype(np.int32) if entries else np.empty(0, np.int32) for k in range(4))

    def _short(self, items: list[tuple[int, list[bytes]]], similarity: float) -> list[tuple]:
        """For each length: the known beginnings of 2, 3, ... words, and the items of each whole."""
        if any(int(len(w) * (1 - similarity) + 1e-9) for _, w in items):
            raise ValueError(f"items under {WALKED} words are compared exactly: similarity must be over 0.75, or min_words {WALKED}")
        base, out = len(self.vocabulary) + 1, []
        for n in sorted({len(w) for _, w in items}):
            some = [(i, [self.vocabulary[x] for x in w]) for i, w in items if len(w) == n]
            words = np.array([w for _, w in some], np.int64)
            slot, levels = words[:, 0], []
            for k in range(1, n):
                known, slot = np.unique(slot * base + words[:, k], return_inverse=True)
                levels.append(known)
            ids: dict[int, list[int]] = {}
            for (i, _), s in zip(some, slot.tolist()):
                ids.setdefault(s, []).append(i)
            out.append((n, levels, np.unique(slot), ids))
        return out

    def _exact(self, x: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item id, first word, words) of the short items, at their first place in a text."""
        base = len(self.vocabulary) + 1
        doc = np.repeat(np.arange(len(sizes)), sizes)
        for n, levels, whole, ids in self.short:
            at = np.flatnonzero(x[:len(doc)])
            at = at[at + n <= ends[doc[at]]]
            slot = x[at]
            for k, known in enumerate(levels, 1):
                key = slot * base + x[at + k]
                slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
                keep = known[slot] == key
                at, slot = at[keep], slot[keep]
            keep = np.isin(slot, whole)
            at, slot = at[keep], slot[keep]
            _, first = np.unique(doc[at] * base + slot, return_index=True) if not levels else np.unique(
                doc[at] * len(levels[-1]) + slot, return_index=True)
            for a, s in zip(at[first].tolist(), slot[first].tolist()):
                for i in ids[s]:
                    yield int(doc[a]), i, int(a - (ends[doc[a]] - sizes[doc[a]])), n

    def _table(self, r: int, early: list[int], rest: float, item: np.ndarray, offset: np.ndarray, entries: list):
        """The entries of one repetition, by the words they show at its early steps."""
        base = len(self.vocabulary) + 1
        flat = np.concatenate(self.words)
        ends = np.cumsum(self.length)
        shown, new, total = [], [], 0
        for some in np.array_split(np.arange(len(item)), 1 + len(item) // 8192):
            at, end = (ends - self.length)[item[some]] + offset[some], ends[item[some]]
            trail, steps = [], np.zeros(len(some), np.int64)
            while len(trail) < 64 * self.planes and (at < end).any():
                j, on = len(trail), at < end
                w = np.where(on, flat[np.minimum(at, len(flat) - 1)], 0)
                trail.append(w)
                steps += on
                at = at + (on & (self.bits[r, j >> 6, w] >> np.uint64(j & 63) & np.uint64(1)).astype(bool))
            behind = steps - 1 - early[-1]
            long = np.flatnonzero(behind >= 0)  # else the walk ends before the samples
            if not len(long):
                continue
            trail, behind = np.stack(trail), behind[long]
            # one more sample anywhere behind the early ones
            step = np.where(behind > 0, early[-1] + 1 + ((behind - 1) * rest).astype(np.int64), -1)
            shown.append(trail[early][:, long].T)
            new.append((item[some][long], offset[some][long], step, np.where(step >= 0, trail[step, long], -1)))
            total += len(long)
        words = np.concatenate(shown) if shown else np.empty((0, len(early)), np.int64)
        second = np.zeros(base, bool)
        second[words[:, 1]] = True
        slot_of = np.full(base, -1, np.int64)
        firsts, slot = np.unique(words[:, 0], return_inverse=True)
        slot_of[firsts] = np.arange(len(firsts))
        levels = []
        for k in range(1, len(early)):
            known, slot = np.unique(slot * base + words[:, k], return_inverse=True)
            levels.append(known)
        order = np.argsort(slot, kind="stable")
        _, first, count = np.unique(slot[order], return_index=True, return_counts=True)
        start = sum(len(e[0]) for e in entries)
        if total:
            entries.append(tuple(np.concatenate([n[k] for n in new])[order] for k in range(4)))
        return early, slot_of, second, levels, first + start, count

    def _places(self, upto: np.ndarray, n: int) -> np.ndarray:
        """The places where a window can hold some item at all: it has the item's words but for
        the edits, so at least so many words that stand in items. Nothing is lost by it."""
        start, ok = np.arange(n), np.zeros(n, bool)
        lengths = np.unique(self.length)
        for some in np.array_split(lengths, min(6, len(lengths))):
            low, high = np.isin(self.length, some[:1]), np.isin(self.length, some[-1:])
            longest, spare = int(some[-1]), int(self.spare[high].max())
            # a window may start at any word of its item
            known = upto[np.minimum(start + longest + spare, n)] - upto[np.maximum(start - longest - spare, 0)]
            ok |= known >= int(some[0]) - int(self.spare[low].max())
        return np.flatnonzero(ok)

    def _early(self, r: int, x: np.ndarray, places: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(window, pointer, entry) of the windows that agree with an entry at the early steps."""
        early, slot_of, second, levels, first, count = self.tables[r]
        none = np.empty(0, np.int64)
        if not len(first):
            return none, none, none, early[-1]
        moves = self.bits[r, 0][x]

        def walk(at: np.ndarray, since: int, to: int) -> np.ndarray:
            for j in range(since, to):
                at = at + ((moves[at] >> np.uint64(j)) & np.uint64(1)).view(np.int64)
            return at

        at = walk(places, 0, early[0])
        slot = slot_of[x[at]]
        keep = np.flatnonzero(slot >= 0)
        begin, at, slot = places[keep], at[keep], slot[keep]
        for k, known in enumerate(levels):
            at = walk(at, early[k], early[k + 1])
            seen = x[at]
            if k == 0:  # most windows end here: a look at the word alone is cheaper
                keep = np.flatnonzero(second[seen])
                begin, at, slot, seen = begin[keep], at[keep], slot[keep], seen[keep]
            key = slot * len(slot_of) + seen
            slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
            keep = np.flatnonzero(known[slot] == key)
            begin, at, slot = begin[keep], at[keep], slot[keep]
        if not len(begin):
            return none, none, none, early[-1]
        times = count[slot]
        entry = np.repeat(first[slot] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        begin, at = np.repeat(begin, times), np.repeat(at, times)
        item = self.item[entry]
        start = begin - self.offset[entry]
        low, high = np.maximum(start - self.spare[item], 0), start + self.length[item] + self.spare[item]
        known = upto[np.minimum(high, len(upto) - 1)] - upto[low]
        keep = known >= self.length[item] - self.spare[item]
        return begin[keep], at[keep], entry[keep], early[-1]

    def _candidates(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, where they would start, and the windows that tell so; ``x`` holds the n words
        and room for a walk past them."""
        upto = np.concatenate(([0], np.cumsum(x[:n] > 0)))
        places = self._places(upto, n)
        found = [(r, *self._early(r, x, places, upto)) for r in range(len(self.tables))]
        begin, at, entry = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
        r = np.concatenate([np.full(len(f[1]), f[0]) for f in found])
        step = np.concatenate([np.full(len(f[1]), f[4]) for f in found])
        starts, items, windows = [], [], []
        while True:
            done = self.step[entry] <= step  # no sample behind the early ones, or shown there
            starts.append(begin[done] - self.offset[entry[done]])
            items.append(self.item[entry[done]])
            windows.append(begin[done])
            begin, at, entry, r, step = (v[~done] for v in (begin, at, entry, r, step))
            if not len(entry):
                break
            moves = self.bits[r, step >> 6, x[at]] >> (step & 63).astype(np.uint64)
            at = at + (moves & np.uint64(1)).view(np.int64)
            step = step + 1
            alive = (self.step[entry] != step) | (x[at] == self.shown[entry])
            begin, at, entry, r, step = (v[alive] for v in (begin, at, entry, r, step))
        found = np.unique(np.stack([np.concatenate(v) for v in (items, starts, windows)], 1), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, edits, first word, words of the item), once for each row and item."""
        out: list[tuple[int, int, int, int, int]] = []
        parts: list[np.ndarray] = []
        rows: list[int] = []
        total = 0
        for row, text in enumerate(texts):
            ws = words_of(text)
            parts.append(np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int64, len(ws)))
            rows.append(row)
            total += len(ws)
            if total >= CHUNK or row + 1 == len(texts):
                out += self._chunk(parts, rows)
                parts, rows, total = [], [], 0
        return out

    def _chunk(self, parts: list[np.ndarray], rows: list[int]) -> list[tuple[int, int, int, int, int]]:
        if not self.vocabulary:
            return []
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        x = np.concatenate([*parts, np.zeros(64 * self.planes + 8, np.int64)])
        short = [(rows[d], i, 0, at, k) for d, i, at, k in self._exact(x, sizes, ends)]
        if not self.tables:
            return sorted(short)
        items, starts, windows = self._candidates(x, n)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item in np.unique(items):
            words, edits = self.words[item], self.edits[item]
            at = starts[items == item]
            # a candidate may begin before its text, where its first words are missing
            doc = np.searchsorted(ends, windows[items == item], "right")
            low, high = np.maximum(at - edits, ends[doc] - sizes[doc]), np.minimum(at + len(words) + edits, ends[doc])
            member = np.zeros(len(self.vocabulary) + 1, bool)
            member[words] = True
            seen = np.r_[0, np.cumsum(member[x[:n]])] if len(at) > 2000 else None
            if seen is not None:
                known = seen[high] - seen[low]
            else:
                known = np.array([int(member[x[a:b]].sum()) for a, b in zip(low, high)])
            keep = known >= len(words) - edits
            # stretches of one text that overlap are one
            low, high, doc, at = low[keep], high[keep], doc[keep], at[keep]
            apart = (doc[1:] != doc[:-1]) | (low[1:] >= np.maximum.accumulate(high)[:-1])
            for group in np.split(np.arange(len(at)), np.flatnonzero(apart) + 1) if len(at) else []:
                a, b, d = low[group[0]], high[group].max(), doc[group[0]]
                exact = [s for s in at[group] if s >= a and s + len(words) <= b and np.array_equal(x[s:s + len(words)], words)]
                found = (0, exact[0]) if exact else _align(words, x[a:b], a)
                if found[0] <= edits and found < best.get((d, item), (9**9, 0)):
                    best[d, item] = found
        return sorted(short + [(rows[d], self.ids[i], int(k), int(s - (ends[d] - sizes[d])), len(self.words[i]))
                               for (d, i), (k, s) in best.items()])


def _align(words: np.ndarray, text: np.ndarray, base: int) -> tuple[int, int]:
    """(least edits that turn a stretch of ``text`` into ``words``, where it begins)."""
    m = len(words)
    steps = np.arange(m + 1)
    cost, begin = steps.copy(), np.zeros(m + 1, np.int64)
    best = (int(cost[m]), base)
    for j, w in enumerate(text):
        new = np.empty_like(cost)
        new[0] = 0
        diagonal = cost[:-1] + (words != w)
        new[1:] = np.minimum(diagonal, cost[1:] + 1)
        origin = np.empty_like(begin)
        origin[0] = j + 1
        origin[1:] = np.where(diagonal <= cost[1:] + 1, begin[:-1], begin[1:])
        low = np.minimum.accumulate(new - steps) + steps
        moved = low < new
        if moved.any():  # a word of the item is missing: the origin is that of the last unmoved place
            source = np.maximum.accumulate(np.where(moved, 0, steps))
            origin = origin[source]
        cost, begin = low, origin
        best = min(best, (int(cost[m]), base + int(begin[m])))
    return best


def _index(benchmark: DataFrame, similarity: float, repetitions: int, seed: int, max_items: int,
           min_words: int) -> Leaks:
    items = [(r[0], r[1]) for r in benchmark.where("item_id is not null and text is not null")
             .select("item_id", "text").distinct().orderBy("item_id", "text").limit(max_items + 1).collect()]
    if len(items) > max_items:
        raise ValueError(f"more than {max_items} benchmark items: pass them in parts, or raise max_items")
    return Leaks(items, similarity, repetitions, seed, min_words)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    repetitions: int = REPETITIONS,
    seed: int = SEED,
    max_items: int = MAX_ITEMS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Items of ``benchmark`` (item_id, text) that documents (doc_id, text) hold.

    Returns (doc_id, item_id, edits, similarity, at_word, n_words): for each row and item at
    most one row, with the best place found. A document holds an item if at most
    (1 - similarity) * words of word edits turn a stretch of it into the item; words are
    compared in lower case, without ASCII punctuation. ``repetitions`` is set for a recall
    over 0.9 at the limit of edits, scattered or together at the head, the middle or the tail.
    Measured at 10 % and 20 % of words edited in each of these ways, 120 passages each: at
    least 0.99 for items of 5-9 words, 1.0 for items of 10-59.

    Whole texts are searched; null, empty and wordless texts hold nothing. Wordless, null and
    empty items, and those of fewer than ``min_words`` words, are left out. Items under WALKED
    words are found where all their words stand in order. More than ``max_items`` items raise an error, since the items go to every task. A null doc_id is
    searched like any other. Equal rows give equal results each. Other columns are not read.
    """
    index = _index(benchmark, similarity, repetitions, seed, max_items, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = index.find(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[f[0]] for f in found], pa.int64()),
                "item_id": pa.array([f[1] for f in found], pa.int64()),
                "edits": pa.array([f[2] for f in found], pa.int32()),
                "similarity": pa.array([1 - f[2] / f[4] for f in found], pa.float64()),
                "at_word": pa.array([f[3] for f in found], pa.int64()),
                "n_words": pa.array([f[4] for f in found], pa.int32()),
            })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, item_id long, edits int, similarity double, at_word long, n_words int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                  repetitions: int = REPETITIONS, seed: int = SEED, max_items: int = MAX_ITEMS,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the rows whose text holds an item, by ``find_leaks``; columns as they are."""
    index = _index(benchmark, similarity, repetitions, seed, max_items, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[f[0] for f in index.find(batch.column("text").to_pylist())]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_benchmark_leaks": op6_benchmark_leaks}
