"""Spelling variants: words one edit apart, found by composing the vocabulary's acceptor with a
one-edit transducer and the acceptor again."""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import saved, shuffle_partitions, table

#: texts are cut into pieces of about so many characters, never inside a word
PIECE = 1 << 16
_LETTERS = r"[A-Za-zÀ-ÿ]"


def _spelled(id_col: str) -> Column:
    """The lower-cased run, or what is left of it where its checksum says that a letter goes."""
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), low).cast("binary"))
    at = (h % F.char_length(low)).cast("int")
    cut = F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.char_length(low)))
    return F.when(h % 97 == 0, cut).otherwise(low)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 5, uses: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``letters`` code points and ``uses`` occurrences."""
    text = F.col(text_col).cast("string")
    pieces = F.when(F.char_length(text) <= PIECE, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}{_LETTERS}*"), F.lit(0)))
    runs = docs.select(F.col(id_col).alias("id"), F.explode(pieces).alias("piece")).select(
        "id", F.explode(F.regexp_extract_all("piece", F.lit(_LETTERS + "+"), F.lit(0))).alias("run"))
    words = runs.select(_spelled("id").alias("word")).where(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= uses)


def initial_states(words: DataFrame, letters: int) -> DataFrame:
    """(m, back, half, word, n): the partitions in which a word's near words are looked for.

    Of two words one edit apart, the shorter of m code points, the edit lies in the last or in
    the first half. So they share the first m // 2 code points, or the last m - m // 2. What
    they share leads the acceptor, read forwards or backwards, to one state: the partition's
    initial state. A word may be the shorter one (m its length) or the longer (m one less).
    """
    size = F.char_length("word")
    m = F.explode(F.array(size, size - 1)).alias("m")
    sides = words.select("word", "n", m).where(F.col("m") >= letters).select(
        "*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    front = F.floor(F.col("m") / 2).cast("int")
    half = F.when(F.col("back"), F.substring("word", size - (F.col("m") - front) + 1, F.col("m") - front)).otherwise(
        F.substring("word", F.lit(1), front))
    return sides.select("m", "back", half.alias("half"), "word", "n")


class Acceptors:
    """Minimal acyclic acceptors of sorted words that share equal states.

    A state is known by its number; smaller numbers lie nearer the ends. ``arcs`` has for each
    code point the next state and how many words of this state come before those on the arc: so
    a path through the acceptor adds up to the place of its word in the list.
    """

    def __init__(self) -> None:
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []
        self.known: dict[tuple, int] = {}

    def add(self, words: list[str]) -> int:
        """The initial state for ``words``, sorted and distinct."""
        open_, last = [[False, {}]], ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(open_, last, same)
            open_ += [[False, {}] for _ in range(len(word) - same)]
            open_[-1][0] = True
            last = word
        self._close(open_, last, 0)
        return self._state(*open_[0])

    def _close(self, open_: list, word: str, depth: int) -> None:
        while len(open_) > depth + 1:
            state = self._state(*open_.pop())
            open_[-1][1][word[len(open_) - 1]] = state

    def _state(self, final: bool, targets: dict[str, int]) -> int:
        key = (final, *targets.items())
        if key not in self.known:
            before, arcs = int(final), {}
            for c, q in targets.items():
                arcs[c] = (q, before)
                before += self.count[q]
            self.known[key] = len(self.arcs)
            self.final.append(final)
            self.arcs.append(arcs)
            self.count.append(before)
        return self.known[key]

    def _alike(self, p: int, q: int, at_p: int, at_q: int) -> Iterator[tuple[int, int]]:
        """The edit is spent: words that go on alike from both states."""
        todo = [(p, q, at_p, at_q)]
        while todo:
            p, q, i, j = todo.pop()
            if p == q:
                yield from zip(range(i, i + self.count[p]), range(j, j + self.count[q]))
                continue
            if self.final[p] and self.final[q]:
                yield i, j
            b = self.arcs[q]
            for c, (to, before) in self.arcs[p].items():
                if c in b:
                    todo.append((to, b[c][0], i + before, j + b[c][1]))

    def replaced(self, start: int) -> Iterator[tuple[int, int]]:
        """Places i < j of words that differ by one replaced code point."""
        todo = [(start, 0)]
        while todo:
            p, i = todo.pop()
            ways = [(to, i + before) for to, before in self.arcs[p].values()]
            todo += ways
            for k, (a, at_a) in enumerate(ways):
                for b, at_b in ways[k + 1:]:
                    yield from self._alike(a, b, at_a, at_b)

    def inserted(self, short: int, long: int) -> Iterator[tuple[int, int]]:
        """(i, j) where word j of ``long`` is word i of ``short`` with one code point more; a pair
        comes as often as there are places for it."""
        todo = [(short, long, 0, 0)]
        while todo:
            p, q, i, j = todo.pop()
            a = self.arcs[p]
            for c, (to, before) in self.arcs[q].items():
                yield from self._alike(p, to, i, j + before)
                if c in a:
                    todo.append((a[c][0], to, i + a[c][1], j + before))


def near_pairs(m: int, back: bool, words: list[str]) -> Iterator[tuple[str, str]]:
    """The near pairs of one partition whose shorter word has m code points, each once; those that
    are found forwards as well are left to that partition."""
    front = m // 2
    shared = m - front if back else front
    sizes = []
    for size in (m, m + 1):
        own = [(w[::-1] if back else w)[shared:] for w in words if len(w) == size]
        order = sorted(range(len(own)), key=own.__getitem__)
        names = [w for w in words if len(w) == size]
        sizes.append(([own[k] for k in order], [names[k] for k in order]))
    (short, short_names), (long, long_names) = sizes
    if not short or len(short) + len(long) < 2:
        return
    acceptors = Acceptors()
    start = acceptors.add(short)
    found = [(short_names[i], short_names[j]) for i, j in acceptors.replaced(start)]
    if long:
        found += [(short_names[i], long_names[j]) for i, j in set(acceptors.inserted(start, acceptors.add(long)))]
    for x, y in found:
        if not back or x[:front] != y[:front]:
            yield x, y


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch[c].tolist() for c in ("m", "back", "half", "word", "n")])

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])

    out: list[tuple] = []
    for (m, back, _), group in groupby(rows(), key=lambda r: r[:3]):
        n = {r[3]: r[4] for r in group}
        if len(n) < 2:
            continue
        best: dict[str, list] = {}
        for x, y in near_pairs(m, back, list(n)):
            for w, v in ((x, y), (y, x)):
                b = best.setdefault(w, [0, 0, ""])
                b[0] += 1
                if n[v] > b[1] or (n[v] == b[1] and v < b[2]):
                    b[1], b[2] = n[v], v
        out += [(w, *b) for w, b in best.items()]
        if len(out) >= 20000:
            yield frame(out)
            out = []
    yield frame(out)


def near_words(words: DataFrame, letters: int = 5) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near words: how many, and the most
    frequent of them, the first in code-point order among equals."""
    placed = initial_states(words, letters).repartition(shuffle_partitions(words), "m", "back", "half")
    found = placed.sortWithinPartitions("m", "back", "half").mapInPandas(
        _compose, "word string, n_near long, form_n long, form string")
    least = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("form_n"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from (word, form), each word once, to the last form; pointers are doubled until
    none moves. A form has twice its word's occurrences at least, so chains are short."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(now.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 5, uses: int = 3,
                      times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the corpus.

    A word is near another if one code point inserted, deleted or replaced makes it the other.
    Its form is the near word of most occurrences if these are ``times`` its own at least, else
    null. Null and empty texts have no words; a null id counts as an empty one; repeated rows
    count as often as they stand; ties go to the first word in code-point order; other columns
    play no part; without words the result is empty. Texts of any length are read in pieces.
    """
    words = saved(word_counts(docs, id_col, text_col, letters, uses), "words")
    near = saved(words.join(near_words(words, letters), "word", "left"), "near-words")
    chosen = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[
        F.when(F.col("form_n") >= times * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")])
    last = roots(chosen.where("form is not null"))
    return chosen.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
