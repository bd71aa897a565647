"""Secrets in texts: a trigram index of the corpus tells which texts a rule can match at all.

Built-in functions only: cutting, indexing, looking up and checking run inside the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import saved, table

#: texts are cut into pieces of so many characters before their trigrams are listed
PIECE = 1 << 16
#: a part of a pattern that can be more strings than this is not spelled out
SPELLED = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds; a match whose group ``measured`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# --- fixed values: what the base rules find ------------------------------------
_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    # a run ends where its characters end, so its least length may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# further kinds, as their issuers publish the forms
RULES = BASE + (
    Rule("github", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
)


# --- which trigrams a pattern cannot do without -----------------------------------
# A query is True (nothing is mandatory), a trigram, or ("and" | "or", query, ...).

def _combined(how: str, parts: list):
    # "and" forgets True, "or" becomes True by it
    if how == "or" and True in parts:
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (how, *parts)


def _one_of(strings: frozenset[str]):
    """What a text that holds one of the strings must hold."""
    least = [s for s in sorted(strings) if not any(o != s and o in s for o in strings)]
    return _combined("or", [_combined("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in least])


def _sequence(items) -> tuple[frozenset[str] | None, object]:
    """(every string it can be, or None if they are too many; the query)."""
    run, parts, spelled = frozenset([""]), [], True
    for op, arg in items:
        strings, query = _item(op, arg)
        if strings is not None and len(run) * len(strings) <= SPELLED:
            run = frozenset(a + b for a in run for b in strings)
            continue
        parts += [_one_of(run), query]
        run, spelled = strings if strings is not None else frozenset([""]), False
    query = _combined("and", [*parts, _one_of(run)])
    return (run if spelled else None), query


def _item(op, arg) -> tuple[frozenset[str] | None, object]:
    anything = (None, True)
    if op is _c.LITERAL:
        return (frozenset([chr(arg).lower()]), True) if arg < 128 else anything
    if op is _c.IN:
        if not all(o is _c.LITERAL and a < 128 for o, a in arg):
            return anything
        return frozenset(chr(a).lower() for _, a in arg), True
    if op is _c.AT:
        return frozenset([""]), True
    if op is _c.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _c.BRANCH:
        found = [_sequence(branch) for branch in arg[1]]
        if all(s is not None for s, _ in found):
            strings = frozenset().union(*[s for s, _ in found])
            if len(strings) <= SPELLED:
                return strings, _one_of(strings)
        return None, _combined("or", [q for _, q in found])
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if low == 0:
            return (strings | {""}, True) if high == 1 and strings is not None else anything
        if low == high and strings is not None and len(strings) ** low <= SPELLED:
            return _sequence(list(inner) * low)
        return None, query
    return anything


def trigram_query(pattern: str):
    """The Boolean query of lower-case trigrams that every text with a match satisfies."""
    return _sequence(_parser.parse(pattern))[1]


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1:]))


def _holds(query, grams: str) -> Column:
    if isinstance(query, str):
        return F.array_contains(grams, trigram_number(query))
    out = None
    for part in query[1:]:
        c = _holds(part, grams)
        out = c if out is None else (out & c if query[0] == "and" else out | c)
    return out


# --- the index ----------------------------------------------------------------

def row_key(id_col: str, text_col: str) -> Column:
    """Names a row in the index. Rows that share it are only ever looked at in vain."""
    return F.xxhash64(id_col, text_col)


def trigram_number(gram: str) -> int:
    """A trigram's code points, 21 bits each: numbers sort faster than strings."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _number(gram: str) -> Column:
    a, b, c = (F.ascii(F.substring(gram, k, 1)).cast("long") for k in (1, 2, 3))
    return F.shiftleft(a, 42) + F.shiftleft(b, 21) + c


def trigram_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (gram, doc): the number of every lower-case trigram of every text with the row's key.

    Each task writes the postings of its own rows, sorted by trigram: no shuffle, no list
    grows with the corpus, and a lookup reads the row groups of its trigrams alone. Long texts
    are listed piece by piece, pieces overlapping by two characters.
    """
    text = F.col(text_col)
    pieces = F.when(F.char_length(text) <= PIECE, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1)))
    cut = docs.where(F.char_length(text) >= 3).select(row_key(id_col, text_col).alias("doc"), F.explode(pieces).alias("piece"))
    grams = F.array_distinct(F.regexp_extract_all(F.lower("piece"), F.lit("(?s)(?=(...))"), F.lit(1)))
    postings = cut.select(F.explode(grams).alias("g"), "doc").select(_number("g").alias("gram"), "doc")
    return saved(postings.sortWithinPartitions("gram"), "trigrams")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, rules): the kinds whose query the postings of a row satisfy, where there are any."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = sorted(map(trigram_number, set().union(*map(_trigrams, queries.values()))))
    met = index.where(F.col("gram").isin(wanted)).groupBy("doc").agg(F.collect_set("gram").alias("grams"))
    kinds = F.filter(F.array(*[F.when(_holds(q, "grams"), k) for k, q in queries.items() if q is not True],
                             F.lit(None).cast("string")), lambda k: k.isNotNull())
    return met.select("doc", kinds.alias("rules")).where(F.size("rules") > 0)


# --- checking -------------------------------------------------------------------

def running_totals(numbers: Column) -> Column:
    """Inclusive running totals of an array, by doubling: no array is built element by element."""
    def doubled(a: Column, step: Column) -> Column:
        return F.when(F.size(a) > step, F.transform(
            a, lambda x, i: x + F.when(i >= step, F.get(a, i - step)).otherwise(0))).otherwise(a)

    # a text of 2 GiB holds fewer matches than 2**28
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(28)]), numbers, doubled)


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")


def rule_spans(text: str, rule: Rule, rank: int) -> Column:
    """The rule's matches as an array of (start, rank, kind, stop), in code points."""
    def long_enough(z: Column) -> Column:
        what = F.regexp_extract(z["m"], rule.pattern, rule.measured) if rule.measured else z["m"]
        return F.char_length(what) >= rule.least

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
        ends = running_totals(F.zip_with(found, gaps, lambda m, gap: F.char_length(m) + F.char_length(gap)))
        return F.transform(F.filter(F.arrays_zip(found.alias("m"), ends.alias("stop")), long_enough), lambda z: F.struct(
            (z["stop"] - F.char_length(z["m"])).alias("start"), F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"), z["stop"].alias("stop")))

    found = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0))
    # most texts hold no match: one look tells
    return F.when(F.col(text).rlike(rule.pattern), F.transform(F.array(found), placed)[0]).otherwise(_no_spans())


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row for each document: (id, spans), an array of (start, rank, kind, stop) by start, then
    by the order of the rules; code points, ``stop`` exclusive.

    Matches of a rule are leftmost, greedy and never overlap; those of different rules may. A
    rule with mandatory trigrams looks at the rows that the index names; a rule without any
    looks at all texts. A null text is empty. Null ids, repeated ids and repeated rows each
    keep their row; other columns play no part; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    free = [r for r in rules if trigram_query(r.pattern) is True]
    # stored first: what is small is then known to be small, and is joined without moving texts
    named = saved(candidates(trigram_index(rows, "id", "text"), rules), "secret-candidates")
    looked = rows.withColumn("doc", row_key("id", "text")).join(named, "doc", "left")
    spans = [rule_spans("text", r, k) if r in free else
             F.when(F.array_contains("rules", r.kind), rule_spans("text", r, k)).otherwise(_no_spans())
             for k, r in enumerate(rules)]
    return looked.select(F.col("id").alias(id_col), F.array_sort(F.flatten(F.array(*spans))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [_count(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for rank, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(f"""
SELECT rn, {rank} AS rank, '{r.kind}' AS kind, stop - length(m) AS start, stop FROM (
  SELECT rn, m, sum(length(gap) + length(m)) OVER (PARTITION BY rn ORDER BY k) AS stop FROM (
    SELECT rn, unnest(found) AS m, unnest(gaps[:len(found)]) AS gap, unnest(range(len(found))) AS k FROM (
      SELECT rn, regexp_extract_all(text, {p}) AS found, string_split_regex(text, {p}) AS gaps FROM d)))
WHERE length({f"regexp_extract(m, {p}, {r.measured})" if r.measured else "m"}) >= {r.least}""")
    counted = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    listed = "coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counted}, sha256({listed.format(f" FILTER (rank < {len(BASE)})")}) AS base_sha256,
  {listed.format(" FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN s USING (rn) GROUP BY rn, doc_id"""


QUERIES = {"op11_secret_scan": op11_secret_scan}
ORACLES = {"op11_secret_scan": _oracle()}
