"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from docloom.llm import variants as V

SCHEMA = "doc_id long, text string, word int, n string"


def counted(rows, letters=5, uses=3):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= letters and n >= uses}


def neighbours(words):
    """By deleted code points: replaced ones leave the same rest at the same place."""
    near, rest = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            short = w[:k] + w[k + 1:]
            rest[short, k].append(w)
            if short in words and short != w:
                near[w].add(short)
                near[short].add(w)
    for ws in rest.values():
        for w in ws:
            near[w].update(v for v in ws if v != w)
    return near


def brute(rows):
    n = counted(rows)
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v)) if near[w] else None
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]


def same(got, rows):
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_odd_texts(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(400)] + ["Word", "aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÎÕÜ", "àéîõü"]
    texts = [r.choice([" ", "\n", ", 1"]).join(r.choices(words, k=r.randrange(1, 300))) for _ in range(60)]
    texts += [None, "", "...", ("ab" * 1000 + "c ") * 3 + ("ab" * 1000 + "d ") * 7, "ABCDE abcde AbCdE é×÷ÿ " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6]), (None, texts[7]), (None, texts[7])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    same(V.spelling_variants(df.repartition(5)).collect(), rows)
    assert V.spelling_variants(df.where("false")).collect() == []


def test_very_long_words(spark):
    rows = [(i, "x " + "q" * 150000 + " abcde" * 30000) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in V.word_counts(df).collect()} == counted(rows)


def test_given_documents(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(V.op13_spelling_variants(spark, sf_dir).collect(), rows)


def test_chains_end_at_the_last_form(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(60)] + [("x", "y")]
    got = {r.word: r.root for r in V.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{k}": "w60" for k in range(60)} | {"x": "y"}


@pytest.mark.parametrize("seed", range(30))
def test_acceptors(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(0, 6))) for _ in range(60)})
    a = V.Acceptors()
    start = a.add(words)

    def read(q, at=0, seen=""):
        if a.final[q]:
            yield seen, at
        for c, (to, before) in a.arcs[q].items():
            yield from read(to, at + before, seen + c)

    assert list(read(start)) == [(w, k) for k, w in enumerate(words)]
    assert len({(f, *arcs.items()) for f, arcs in zip(a.final, a.arcs)}) == len(a.arcs)  # no two states alike
    near = neighbours(words)
    got = {frozenset((words[i], words[j])) for i, j in a.replaced(start)} | {frozenset((words[i], words[j])) for i, j in a.inserted(start, start)}
    assert got == {frozenset((w, v)) for w in near for v in near[w]}


def test_each_pair_comes_once():
    r = random.Random(3)
    words = list({"".join(r.choice("ab") for _ in range(r.randrange(5, 9))) for _ in range(200)})
    pairs, places = Counter(), defaultdict(set)
    for w in words:
        for m in (len(w), len(w) - 1):
            if m >= 5:
                places[m, False, w[:m // 2]].add(w)
                places[m, True, w[len(w) - (m - m // 2):]].add(w)
    for (m, back, _), ws in places.items():
        pairs.update(frozenset(p) for p in V.near_pairs(m, back, sorted(ws)))
    near = neighbours(words)
    assert set(pairs) == {frozenset((w, v)) for w in near for v in near[w]} and set(pairs.values()) == {1}
