"""Near copies of vectors and documents against plain Python."""

import random

import numpy as np
import pytest

from docloom.llm.embed_dup import embedding_near_dup
from docloom.llm.graph import components
from docloom.llm.minhash import circulant, drop_near_copies, minhash_classes, op4_minhash_near_dup, shingles
from tests.llm.brute import find, join, near_copies


def vector_answer(rows, least):
    good = [(k, i, np.asarray(v, float)) for k, (i, v) in enumerate(rows)
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in rows if i is not None}
    links = [0] * len(rows)
    for x, (k, a, v) in enumerate(good):
        for m, b, w in good[x + 1:]:
            if len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                links[k] += 1
                links[m] += 1
                join(parent, a, b)
    return sorted((i, n, None if i is None else find(parent, i)) for (i, _), n in zip(rows, links) if i is not None)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for size in (1, 2, 90, 300, 5):  # groups of near copies, larger than a block
        centre = rng.standard_normal(12)
        for _ in range(size):
            rows.append((at, (centre + rng.standard_normal(12) * rng.choice([0.02, 0.08])).tolist()))
            at += 1
    rows += [(at + k, rows[7][1]) for k in range(40)]  # exact copies
    at += 40
    rows += [(at, None), (at + 1, []), (at + 2, [0.0] * 12), (at + 3, [float("nan")] * 12), (at + 4, [None] * 12),
             (at + 5, [float("inf")] + [0.0] * 11), (at + 6, [1.0, 2.0]), (at + 7, [1.0, 2.0]), (at + 8, [1e-30] * 12),
             (at + 9, [2e-30] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, bucket string")
    got = embedding_near_dup(df, block=64).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == vector_answer(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_empty_null_and_repeated(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_near_dup(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = sorted(map(tuple, embedding_near_dup(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert [(1, 2, 1, True)] * 2 == [g for g in got if g[0] == 1]  # the row without an id is a link too
    assert (2, 0, 2, True) in got


def test_vectors_with_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (None, [1.0, 0.01, 0.0]), (5, [1.0, 0.02, 0.0]),
            (3, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (2, [0.0, 1.0, 0.01]), (4, [0.0, 0.01, 1.0]),  # 3 stands for two vectors
            (None, [-1.0, 0.0, 0.0]), (None, [-1.0, 0.01, 0.0]), (None, None), (None, [0.0, -1.0, 0.0])]
    got = embedding_near_dup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 3, 1, True), (None, 3, 1, False), (None, 3, 1, False), (5, 3, 1, False),
            (3, 1, 2, False), (3, 1, 3, True), (2, 1, 2, True), (4, 1, 3, False),
            (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_recall_at_the_limit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):  # pairs at a cosine of 0.951
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.951 * a + (1 - 0.951**2) ** 0.5 * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert embedding_near_dup(df).where("n_links = 1").count() >= 2 * 0.97 * 400


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        join(parent, a, b)
    want = {x: find(parent, x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = components(df).collect()
    assert {g.node: g.component for g in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def text(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def test_documents(spark):
    r = random.Random(3)
    docs, at = [], 0
    for size in (3, 60, 8):  # chains and stars of near copies
        base = text(r, 120).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 6])):
                copy[r.randrange(len(copy))] = "changed%d" % r.randrange(10**6)
            docs.append((at, " ".join(copy)))
            at += 1
    docs += [(at + k, docs[5][1].upper() + " \t\n") for k in range(30)]
    at += 30
    docs += [(at, None), (at + 1, ""), (at + 2, " \n\t"), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two"),
             (at + 6, "Été été"), (at + 7, "été été"), (at + 8, text(r, 30000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, band int")
    for words, percent in ((3, 85), (5, 80)):
        want = near_copies(docs, words, percent)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_classes(df, words=words, percent=percent).collect()}
        assert got == want
    assert minhash_classes(df.where("false")).collect() == []
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, (_, c) in near_copies(docs, 5, 80).items() if i == c)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, minhash_classes(df, words=3, percent=85).collect()), key=repr)
    assert got[:2] == [(4, 2, 4, True)] * 2 and got[2] == (9, 2, 4, False) and got[3][0] is None
    assert sorted((r.doc_id is None, r.doc_id) for r in drop_near_copies(df).collect()) == [(False, 4), (False, 4), (True, None)]


def test_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in op4_minhash_near_dup(spark, sf_dir).collect()}
    assert got == near_copies(docs, 3, 85)


def test_signatures_estimate_similarity():
    r = random.Random(9)
    a = shingles(text(r, 2000, 10**6), 3)
    b = np.unique(np.concatenate([a[:1500], shingles(text(r, 502, 10**6), 3)]))
    s = circulant([a, b], 2048)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.05
