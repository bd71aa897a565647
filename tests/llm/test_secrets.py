"""The secret scan against plain regular expressions."""

import hashlib
import random
import re

import pytest

from docloom.llm import secrets as S

SCHEMA = "doc_id long, text string, rules int, doc string"


def brute(text, rules=S.RULES):
    out = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m.group(r.measured)) >= r.least:
                out.append((m.start(), rank, r.kind, m.end()))
    return sorted(out)


PARTS = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "apikey", "=", ":", " ", "  ", "\n", '"', "'", "é", "😀", "ſecret",
         "abcdefghijkl", "ABC/+=_.-0123456", "short", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "ghp_", "a" * 36, "xoxb-",
         "eyJ", ".", "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "the", "ﬁ", "K", "$1", "\\"]


def rows():
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    texts += [None, "", "a", "ab", "token=secret: abcdefghijklmnop", "password = = abcdefghijklm", "x" * 200000 + "token: abcdefghijklmnopq",
              "😀" * 70000 + "AKIA" + "Z" * 20, "t" * 65535 + "oken:abcdefghijklm", "secret=" * 3 + "0123456789abcdef " * 3000]
    return [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x"), (3, texts[4], 1, "x"), (None, texts[5], 1, None), (None, texts[5], 2, None)]


def test_spans_and_index(spark):
    given = rows()
    got = S.find_secrets(spark.createDataFrame(given, SCHEMA).repartition(5)).collect()
    want = sorted(((i, brute(t)) for i, t, *_ in given), key=repr)
    assert sorted(((g.doc_id, [tuple(s) for s in g.spans]) for g in got), key=repr) == want
    assert sum(len(s) for _, s in want) > 500


def test_rows_without_the_trigrams_are_not_named(spark):
    df = spark.createDataFrame([(1, "a password here"), (2, "passwor d"), (3, "API KEY"), (4, "Api_Key"), (5, "nothing")], "doc_id long, text string")
    named = S.candidates(S.trigram_index(df)).join(df.withColumn("doc", S.row_key("doc_id", "text")), "doc")
    assert sorted((r.doc_id, list(r.rules)) for r in named.select("doc_id", "rules").collect()) == [(1, ["assign"]), (4, ["assign"])]


def test_postings_are_the_distinct_trigrams_of_whole_texts(spark):
    texts = ["abc", "ABcab", "ab", None, "é😀x", "".join(random.Random(1).choice("abcd") for _ in range(150000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    index = S.trigram_index(df).distinct().join(df.withColumn("doc", S.row_key("doc_id", "text")), "doc")
    got = sorted((r.doc_id, r.gram) for r in index.select("doc_id", "gram").collect())
    assert got == sorted({(i, S.trigram_number(t.lower()[k:k + 3])) for i, t in enumerate(texts) if t for k in range(len(t) - 2)})


def test_empty_table(spark):
    assert S.find_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("pattern, query", [
    ("abcd", ("and", "abc", "bcd")), ("ABC", "abc"), ("ab", True), ("[0-9]+", True), ("abc|def", ("or", "abc", "def")),
    ("abc|d", True), ("(abc)?", True), ("(abc)+x", "abc"), ("a[bB]c", "abc"), ("abc.def", ("and", "abc", "def")),
    ("x*abcd?", "abc"), ("(ab){2}", ("and", "aba", "bab")), ("^abc$", "abc"), ("a[^b]c", True),
])
def test_queries_of_patterns(pattern, query):
    assert S.trigram_query(pattern) == query


def test_a_match_satisfies_its_query():
    def holds(q, text):
        return q is True or (q in text if isinstance(q, str) else (all if q[0] == "and" else any)(holds(p, text) for p in q[1:]))

    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choice(PARTS) for _ in range(12))
        for rule in S.RULES:
            if re.search(rule.pattern, text):
                assert holds(S.trigram_query(rule.pattern), text.lower())


def test_running_totals(spark):
    numbers = [list(range(n)) for n in (0, 1, 2, 3, 17, 1000)]
    df = spark.createDataFrame([(x,) for x in numbers], "x array<int>")
    got = [r[0] for r in df.select(S.running_totals(df["x"])).collect()]
    assert got == [[sum(x[:k + 1]) for k in range(len(x))] for x in numbers]


def test_digest_of_the_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in S.op11_secret_scan(spark, sf_dir).collect():
        found = brute(docs[r.doc_id])
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        base = ",".join(f"{k}:{a}:{b}" for a, rank, k, b in found if rank < 3)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_no_python_on_the_main_path(spark, sf_dir):
    text = S.op11_secret_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))
