"""Tokenizer alignment against a plain version that walks the bytes of one text."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import alignment as L

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block int, code string"


def byte_level():
    plain = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    chars, k = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            chars[chr(256 + k)] = b
            k += 1
    return chars


def brute(rows):
    ta, tb, chars = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    ta.encode_special_tokens = True
    out, links = [], []
    for i, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        ba = [bytes(chars[c] for c in ta.id_to_token(x)) for x in a]
        bb = []
        for x in b:
            p = tb.id_to_piece(x)
            bb.append(bytes([int(p[3:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
        if not text or not (b"".join(ba) == b"".join(bb) == (" " + text).encode()):
            out.append((i, 0, 0, []))
            links.append([])
            continue
        groups, ka, kb, na, nb, ga, gb = [], 0, 0, 0, 0, [], []
        while ka < len(a) or kb < len(b):
            if na <= nb:
                na += len(ba[ka])
                ga.append(a[ka])
                ka += 1
            else:
                nb += len(bb[kb])
                gb.append(b[kb])
                kb += 1
            if na == nb:
                groups.append((ga, gb))
                ga, gb = [], []
        out.append((i, len(a), len(b), groups))
        links.append([(g[0][-1], g[1][-1]) for g in groups])
    count = Counter(x for ls in links for x in ls)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for (i, na, nb, groups), ls in zip(out, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (i, na, nb, len(groups), len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


def same(got, rows):
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_odd_texts(spark, monkeypatch):
    r = random.Random(2)
    bits = ["the", "word", " ", "  ", "\n", "\t", "é", "😀", "日本", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "12", "!?", " ", "x́", "tion"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(300)]
    texts += [None, "", " ", "▁", "a ▁ b", " lead", "trail ", "word " * 60000, "x" * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[8]), (None, texts[9]), (None, texts[9])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    same(L.align_tokenizers(df.repartition(6), A, B).collect(), rows)
    same(L.align_tokenizers(df.where("text is null or text = ''"), A, B).collect(), [x for x in rows if not x[1]])
    assert L.align_tokenizers(df.where("false"), A, B).collect() == []


def test_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(L.op12_tokenizer_alignment(spark, sf_dir).collect(), rows)


def test_parts_have_the_ids_of_the_whole():
    r, a, b = random.Random(5), L.ByteTokenizer(A), L.PieceTokenizer(B)
    assert b.cuts
    bits = ["the", "a", " ", " ", "  ", "\n", " \n", "é", "'s", ".", "1", "日", " ", "<s>"]
    for _ in range(300):
        spaced = " " + "".join(r.choice(bits) for _ in range(200))
        parts = L.cut_text(spaced, 20)
        assert "".join(parts) == spaced
        units = [u for p in parts for u in L.cut_units(p)]
        assert "".join(units) == spaced
        for side in (a, b):
            assert sum(side.encode(parts), []) == side.encode([spaced])[0]
            assert sum(side.encode(units), []) == side.encode([spaced])[0]


@pytest.mark.parametrize("seed", range(20))
def test_terminals(seed):
    r = random.Random(seed)
    ends = [np.array(sorted({*r.sample(range(1, 200), r.randrange(0, 150)), 200})) for _ in "ab"]
    both = sorted(set(ends[0]) & set(ends[1]))
    got = L.terminals(*ends)
    for e, g in zip(np.concatenate(ends), got):
        assert ends[0][g] == next(x for x in both if x >= e)
