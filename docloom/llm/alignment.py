"""Two tokenizers over the same texts: which tokens cover the same bytes, and which ids go together."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.llm.common import saved, shuffle_partitions, table

#: texts are handed to the tokenizers in parts of about so many characters
PART = 1 << 12
#: at most so many units are kept by a worker
KEPT_UNITS = 1 << 18
#: documents are worked on together up to so many characters
SLICE = 1 << 19

_UNIT = re.compile(r"[ \n][^ \n]*")
_ODD = re.compile(r"\s\s|[^\S \n]|\s$")

BLOCK_SCHEMA = (
    "block long, docs array<struct<id:{id},n_a:long,n_b:long,n_groups:long,groups_sha256:string,n_codes:int>>, "
    "codes array<long>, counts array<long>, at array<int>, times array<int>")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself, the others as 256, 257, …"""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """Side A: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        chars = _byte_of_char()
        self.bytes = [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            self.bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(parts, add_special_tokens=False)]


class PieceTokenizer:
    """Side B: a sentencepiece model. It puts a leading space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.model.id_to_piece(list(range(size))))]
        # no piece goes on over a space or holds a line feed, so a text may be cut in front of one
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in self.model.id_to_piece(list(range(size))))

    def encode(self, parts: list[str]) -> list[list[int]]:
        found = self.model.encode([p[p[:1] == " ":] for p in parts], num_threads=1)
        return [ids if p[:1] == " " else ids[1:] for p, ids in zip(parts, found)]


def cut_text(spaced: str, size: int = PART) -> list[str]:
    """Parts of about ``size`` characters, each but the first beginning at a single space between
    two characters that are not white space. Both tokenizers begin a token there, so the parts'
    ids in a row are the text's. A text without such a place stays whole."""
    parts, at = [], 0
    while len(spaced) - at > size:
        p = spaced.find(" ", at + size)
        while p != -1 and (spaced[p - 1].isspace() or spaced[p + 1:p + 2].isspace() or p + 1 == len(spaced)):
            p = spaced.find(" ", p + 1)
        if p == -1:
            break
        parts.append(spaced[at:p])
        at = p
    return [*parts, spaced[at:]]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The last token of each token's group; tokens of A are numbered first, then those of B.

    Every token points to the farthest-right token that overlaps it: the one of the other side
    that covers its last byte. Where both end there, B's token points to A's, and A's to
    itself. Pointers are doubled until none moves.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a, "left")
    over_b = np.searchsorted(ends_a, ends_b, "left")
    to = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


class _Tables:
    """What the alignment looks up by id: token lengths, and ids as text with what follows them."""

    def __init__(self, tokens: list[bytes], inner: str, last: str) -> None:
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.texts = np.array([f"{i}{inner}" for i in range(len(tokens))] + [f"{i}{last}" for i in range(len(tokens))], object)
        self.size = len(tokens)


#: a unit's tokens, and how its groups are written; None where a tokenizer does not give it back
Unit = tuple[int, int, int, str, bytes] | None


def cut_units(part: str) -> list[str]:
    """A part's words, each with the space or line feed in front of it. Where other white space
    or several in a row stand, a tokenizer may look over a cut, and the part stays whole."""
    return [part] if _ODD.search(part) else _UNIT.findall(part)


class Aligner:
    """Aligns units, many at a time, and keeps what it knows of up to ``KEPT_UNITS`` of them."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.ta, self.tb = _Tables(self.a.bytes, ",", "|"), _Tables(self.b.bytes, ",", ";")
        self.known: dict[str, Unit] = {}

    def _units(self, spaced: str) -> list[str]:
        return [u for p in cut_text(spaced) for u in cut_units(p)] if self.b.cuts else [spaced]

    def _learn(self, units: list[str]) -> Iterator[Unit]:
        """Units in a row are a text whose tokens end where the units end."""
        at = 0
        while at < len(units):
            end, size = at + 1, len(units[at])
            while end < len(units) and size < PART:
                size += len(units[end])
                end += 1
            yield from self._aligned(units[at:end])
            at = end

    def _aligned(self, units: list[str]) -> Iterator[Unit]:
        text = "".join(units)
        ids_a, ids_b = self.a.encode([text])[0], self.b.encode([text])[0]
        raw = text.encode()
        if not raw == b"".join(map(self.a.bytes.__getitem__, ids_a)) == b"".join(map(self.b.bytes.__getitem__, ids_b)):
            if len(units) == 1:
                yield None
            else:  # look for the unit that does not come back
                half = len(units) // 2
                yield from self._aligned(units[:half])
                yield from self._aligned(units[half:])
            return
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.ta.lengths[a]), np.cumsum(self.tb.lengths[b])
        group = terminals(ends_a, ends_b)
        n = len(a)
        last_a = group[:n] == np.arange(n)
        last_b = ends_a[group[n:]] == ends_b
        codes = (a[last_a] << 32 | b[last_b]).tobytes()
        number_a, number_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(number_a), np.bincount(number_b)
        written = np.empty(n + len(b), object)
        written[np.arange(n) + (np.cumsum(size_b) - size_b)[number_a]] = self.ta.texts[a + self.ta.size * last_a]
        written[np.arange(len(b)) + np.cumsum(size_a)[number_b]] = self.tb.texts[b + self.tb.size * last_b]
        pieces = written.tolist()
        stops = np.cumsum([len(u.encode()) for u in units])
        until_a = np.searchsorted(ends_a, stops, "right").tolist()
        until_b = np.searchsorted(ends_b, stops, "right").tolist()
        groups = np.searchsorted(ends_a[last_a], stops, "right").tolist()
        pa_, pb, pg = 0, 0, 0
        for qa, qb, qg in zip(until_a, until_b, groups):
            yield qa - pa_, qb - pb, qg - pg, "".join(pieces[pa_ + pb:qa + qb])[:-1], codes[8 * pg:8 * qg]
            pa_, pb, pg = qa, qb, qg

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """For each text (n_a, n_b, n_groups, groups_sha256, codes of its links in order). A code is
        A's id in the upper 32 bits and B's in the lower."""
        if len(self.known) > KEPT_UNITS:
            self.known = {}
        cut = [self._units(" " + t) if t else [] for t in texts]
        new = list(dict.fromkeys(u for us in cut for u in us if u not in self.known))
        short = [u for u in new if not _ODD.search(u)] if self.b.cuts else []
        self.known.update(zip(short, self._learn(short)))
        odd = {u: next(self._aligned([u])) for u in new if u not in self.known}
        out = []
        for units in cut:
            found = [odd[u] if u in odd else self.known[u] for u in units] if odd else list(map(self.known.__getitem__, units))
            if not found or None in found:
                out.append((0, 0, 0, "", np.empty(0, np.int64)))
                continue
            n_a, n_b, n_groups, written, codes = zip(*found)
            out.append((sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(";".join(written).encode()).hexdigest(),
                        np.frombuffer(b"".join(codes), np.int64)))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """This Python worker's aligner: later tasks find the vocabularies read."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1)):
            ids.append(i.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or "")
            if size >= SLICE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents: what is known of each alone, the block's distinct
    id pairs with their links, and for each document which of these it has, how often."""
    schema = BLOCK_SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for ids, texts in _slices(batches):
            found = aligner.align(texts)
            codes, inverse, counts = np.unique(np.concatenate([f[4] for f in found]), return_inverse=True, return_counts=True)
            rows, at, times, k = [], [], [], 0
            for i, f in zip(ids, found):
                own, n = np.unique(inverse[k:k + len(f[4])], return_counts=True)
                k += len(f[4])
                at.append(own)
                times.append(n)
                rows.append({"id": i, "n_a": f[0], "n_b": f[1], "n_groups": f[2], "groups_sha256": f[3], "n_codes": len(own)})
            lists = [[rows], [codes], [counts], [np.concatenate(at)], [np.concatenate(times)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *(pa.array(x, f.type) for x, f in zip(lists, list(arrow)[1:]))], schema=arrow)
            block += 1

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, n, best): every id pair's links in the corpus, and whether no pair of its B id has more."""
    links = blocks.select(F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("x.codes", "x.counts")
    pairs = saved(links.groupBy(F.col("codes").alias("code")).agg(F.sum("counts").alias("n")), "id-pairs")
    pairs = pairs.withColumn("b", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pos = right.column("pos").to_numpy()
        n, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool)
        n[pos] = right.column("n").to_numpy()
        best[pos] = right.column("best").to_numpy(zero_copy_only=False)
        docs = left.column("docs")[0].as_py()
        at, times = (left.column(c)[0].values.to_numpy() for c in ("at", "times"))
        ends = np.cumsum([d["n_codes"] for d in docs])
        total = np.r_[0, np.cumsum(times * n[at])] if len(at) else np.zeros(1, np.int64)
        top = np.r_[0, np.cumsum(times * best[at])] if len(at) else np.zeros(1, np.int64)
        begins = np.r_[0, ends[:-1]].astype(np.int64)
        rows = [[d["id"] for d in docs], [d["n_a"] for d in docs], [d["n_b"] for d in docs], [d["n_groups"] for d in docs],
                [d["n_groups"] for d in docs], (top[ends] - top[begins]).tolist(), (total[ends] - total[begins]).tolist(),
                [d["groups_sha256"] for d in docs]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    The texts are encoded with a leading space by both tokenizers. Byte offsets at which tokens
    of both end cut them into groups; the pair of tokens that end there is a link, so a group
    has one. Texts that are null, empty, or that a tokenizer does not give back byte for byte
    have no tokens: zeros, and '' for the digest. Null, repeated ids and repeated rows each keep
    their row (repeated rows count as often as they stand); other columns play no part; an empty
    table gives an empty one.

    A block's id pairs are looked up once, so a pair that is in every document meets the join
    once a block, and adaptive splitting spreads it. Texts are not moved; they are cut into
    parts of ``PART`` characters at single spaces, so a long one needs no long call.
    """
    blocks = saved(aligned_blocks(docs, path_a, path_b, id_col, text_col), "aligned", "zstd")
    pairs = pair_counts(blocks)
    wanted = blocks.select("block", F.posexplode("codes").alias("pos", "code"))
    looked = wanted.join(pairs, "code").select(F.col("block").alias("in_block"), "pos", "n", "best")
    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *(
        f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256 string"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n = shuffle_partitions(docs)
    left = blocks.select("block", "docs", "at", "times").repartition(n, "block")
    return left.groupBy("block").cogroup(looked.repartition(n, "in_block").groupBy("in_block")).applyInArrow(_scored(arrow), schema)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
