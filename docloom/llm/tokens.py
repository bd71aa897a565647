"""Token ids in wavelet matrices: one compressed file a shard, with access, count and lookup."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import table
from docloom.session import work_dir

MAGIC, END_ID, SHARD_TOKENS = b"WAVELET1", 0, 1 << 21
#: what a worker keeps between tasks, and works on at once: an executor holds several workers for as long as it lives
CACHED_WORDS, CACHED_BYTES, SLICE_BYTES = 1 << 18, 1 << 24, 1 << 21
BLOCK_BITS = 1 << 16

#: a text with white space other than single spaces and line feeds between characters is not cut
_UNCUT = r"\A | \z|  |\n | \n|[\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: a stop behind a letter; other letters than these only cost time
_STOPPED = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}][.,]\z"


class WordEncoder:
    """Ids of whole texts, each word given to the tokenizer once.

    The vocabulary's pattern always begins a new piece at a single space between two
    characters that are not white space, and at the first of the line feeds between two such
    characters; merges never cross pieces. So a text may be cut there, and equal words (with
    their space or line feeds) have equal ids wherever they stand. Arrow tells the words of
    many texts apart. New ones go to the tokenizer many at a time, as they stand in a text,
    and are parted by the ids that begin with a space, of which each word has one. Texts with
    other white space go to it whole. Up to ``CACHED_WORDS`` words are kept that take up to
    ``CACHED_BYTES`` with their ids, else those of the last call, or none if these take more.
    """

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True  # a space in byte-level BPE
        self.nothing = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.words, self.ids = self.nothing
        self.stops = pa.array(["", ".", ","], pa.large_string())
        self.stop_ids = pa.array(self._encode(self.stops.to_pylist()), pa.large_binary())

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Each text by itself; few at a time, as the tokenizer's own results are large."""
        batches = (self.tokenizer.encode_batch_fast(texts[i:i + 32], add_special_tokens=False) for i in range(0, len(texts), 32))
        return [np.array(e.ids, self.dtype).tobytes() for batch in batches for e in batch]

    def _spaced_ids(self, words: pa.Array) -> pa.Array:
        """The ids of words with a space before each."""
        ends = np.append(np.arange(0, len(words), 256), len(words))
        groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), words), pa.scalar(" ", pa.large_string()))
        raw, sizes = [], [np.zeros(1, np.int64)]
        for i in range(0, len(groups), 32):
            joined = [" " + g for g in groups[i:i + 32].to_pylist()]
            for k, found in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), i):
                ids = np.array(found.ids, self.dtype)
                at = np.flatnonzero(self.spaced[ids])
                if len(at) == ends[k + 1] - ends[k] and at[0] == 0:
                    raw.append(ids.tobytes())
                    sizes.append(np.diff(at, append=len(ids)) * ids.itemsize)
                else:
                    alone = self._encode([" " + w for w in words[ends[k]:ends[k + 1]].to_pylist()])
                    raw += alone
                    sizes.append(np.array([len(x) for x in alone], np.int64))
        offsets = np.cumsum(np.concatenate(sizes))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(raw))])

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """The pattern parts a letter from a stop as well: of a word with a stop, the word alone is learned."""
        stopped = pc.match_substring_regex(words, _STOPPED)
        stops = pc.if_else(stopped, pc.utf8_slice_codeunits(words, -1), "")
        cores = pc.if_else(stopped, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        places = pc.index_in(cores.dictionary, value_set=self.words)
        new, feed = (x.to_numpy(zero_copy_only=False) for x in (places.is_null(), pc.starts_with(cores.dictionary, "\n")))
        order = [np.flatnonzero(new & ~feed), np.flatnonzero(new & feed)]
        plain, begun = (cores.dictionary.take(pa.array(x)) for x in order)
        learned = [self._spaced_ids(plain), pa.array(self._encode(begun.to_pylist()), pa.large_binary())]
        at = places.fill_null(0).to_numpy().copy()
        at[np.concatenate(order)] = len(self.ids) + np.arange(len(plain) + len(begun))
        known = pa.concat_arrays([self.ids, *learned])
        ids = known.take(pa.array(at))
        for self.words, self.ids in ((pa.concat_arrays([self.words, plain, begun]), known), (cores.dictionary, ids), self.nothing):
            if len(self.words) <= CACHED_WORDS and self.words.nbytes + self.ids.nbytes <= CACHED_BYTES:
                break
        ends = self.stop_ids.take(pc.index_in(stops, value_set=self.stops))
        return pc.binary_join_element_wise(ids.take(cores.indices), ends, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "").cast(pa.large_string())
        if not len(texts):
            return []
        uncut = pc.match_substring_regex(texts, _UNCUT)
        lines = pc.replace_substring(pc.if_else(uncut, "", texts), "\n", " \n")
        for _ in range(2):  # line feeds in a row stay together
            lines = pc.replace_substring(lines, "\n \n", "\n\n")
        split = pc.split_pattern(lines, " ")
        cuts = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        words, number = coded.dictionary, coded.indices.to_numpy().copy()
        firsts = words.take(pa.array(number[cuts[:-1]])).to_pylist()  # these have no space before them
        number[cuts[:-1]] = len(words) + np.arange(len(texts))
        used = np.zeros(len(words) + len(texts), bool)
        used[number] = True
        ids = pa.concat_arrays([self._word_ids(words.filter(pa.array(used[:len(words)]))),
                                pa.array(self._encode(firsts), pa.large_binary())]).take(pa.array((np.cumsum(used) - 1)[number]))
        raw, ends = ids.buffers()[2].to_pybytes(), np.frombuffer(ids.buffers()[1], np.int64)[cuts].tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        whole = np.flatnonzero(uncut.to_numpy(zero_copy_only=False))
        for i, found in zip(whole.tolist(), self._encode(texts.take(pa.array(whole)).to_pylist())):
            out[i] = found
        return out


def worker_encoder(path: str, dtype: str) -> WordEncoder:
    """The encoder of this Python worker: tasks that it runs later find the words known."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_docloom_encoders", {})
    if (path, dtype) not in held:
        held[path, dtype] = WordEncoder(path, dtype)
    return held[path, dtype]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard's file.

    MAGIC, the header's length (8 bytes, little-endian), the header (JSON), then the sections
    it lists: document ids, lengths, and for each bit of an id, highest first, its plane in
    blocks of ``BLOCK_BITS`` bits, each compressed by itself. The header also has, for each
    plane, its zeros; the directory section has every block's offset and the ones before it.
    Plane k holds bit k of the ids in the order in which the planes before have left them:
    zeros first, else as they were.
    """
    pressed = zstandard.ZstdCompressor(level=1)
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    seq, zeros, blobs, offsets, ones = ids, [], [], [], []
    at = 0
    for b in range(bits - 1, -1, -1):
        low, high, before = [], [], 0
        for s in range(0, len(seq), BLOCK_BITS):
            part = seq[s:s + BLOCK_BITS]
            bit = (part & seq.dtype.type(1 << b)) != 0
            blob = pressed.compress(np.packbits(bit, bitorder="little").tobytes())
            blobs.append(blob)
            offsets.append(at)
            ones.append(before)
            at += len(blob)
            low.append(np.compress(~bit, part))
            high.append(np.compress(bit, part))
            before += len(high[-1])
        zeros.append(len(seq) - before)
        seq = np.concatenate([seq[:0], *low, *high])
    offsets.append(at)
    missing = [i is None for i in doc_ids]
    sections = [
        pressed.compress(np.array([i or 0 for i in doc_ids], "<i8").tobytes() + bytes(missing)),
        pressed.compress(lengths.astype("<i8").tobytes()),
        pressed.compress(np.array(offsets, "<i8").tobytes() + np.array(ones, "<i8").tobytes()),
    ]
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "bits": bits, "zeros": zeros,
                         "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<q", len(header)), header, *sections, *blobs])


class Wavelet:
    """Reads a shard's file: all of it, or single ids, ranks and places by a few blocks."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        (size,) = struct.unpack("<q", data[8:16])
        head = json.loads(data[16:16 + size])
        self.n, self.bits, self.zeros = head["tokens"], head["bits"], head["zeros"]
        at, raw = 16 + size, []
        for length in head["sections"]:
            raw.append(zstandard.decompress(data[at:at + length]))
            at += length
        n = head["docs"]
        gone = np.frombuffer(raw[0][8 * n:], bool)
        self.doc_ids = [None if g else int(i) for i, g in zip(np.frombuffer(raw[0][:8 * n], "<i8"), gone)]
        self.lengths = np.frombuffer(raw[1], "<i8")
        self.per_plane = -(-self.n // BLOCK_BITS)
        m = self.per_plane * self.bits
        numbers = np.frombuffer(raw[2], "<i8")
        self.offsets, self.ones = numbers[:m + 1], numbers[m + 1:].reshape(self.bits, -1)
        self.data, self.body, self.open = data, at, {}

    def _block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self.open:
            j = plane * self.per_plane + k
            raw = zstandard.decompress(self.data[self.body + self.offsets[j]:self.body + self.offsets[j + 1]])
            count = min(BLOCK_BITS, self.n - k * BLOCK_BITS)
            self.open[plane, k] = np.unpackbits(np.frombuffer(raw, np.uint8), count=count, bitorder="little").astype(bool)
        return self.open[plane, k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i <= 0:
            return 0
        if i >= self.n:
            return self.n - self.zeros[plane]
        k, r = divmod(i, BLOCK_BITS)
        return int(self.ones[plane, k]) + (int(np.count_nonzero(self._block(plane, k)[:r])) if r else 0)

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) ``bit`` of a plane."""
        before = self.ones[plane] if bit else np.arange(self.per_plane) * BLOCK_BITS - self.ones[plane]
        k = int(np.searchsorted(before, j, "right")) - 1
        return k * BLOCK_BITS + int(np.flatnonzero(self._block(plane, k) == bool(bit))[j - int(before[k])])

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.bits):
            k, r = divmod(i, BLOCK_BITS)
            bit = int(self._block(p, k)[r])
            value = value << 1 | bit
            i = self.zeros[p] + self._ones(p, i) if bit else i - self._ones(p, i)
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for p in range(self.bits):
            if token >> (self.bits - 1 - p) & 1:
                low, high = (self.zeros[p] + self._ones(p, x) for x in (low, high))
            else:
                low, high = (x - self._ones(p, x) for x in (low, high))
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before place i."""
        if token < 0 or token >> self.bits:
            return 0
        low, high = self._range(token, min(i, self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) ``token``."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        i = self._range(token, 0)[0] + j
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        seq = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            back, top = np.empty_like(seq), seq.dtype.type(1 << (self.bits - 1 - p))
            for k in range(self.per_plane):
                bit, one = self._block(p, k), int(self.ones[p, k])
                part, zero = back[k * BLOCK_BITS:k * BLOCK_BITS + len(bit)], k * BLOCK_BITS - one
                at = np.flatnonzero(~bit)
                part[at] = seq[zero:zero + len(at)]
                at = np.flatnonzero(bit)
                part[at] = seq[self.zeros[p] + one:self.zeros[p] + one + len(at)] | top
            self.open.clear()
            seq = back
        return seq


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All rows in order; behind its first row, a slice has ``SLICE_BYTES`` of text at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    n = -(-int(ends[-1]) // SLICE_BYTES) if len(ends) else 0
    cuts = np.searchsorted(ends, np.arange(1, n) * (ends[-1] / n), "right").tolist() if n else []
    for a, b in zip([0, *cuts], [*cuts, len(ends)]):
        if b > a:
            yield batch.slice(a, b - a)


def _writer(folder: str, tokenizer: str, dtype: str, shard_tokens: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, dtype)
        end = np.array([end_id], dtype).tobytes()
        store, base = _store(folder)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, seq
            lengths = np.array([len(t) for t in texts], np.int64) // np.dtype(dtype).itemsize
            name = f"shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.wvm"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(pack(ids, lengths, np.frombuffer(b"".join(texts), dtype)))
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name],
                "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([int(lengths.sum())], pa.int64())})
            ids, texts, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for rows in _slices(batch):
                for number, t in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1))):
                    ids.append(number)
                    texts.append(t + end)
                    size += len(t) + len(end)
                    if size >= shard_tokens * np.dtype(dtype).itemsize:
                        yield flush()
            pa.default_memory_pool().release_unused()
        if ids:
            yield flush()

    return run


def write_wavelet_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    vocabulary: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """Encode whole texts and write them as wavelet files in ascending id order.

    Returns the manifest (part, seq, file, n_docs, n_tokens); (part, seq) is the files' order.
    It is written with the files, and only files that it names count: a task that is run again
    writes new ones. A file ends with the first document that brings it to ``shard_tokens``
    ids, so one task holds one file's ids and the longest document at most. ``folder`` must be
    one that all executors share, of a kind that pyarrow opens (file, hdfs, s3, gs, abfs).

    Every document is followed by ``end_id``, which may also stand inside one: lengths are
    kept, not found. A null or empty text is the end id alone. Null ids come first; rows with
    equal ids are rows of their own, ordered by text. Other columns are not read; an empty
    table gives an empty manifest.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    _make(folder)
    rows = base.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(
        _writer(folder, tokenizer, dtype, shard_tokens, end_id),
        "part int, seq int, file string, n_docs long, n_tokens long")
    rows.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/manifest")


def _make(folder: str) -> None:
    store, base = _store(folder)
    store.create_dir(base, recursive=True)


def _open(folder: str, name: str) -> Wavelet:
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/{name}") as f:
        return Wavelet(f.read())


def _spread(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """About a file a task; a set number, as adaptive execution would merge rows so small."""
    return files.repartition(max(1, min(manifest.count(), 20_000)), "file")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    by_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    offsets = by_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(offsets, "part").select(
        "file", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"]):
                shard = _open(folder, name)
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                view = memoryview(ids).cast("B")
                yield pd.DataFrame({
                    "doc_id": pd.array(shard.doc_ids, "Int64"), "start": start + ends - shard.lengths, "n_tokens": shard.lengths,
                    "ids_crc32": [zlib.crc32(view[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), shard.lengths.tolist())]})

    return _spread(placed, manifest).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_token(manifest: DataFrame, folder: str, token: int) -> DataFrame:
    """(file, n): how often an id stands in each file, by rank on the bit-planes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "n": [_open(folder, f).count(token) for f in batch["file"]]})

    return _spread(manifest.select("file"), manifest).mapInPandas(run, "file string, n long")


def locate_token(manifest: DataFrame, folder: str, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of an id, by select; place counts ids from the document's first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                shard = _open(folder, name)
                at = np.array([shard.select(token, j) for j in range(shard.count(token))], np.int64)
                ends = np.cumsum(shard.lengths)
                doc = np.searchsorted(ends, at, "right")
                yield pd.DataFrame({"doc_id": pd.array([shard.doc_ids[d] for d in doc], "Int64"),
                                    "place": at - (ends - shard.lengths)[doc]})

    return _spread(manifest.select("file"), manifest).mapInPandas(run, "doc_id long, place long")


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a fresh shared folder and read the documents back from the files."""
    import public_tokenizers

    folder = work_dir(docs.sparkSession, "wavelet")
    manifest = write_wavelet_shards(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(manifest, folder)


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))


QUERIES = {"op2_wavelet_tokens": op2_wavelet_tokens}
