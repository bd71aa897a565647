"""Near copies among documents: circulant MinHash, banding, exact Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bucket_blocks, each_bucket, matrix, saved, shuffle_partitions, table
from docloom.llm.graph import components

BANDS, ROWS, BLOCK, SEED = 24, 6, 256, 0x9E3779B97F4A7C15
#: a pair whose signatures agree in fewer coordinates than the limit less this is not looked at
SLACK = 5.5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers: each step can be undone. Works in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``words`` words.

    Words are runs without space or \\t..\\r, A-Z lower-cased; with fewer words the whole
    sequence is one shingle; without words there is none.
    """
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    n = max(1, len(tokens) - words + 1)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    run = np.full(n, len(tokens) - n, np.uint64)  # so a short sequence is unlike a full run
    for k in range(len(tokens) - n + 1):
        run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(run)


def circulant(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One signature for each non-empty set.

    The first permutation places a shingle on a circle of 2**32 places (the upper half of a
    bijective hash); coordinate k is the least value of the second permutation over the places
    shifted by k. Only two permutations are ever drawn.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), coordinates), np.uint32)
    first = 0
    while first < len(sets):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), 1 << 15, "right")))
        places = (_mix(np.concatenate(sets[first:last]) + np.uint64(SEED)) >> np.uint64(32)).astype(np.uint32)
        starts = np.r_[0, np.cumsum(sizes[first:last])[:-1]]
        for k in range(coordinates):
            out[first:last, k] = np.minimum.reduceat(_pi(places + np.uint32(k)), starts)
        first = last
    return out


def _profiles(words: int, coordinates: int):
    """(id, text) to (id, n_shingles, digest, signature)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for s in range(0, len(batch), 512):
                part = batch.iloc[s:s + 512]
                sets = [shingles(t, words) for t in part["text"]]
                some = [x for x in sets if len(x)]
                signatures = iter(circulant(some, coordinates)) if some else iter(())
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "n_shingles": [len(x) for x in sets],
                    "digest": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
                    "signature": [next(signatures).tobytes() if len(x) else None for x in sets],
                })

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 256):
                part = batch.iloc[s:s + 256]
                yield pd.DataFrame({"id": part["id"].to_numpy(),
                                    "items": [shingles(t, words).tobytes() for t in part["text"]]})

    return run


def _confirm(percent: int):
    """(u, v, items, others) to the links (u, v)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for a, b in zip(batch["items"], batch["others"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                low, high = sorted((len(x), len(y)))
                if 100 * low < percent * high:
                    good.append(False)
                    continue
                good.append(_share_enough(x, y, percent))
            yield batch.loc[np.array(good, bool), ["u", "v"]]

    return run


def _share_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _open_pairs(batches: Iterator[pd.DataFrame], bands: int, rows: int, percent: int):
    """From blocks of buckets: (part, a, b, agreement) of the pairs that may still join two components.

    A pair is named in the first band that brings it together only, and only if sizes and
    signatures leave room for a link.
    """
    share = percent / 100
    n = bands * rows
    least = n * share - SLACK * (n * share * (1 - share)) ** 0.5
    for part, i, j in each_bucket(batches):
        sig, comp = matrix(part["signature"], "<u4"), part["component"].to_numpy()
        size, band = part["n_shingles"].to_numpy(), part["band"].to_numpy()
        found = []
        for s in range(0, len(i), 1 << 14):
            a, b = i[s:s + (1 << 14)], j[s:s + (1 << 14)]
            low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            keep = (comp[a] != comp[b]) & (100 * low >= percent * high)
            a, b = a[keep], b[keep]
            same = sig[a] == sig[b]
            agreement = same.sum(1)
            first = same.reshape(len(a), bands, rows).all(2).argmax(1) == band[a]
            keep = first & (agreement >= least)
            found.append((a[keep], b[keep], agreement[keep]))
        yield part, *(np.concatenate([f[k] for f in found]) for k in range(3))


def _open_rows(bands: int, rows: int, percent: int):
    """Blocks of a bucket to those of their rows that have a partner to be compared with."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, a, b, _ in _open_pairs(batches, bands, rows, percent):
            some = np.unique(np.concatenate((a, b)))
            if len(some):
                yield part.loc[some, ["bucket", "lo", "hi", "block", "band", "id", "component"]]

    return run


def _join_components(bands: int, rows: int, percent: int):
    """The same rows with their sets to links (u, v), as many as join components here.

    Likely links come first, and a pair that is in one component by then is not compared, so
    a group that holds together takes about as many comparisons as it has members.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, a, b, agreement in _open_pairs(batches, bands, rows, percent):
            ids, comp, items = part["id"].tolist(), part["component"].tolist(), part["items"].tolist()
            parent = {c: c for c in comp}

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out = []
            for k in np.argsort(-agreement, kind="stable").tolist():
                i, j = int(a[k]), int(b[k])
                x, y = find(comp[i]), find(comp[j])
                if x != y and _share_enough(np.frombuffer(items[i], np.uint64), np.frombuffer(items[j], np.uint64), percent):
                    parent[max(x, y)] = min(x, y)
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    return run


def minhash_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """Components of documents with 100 * shared shingles >= ``percent`` * all their shingles.

    Returns (id, n_shingles, component_id, kept), one row for each input row. Documents of
    equal sets are one class first. Candidates share a band of ``rows`` of ``bands * rows``
    signature coordinates: a pair at a similarity of 0.8 is missed with a chance of 0.07 %, at
    0.85 of 0.001 %. Every link is confirmed on the full sets.

    A bucket is first compared with the member that most candidates share (a group of near
    copies becomes a component by as many comparisons as it has members); what is left
    between different components of a bucket is compared inside its blocks, likely links
    first. So no link that the bands bring up is lost between components, and no group is
    expanded into rows of pairs.

    A null, empty or blank text has no shingles and links with nothing. Rows with equal ids
    are rows of their own in the result, with the smallest id of their component. A null id
    links with nothing. Other columns are not read; an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    all_rows = saved(base.mapInPandas(_profiles(words, bands * rows),
                                      "id long, n_shingles long, digest binary, signature binary"), "profiles")
    classes = saved(all_rows.where("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("rep")), "classes")
    reps = all_rows.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"]).dropDuplicates(["id"])
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 4 * rows * b + 1, 4 * rows)) for b in range(bands)])
    banded = reps.select("id", F.posexplode(keys).alias("band", "bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = saved(banded.join(sizes, "bucket"), "buckets")

    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    leaders = shared.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("id"))).alias("m"))
    stars = (
        shared.join(leaders.select("bucket", (-F.col("m.col2")).alias("lead")), "bucket").where("lead != id")
        .select(F.greatest("id", "lead").alias("u"), F.least("id", "lead").alias("v")).distinct()
    )
    # stored, so that few ids are known to be few: texts then stay where they are
    some = saved(shared.select("id").distinct(), "candidates")
    sets = saved(base.join(some, "id", "left_semi").dropDuplicates(["id"]).mapInPandas(
        _sets(words), "id long, items binary"), "sets")

    filled = stars.join(sets.withColumnRenamed("id", "u"), "u").join(
        sets.select(F.col("id").alias("v"), F.col("items").alias("others")), "v")
    sure = saved(filled.select("u", "v", "items", "others").mapInPandas(_confirm(percent), "u long, v long"), "links")
    part = components(sure)
    named = saved(shared.select("bucket", "band", "id").join(part.withColumnRenamed("node", "id"), "id", "left")
                  .withColumn("component", F.coalesce("component", "id")), "named")
    split = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b")
    members = named.join(split.select("bucket"), "bucket").join(reps.select("id", "signature", "n_shingles"), "id")
    fields = "bucket long, lo int, hi int, block int, band int, id long, component long"
    todo = saved(bucket_blocks(members, block).mapInPandas(_open_rows(bands, rows, percent), fields), "open")
    filled = todo.join(reps.select("id", "signature", "n_shingles"), "id").join(sets, "id")
    more = saved(filled.repartition(shuffle_partitions(docs), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInPandas(
        _join_components(bands, rows, percent), "u long, v long"), "links")
    part = components(sure.union(more))
    per_class = classes.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id"))
    out = all_rows.select("id", "n_shingles", "digest").join(per_class, "digest", "left")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows with an equal id stay or go together: an id goes if one of its rows has a smaller
    id in its component. Rows with a null id stay.
    """
    found = minhash_classes(docs, words=words, percent=percent).where("doc_id is not null")
    gone = saved(found.where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(table(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES = {"op4_minhash_near_dup": op4_minhash_near_dup}
