"""Near copies among embeddings: random-hyperplane sign hashing, exact cosine, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bucket_blocks, each_bucket, matrix, saved, table
from docloom.llm.graph import components

TABLES, BITS, BLOCK, SEED = 32, 16, 512, 20240607


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _signs(tables: int, bits: int, seed: int, kind: str):
    """(id, vector) to (id, v binary, codes binary, keys array): null ``v`` where nothing can link."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weight = (1 << np.arange(bits, dtype=np.uint64))
        for batch in batches:
            v: list = [None] * len(batch)
            codes: list = [None] * len(batch)
            keys: list = [None] * len(batch)
            by_dim: dict[int, list[int]] = {}
            vectors = list(batch["vector"])
            for i, x in enumerate(vectors):
                if x is not None and len(x):
                    x = vectors[i] = np.asarray(x, dtype=kind)
                    if np.isfinite(x).all() and x.any():
                        by_dim.setdefault(len(x), []).append(i)
            for dim, rows in by_dim.items():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                x = np.stack([vectors[i] for i in rows])
                x[x == 0] = 0  # one form of zero
                above = (_unit(x) @ planes[dim] > 0).reshape(len(rows), tables, bits)
                code = (above * weight).sum(2).astype("<u4")
                number = np.arange(tables, dtype=np.uint64) + np.uint64(dim * tables)
                key = code.astype(np.uint64) | (number << np.uint64(32))
                for r, i in enumerate(rows):
                    v[i], codes[i], keys[i] = x[r].tobytes(), code[r].tobytes(), key[r].view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "v": v, "codes": codes, "keys": keys})

    return run


def _links(min_cosine: float, kind: str):
    """Blocks of a bucket to rows (id, other, links): what one task finds, folded.

    A pair counts in the first table that brings it together. ``links`` is the weight of a
    row's linked partners here; (id, other) rows are enough links to keep what is linked
    connected: all of a small group, a star for each component of a large one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, i, j in each_bucket(batches):
            x, codes = _unit(matrix(rows["v"], kind)), matrix(rows["codes"], "<u4")
            ids, weight, t = rows["id"].to_numpy(), rows["weight"].to_numpy(), rows["t"].to_numpy()
            keep = []
            for s in range(0, len(i), 1 << 16):
                a, b = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= min_cosine
                a, b = a[near], b[near]
                first = (codes[a] == codes[b]).argmax(1) == t[a]
                keep.append((a[first], b[first]))
            i, j = np.concatenate([k[0] for k in keep]), np.concatenate([k[1] for k in keep])
            if not len(i):
                continue
            links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
            some = np.flatnonzero(links)
            yield pd.DataFrame({"id": ids[some], "other": pd.array([None] * len(some), "Int64"),
                                "links": links[some].astype(np.int64)})
            if len(i) > 4 * len(ids):
                i, j = _stars(len(ids), i, j)
            yield pd.DataFrame({"id": ids[i], "other": pd.array(ids[j], "Int64"), "links": 0})

    return run


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the first row of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(root != np.arange(n))
    return some, root[some]


def embedding_near_dup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = 0.95,
    tables: int = TABLES,
    bits: int = BITS,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """Links and components of vectors with a cosine of at least ``min_cosine``.

    Returns (id, n_links, component_id, kept) with one row for each input row. Candidates
    share the signs of ``bits`` random hyperplanes in one of ``tables`` tables; each is
    confirmed by its cosine in double precision. At a cosine of 0.95 a pair is missed with a
    chance of 0.2 %, at 0.97 of 0.003 %.

    Equal vectors are one vector with a weight, so a third of all rows may be copies. Large
    buckets are cut into pairs of blocks of about ``block`` rows.

    Null, empty, zero vectors and those with null or non-finite components link with nothing;
    so do vectors of different lengths. Rows with equal or null ids are rows of their own, and
    count as links of one another if their vectors link. A component is named by its smallest
    id that is not null; one that has none is named null, and its rows are all kept, since
    nothing tells them apart. Other columns are not read; an empty table gives an empty one.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(
        "array<float>" if kind == "<f4" else "array<double>").alias("vector"))
    coded = saved(base.mapInPandas(
        _signs(tables, bits, seed, kind), "id long, v binary, codes binary, keys array<long>"), "signs")
    # a class of equal vectors is known by a number of its own: ids may repeat or be null
    classes = saved(coded.where("v is not null").groupBy("v").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("codes").alias("codes"),
        F.first("keys").alias("keys")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = classes.select(F.col("rep").alias("id"), "codes", "keys", "v", "weight")
    rows = reps.select("id", "v", "codes", "weight", F.posexplode("keys").alias("t", "bucket"))
    found = saved(bucket_blocks(rows, block).mapInPandas(
        _links(min_cosine, kind), "id long, other long, links long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("other is not null").select(
        F.col("id").alias("u"), F.col("other").alias("v")))
    named = saved(
        classes.select("v", "rep", "least", "weight").join(links.withColumnRenamed("id", "rep"), "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "named")
    least = named.where("component is not null").groupBy("component").agg(F.min("least").alias("least_of_all"))
    per_class = named.join(least, "component", "left").select(
        "v", "n_links", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("least_of_all")).alias("component_id"))
    out = coded.select("id", "v").join(per_class, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embedding_near_dup": op1_embedding_near_dup}

# every pair compared; DuckDB's list_cosine_similarity on doubles is exact to the last bits
ORACLES = {
    "op1_embedding_near_dup": """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id != b.vec_id
          AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(id, r) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.id = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.id
""",
}
