"""Embedding near-duplicates by cross-polytope hashing.

A vector (zero-padded to a power of two) is turned by pseudo-random rotations made of three rounds of random signs and a
fast Hadamard transform; a hash is the largest coordinate in absolute value with its sign, and a table's bucket joins HASHES
of them, so there are (2 * width) ** HASHES buckets a label (2 million for 64 dimensions). Each vector lives in its own
bucket of each table and probes those in which one hash takes its second choice. A vector is compared, in a bucket, with
those whose own bucket it is, and only within its label; a pair links if its cosine in double precision reaches the threshold.

Equal vectors of a label are one class, so copies are not expanded. Buckets without company are dropped before any vector
moves. A bucket of more than BLOCK members is split into tiles of BLOCK by BLOCK, so no task holds an unbounded bucket, and
tiles are dealt by hash to batches. A batch's result is linear: the number of links of each member and a spanning star of
each component. A pair that several tables find counts in the first of them alone, which both members' hashes tell.

Edge cases: null, zero or non-finite vectors, null components and null labels link with nothing. Vectors of different length
never link. Null ids take part; a component of null ids alone has a null component_id. Repeated rows are copies: they link
with one another, each is a row of the result. Ties of the hash take the first coordinate. An empty table gives no rows.
Vectors may be of any length. Columns other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import checkpointed, table
from ebbtide.llm.graph import components

TABLES, HASHES, BLOCK = 6, 3, 1024
PROBES = 1 + HASHES
PAIRS = 500_000  # of small tiles, compared at once


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each column."""
    d, n = x.shape
    h = 1
    while h < d:
        x = x.reshape(d // (2 * h), 2, h, n)
        x = np.stack((x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]), axis=1)
        h *= 2
    return x.reshape(d, n)


def codes(vectors: np.ndarray, tables: int = TABLES, seed: int = 11) -> np.ndarray:
    """(rows, tables, PROBES) buckets; the first is the vector's own."""
    n, d = vectors.shape
    width = 1 << max(1, d - 1).bit_length()
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, HASHES, 3, width, 1))
    out = np.empty((n, tables, PROBES), np.int64)
    for at in range(0, n, 1024):  # a block stays in the processor's cache
        block = vectors[at : at + 1024]
        padded = np.zeros((width, len(block)), np.float32)
        padded[:d] = (block / np.abs(block).max(axis=1)[:, None]).T
        for t in range(tables):
            first = np.empty((HASHES, len(block)), np.int64)
            second = np.empty_like(first)
            for k in range(HASHES):
                y = padded
                for r in range(3):
                    y = _hadamard(y * signs[t, k, r])
                y = np.ascontiguousarray(y.T)
                size, row = np.abs(y), np.arange(len(y))
                for pick in (first, second):
                    most = size.argmax(axis=1)
                    pick[k] = 2 * most + (y[row, most] < 0)
                    size[row, most] = -1
            base = np.int64(2 * width)
            for p in range(PROBES):
                bucket = np.full(len(block), t, np.int64)
                for k in range(HASHES):
                    bucket = bucket * base + (second if p == k + 1 else first)[k]
                out[at : at + 1024, t, p] = bucket
    return out


def _codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for vectors in batches:
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        for _, same in vectors.groupby(vectors.map(len)):
            found = codes(np.stack(same.to_numpy()).astype(float)).reshape(len(same), -1)
            out.loc[same.index] = pd.Series(list(found), index=same.index)
        yield out


def _spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (many of them) of each."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start, many)


def _near(x: np.ndarray, tile: np.ndarray, home: np.ndarray, other: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (home, other) of pairs of a tile whose cosine reaches the threshold. x: unit vectors, sorted by tile."""
    homes, others = np.flatnonzero(home), np.flatnonzero(other)
    tiles = np.unique(tile)
    h, h2 = (np.searchsorted(tile[homes], tiles, side) for side in ("left", "right"))
    o, o2 = (np.searchsorted(tile[others], tiles, side) for side in ("left", "right"))
    large = (h2 - h) * (o2 - o) > 4096
    for k in np.flatnonzero(large).tolist():
        a, b = homes[h[k] : h2[k]], others[o[k] : o2[k]]
        i, j = np.nonzero(x[a] @ x[b].T >= threshold)
        yield a[i], b[j]
    left = _spread(h[~large], (h2 - h)[~large])  # homes of small tiles, each beside all others of its tile
    many, start = (np.repeat(v[~large], (h2 - h)[~large]) for v in (o2 - o, o))
    ends = np.cumsum(many)
    for cut in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        own = slice(np.searchsorted(ends, cut, "right"), np.searchsorted(ends, cut + PAIRS, "right"))
        a, b = np.repeat(homes[left[own]], many[own]), others[_spread(start[own], many[own])]
        hit = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        yield a[hit], b[hit]


def _stars(ids: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 .. ids - 1 is joined with by pairs (p, q)."""
    root, was = np.arange(ids), None
    while was is None or (root != was).any():
        was = root.copy()
        np.minimum.at(root, p, was[q])
        np.minimum.at(root, q, was[p])
        root = root[root]
    return root


def _counted(threshold: float):
    """Links counted in a batch of tiles: cid, links, root."""

    def met(buckets: np.ndarray, probes: np.ndarray) -> np.ndarray:
        return (buckets[:, None] == probes).any(axis=1)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 3), np.int64)]
        for _, same in rows.groupby("size"):
            same = same.assign(tile=same.groupby(["label", "bucket", "i", "j"], sort=False).ngroup()).sort_values("tile", kind="stable")
            x = np.stack(same.embedding.to_numpy()).astype(float)
            x /= np.abs(x).max(axis=1)[:, None]
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            own = np.stack(same.codes.to_numpy()).reshape(len(same), -1, PROBES)
            cid, copies, place = same.cid.to_numpy(), same.copies.to_numpy(), same.place.to_numpy()
            ids, at = np.unique(cid, return_inverse=True)
            links, pairs = np.zeros(len(ids), np.int64), []
            for i, j in _near(x, same.tile.to_numpy(), same.as_home.to_numpy(), same.as_other.to_numpy(), threshold):
                t = place[i]
                keep = (cid[i] < cid[j]) | ((cid[i] > cid[j]) & ~met(own[j, t, 0], own[i, t]))  # from one side alone
                i, j, t = i[keep], j[keep], t[keep]
                for s in range(own.shape[1] - 1):  # in no earlier table
                    later = np.flatnonzero(t > s)
                    known = met(own[i[later], s, 0], own[j[later], s]) | met(own[j[later], s, 0], own[i[later], s])
                    i, j, t = (np.delete(v, later[known]) for v in (i, j, t))
                links += np.bincount(at[i], copies[j], len(ids)).astype(np.int64) + np.bincount(at[j], copies[i], len(ids)).astype(np.int64)
                pairs.append((at[i], at[j]))
            p, q = (np.concatenate(v) for v in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
            told = np.flatnonzero(links)
            found.append(np.stack((ids, links, ids[_stars(len(ids), p, q)]), axis=1)[told])
        return pd.DataFrame(np.concatenate(found), columns=["cid", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = rows.where(able).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    hashed = F.pandas_udf(_codes, "array<long>").asNondeterministic()("embedding")
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("cid"), "*", F.size("embedding").alias("size"), hashed.alias("codes")))
    placed = classes.select("cid", "label", "size", F.posexplode("codes").alias("n", "bucket")).withColumn("home", F.col("n") % PROBES == 0).withColumn("place", F.floor(F.col("n") / PROBES).cast("int")).drop("n")
    full = placed.groupBy("label", "size", "bucket").agg(F.count("*").alias("members"), F.max("home").alias("lived")).where("lived and members > 1")
    full = checkpointed(full.select("label", "size", "bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))  # a table of its own: Spark splits the rows of a large bucket in the join
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    placed = checkpointed(placed.join(full, ["label", "size", "bucket"]).select("cid", "label", "size", "bucket", "place", "home", "blocks", own.alias("own")))
    part = lambda rows, i, j, home, other: rows.select("cid", "label", "size", "bucket", "place", i.alias("i"), j.alias("j"), home.alias("as_home"), other.alias("as_other"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    split = placed.where("blocks > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    tiles = part(placed.where("blocks = 1"), zero, zero, F.col("home"), yes).union(part(split.where("home"), F.col("own"), F.col("k"), yes, no)).union(part(split, F.col("k"), F.col("own"), no, yes))
    batches = max(1, -(-placed.count() // 10_000))
    dealt = tiles.join(classes.select("cid", "embedding", "codes", "copies"), "cid").withColumn("batch", F.pmod(F.xxhash64("label", "size", "bucket", "i", "j"), F.lit(batches)))
    found = checkpointed(dealt.groupBy("batch").applyInPandas(_counted(threshold), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), F.col("component").alias("root"))
    judged = classes.select("cid", "label", "embedding", "first", "copies").join(links, "cid", "left").join(rooted, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = judged.groupBy("root").agg(F.min("first").alias("component_id"))
    judged = judged.join(ids, "root").select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where(able).join(judged, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null
and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
r(n, c) as (select vec_id, vec_id from embeddings union select p.b, r.c from r join p on p.a = r.n),
l as (select a, count(*) as n_links from p group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from (select n as vec_id, min(c) as component_id from r group by n) left join l on l.a = vec_id"""
