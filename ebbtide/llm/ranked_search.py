r"""Ranked lexical search by Block-Max WAND.

Terms are `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` after lower-casing A-Z. The queries are a stated set of rows, taken in
blocks of BLOCK characters (and one row at least): a block's vocabulary is what the driver and a worker hold at once.

Index: texts stay where they are read; the documents of a task, SHARD characters at most (and one text at least), are a
shard, numbered by ascending key. A term's postings are cut into blocks of POSTINGS; a block keeps its gaps and frequencies
as bit fields of the width it needs, and outside them its first and last document and its impacts: those pairs of frequency
and document length that no other pair of the block beats, from which its greatest impact follows for any collection.
Only terms of the queries are indexed. Shards are written once; counts over all of them give the statistics.

Search: every shard is searched for every query by the same lists. The pivot is the first document at which the lists' greatest
impacts can beat the k-th best score so far; the lists before it move to their blocks that may hold it, without
decompressing any (shallow moves), and if these blocks' impacts together can't beat that score, all skip to the next block
border. Otherwise the blocks are decompressed, strongest first, until the document is scored or can't get in any more. A
task keeps its best over its shards; the tasks' best are merged in two steps, by shares of a query, then by query, so that no
query gathers more than k rows of a share.

Scores are integers, see `impact` and `weight`: a term's weight times how far its frequency, dampened by the document's
length, lifts it; summed over the query's terms, repeats included.

Edge cases: null and termless texts are no documents; null and termless queries have no answer. Documents with a null key
come last among equals. Repeated documents are ranked each by itself, and repeated query rows answered each by itself. Ties
go by ascending key; documents that score 0 are left out. Texts of any length are indexed whole. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.core import checkpointed, table
from ebbtide.llm.text import pieces

SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
POSTINGS, SHARD, BLOCK, SHARES = 128, 64_000_000, 8_000_000, 64
BLOCKS = "documents long, terms long, sizes array<int>, term array<int>, first array<int>, last array<int>, many array<int>, place array<long>, packed binary, impacts array<int>, beats_tf array<int>, beats_size array<int>"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(SPLIT).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, size: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """How far a term lifts a document that holds it tf times among `size` terms, in millionths of its weight."""
    tf, size = tf.astype(np.int64), size.astype(np.int64)
    return (10**9 * tf) // (1000 * tf + 12 * (75 + 25 * size * documents // max(all_terms, 1)))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as bit fields of equal width, which stands first."""
    width = int(values.max(initial=0)).bit_length()
    bits = (values[:, None] >> np.arange(width)) & 1
    return bytes([width]) + np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, many: int) -> tuple[np.ndarray, int]:
    """The values, and how many bytes they took."""
    width = data[0]
    taken = 1 + (many * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, taken - 1, 1), count=many * width, bitorder="little")
    return bits.reshape(many, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)), taken


def _shard(keys: list, sizes: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> dict:
    """A shard's row from its documents and their postings, in any order."""
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
    number = np.empty(len(keys), np.int64)
    number[order] = np.arange(len(keys))
    sizes, doc = sizes[order], number[doc]
    by = np.lexsort((doc, term))
    term, doc, tf = term[by], doc[by], tf[by]
    new = np.flatnonzero(np.diff(term, prepend=-1))
    within = np.arange(len(term)) - np.repeat(new, np.diff(np.append(new, len(term))))
    starts = np.flatnonzero(within % POSTINGS == 0)
    ends = np.append(starts, len(term))[1:]
    packed, place, beats, impacts = bytearray(), [], [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        place.append(len(packed))
        packed += pack(np.diff(doc[a:b]) - 1) + pack(tf[a:b] - 1)
        best = a + np.lexsort((sizes[doc[a:b]], -tf[a:b]))
        size = sizes[doc[best]]
        best = best[np.append(True, size[1:] < np.minimum.accumulate(size)[:-1])]
        impacts.append(len(beats))
        beats += zip(tf[best].tolist(), sizes[doc[best]].tolist(), strict=True)
    return {
        "keys": [keys[i] for i in order], "documents": len(keys), "terms": int(sizes.sum()), "sizes": sizes.astype(np.int32), "term": term[starts].astype(np.int32), "first": doc[starts].astype(np.int32),
        "last": doc[ends - 1].astype(np.int32), "many": (ends - starts).astype(np.int32), "place": np.array(place, np.int64), "packed": bytes(packed), "impacts": np.array(impacts, np.int32),
        "beats_tf": np.array([x[0] for x in beats], np.int32), "beats_size": np.array([x[1] for x in beats], np.int32),
    }


def index(docs: DataFrame, vocabulary, text: str = "text", key: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """Shards of the documents, with the postings of a (broadcast) vocabulary: bytes of a term to its number."""
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    schema = T.StructType([T.StructField("keys", T.ArrayType(held.schema["key"].dataType)), *T.StructType.fromDDL(BLOCKS)])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.value
        keys, sizes, parts, letters = [], [], [], 0

        def flushed() -> Iterator[pd.DataFrame]:
            if keys:
                posted = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pd.DataFrame({c: [v] for c, v in _shard(keys, np.array(sizes, np.int64), *posted).items()})

        for batch in batches:
            own, at = batch["key"].astype(object).where(batch["key"].notna(), None).tolist(), 0
            for piece in pieces(batch["text"], 2_000_000):
                more = sum(map(len, piece))
                if keys and letters + more > shard:
                    yield from flushed()
                    keys, sizes, parts, letters = [], [], [], 0
                letters += more
                split = [terms(t) for t in piece]
                owner = np.repeat(len(keys) + np.cumsum([bool(x) for x in split]) - 1, [len(x) for x in split])
                keys += [k for k, x in zip(own[at : at + len(piece)], split, strict=True) if x]
                sizes += [len(x) for x in split if x]
                at += len(piece)
                found = np.array([number.get(w, -1) for x in split for w in x], np.int64)
                both, tf = np.unique((found * (len(keys) + 1) + owner)[found >= 0], return_counts=True)
                parts.append((both // (len(keys) + 1), both % (len(keys) + 1), tf))
        yield from flushed()

    return held.mapInPandas(build, schema)


class Shard:
    """A shard's blocks; those decompressed so far are kept for the queries to come."""

    def __init__(self, row, documents: int, all_terms: int):
        self.keys, self.sizes, self.stats = [None if pd.isna(k) else k for k in row.keys], np.asarray(row.sizes), (documents, all_terms)
        self.first, self.last, self.many, self.place, self.packed = (getattr(row, c).tolist() if c != "packed" else row.packed for c in ("first", "last", "many", "place", "packed"))
        lifts = impact(np.asarray(row.beats_tf), np.asarray(row.beats_size), documents, all_terms)
        self.most = np.maximum.reduceat(lifts, row.impacts).tolist() if len(lifts) else []
        term = np.asarray(row.term)
        new = np.flatnonzero(np.diff(term, prepend=-1))
        self.blocks = {int(term[a]): (a, b) for a, b in zip(new.tolist(), np.append(new, len(term))[1:].tolist(), strict=True)}
        self.open: dict[int, tuple[list, list]] = {}

    def postings(self, block: int) -> tuple[list, list]:
        """Documents of a block, and their impacts."""
        held = self.open.get(block)
        if held is None:
            data, many = self.packed[self.place[block] :], self.many[block]
            gaps, taken = unpack(data[: 8 * POSTINGS + 1], many - 1)
            tf, _ = unpack(data[taken : taken + 8 * POSTINGS + 1], many)
            docs = self.first[block] + np.concatenate(([0], np.cumsum(gaps + 1)))
            held = self.open[block] = (docs.tolist(), impact(tf + 1, self.sizes[docs], *self.stats).tolist())
        return held


class Cursor:
    """A query's place in a term's list: no posting before `at` is left; `block` is where `at` falls."""

    __slots__ = ("at", "block", "end", "weight", "most")

    def __init__(self, shard: Shard, block: int, end: int, weight: int):
        self.at, self.block, self.end, self.weight = shard.first[block], block, end, weight
        self.most = weight * max(shard.most[block:end])


def _rank(cursor: Cursor) -> int:
    return cursor.at


def search(shard: Shard, asked: list[tuple[int, int]], best: list[tuple], k: int) -> None:
    """Put the shard's documents into `best`: (-score, whether the key is null, key), sorted, k at most. asked: (term, weight)."""
    lists = [Cursor(shard, *shard.blocks[t], w) for t, w in asked if t in shard.blocks and w > 0]
    keys, first, last, most, end = shard.keys, shard.first, shard.last, shard.most, len(shard.keys)
    while lists:
        lists.sort(key=_rank)
        while lists and lists[-1].at >= end:
            lists.pop()
        if not lists:
            break
        bar = 0  # what a document must beat
        if len(best) == k:
            low, null, key = best[-1]
            here = keys[lists[0].at]
            bar = -low if (null, key) <= (here is None, here) else -low - 1  # later ones lose ties
        reach, p = 0, 0
        for x in lists:
            reach += x.most
            if reach > bar:
                break
            p += 1
        else:
            break
        pivot = lists[p].at
        while p + 1 < len(lists) and lists[p + 1].at == pivot:
            p += 1
        border = lists[p + 1].at if p + 1 < len(lists) else end
        near, reach = [], 0
        for x in lists[: p + 1]:
            if last[x.block] < pivot:
                x.block = bisect_left(last, pivot, x.block + 1, x.end)
                if x.block == x.end:
                    x.at = end
                    continue
            if first[x.block] > pivot:
                x.at = first[x.block]
                border = min(border, x.at)
            else:
                top = x.weight * most[x.block]
                reach += top
                near.append((top, x))
                border = min(border, last[x.block] + 1)
        if reach <= bar:
            for _, x in near:
                x.at = max(x.at, border)
            continue
        near.sort(key=lambda pair: -pair[0])
        score = 0
        for top, x in near:
            if score + reach <= bar:
                x.at = max(x.at, pivot + 1)
                continue
            docs, lifts = shard.postings(x.block)
            i = bisect_left(docs, pivot)
            reach -= top
            if docs[i] == pivot:
                score += x.weight * lifts[i]
                i += 1
            x.at = docs[i] if i < len(docs) else first[x.block + 1] if x.block + 1 < x.end else end
        if score > bar:
            key = keys[pivot]
            insort(best, (-score, key is None, key))
            del best[k:]


def _searched(plan, k: int):
    """plan: broadcast of the queries as lists of (term, weight), and the collection's counts of documents and terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, documents, all_terms = plan.value
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for row in batch.itertuples(index=False):
                shard = Shard(row, documents, all_terms)
                for asked, held in zip(queries, best, strict=True):
                    search(shard, asked, held, k)
        rows = [(q, key, -low) for q, held in enumerate(best) for low, _, key in held]
        yield pd.DataFrame({"q": pd.array([r[0] for r in rows], "int32"), "key": pd.Series([r[1] for r in rows], dtype=object), "score": pd.array([r[2] for r in rows], "int64")})

    return run


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, text: str, key: str, size: int) -> Iterator[list[tuple]]:
    held, letters = [], 0
    for row in queries.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").toLocalIterator():
        if held and letters + len(row.text) > size:
            yield held
            held, letters = [], 0
        held.append((row.key, row.text))
        letters += len(row.text)
    if held:
        yield held


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20, text: str = "text", key: str = "doc_id", query_text: str = "text", query_key: str = "item_id", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query key, rank, document key, score): each query's k best documents."""
    spark, name = docs.sparkSession, queries.schema[query_key].dataType
    found = []
    for held in _query_blocks(queries, query_text, query_key, block):
        number: dict[bytes, int] = {}
        counts = [Counter(number.setdefault(t, len(number)) for t in terms(body)) for _, body in held]
        shards = checkpointed(index(docs, spark.sparkContext.broadcast(number), text, key, shard))
        total = shards.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        df = dict(shards.select(F.explode(F.arrays_zip("term", "many")).alias("b")).groupBy("b.term").agg(F.sum("b.many")).collect())  # a row for each term of the block
        asked = [[(t, many * weight(total[0], df[t])) for t, many in c.items() if t in df] for c in counts]
        schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.LongType())])
        rows = shards.mapInPandas(_searched(spark.sparkContext.broadcast((asked, *total)), k), schema)
        rows = _best(_best(rows.withColumn("share", F.pmod(F.xxhash64("key", "score"), F.lit(SHARES))), k, "q", "share"), k, "q")
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(held)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", name)]))
        found.append(rows.join(F.broadcast(names), "q").select(F.col("item").alias(query_key), "rank", F.col("key").alias(key), "score"))
    schema = T.StructType([T.StructField(query_key, name), T.StructField("rank", T.IntegerType()), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())])
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS.format(t="text")} as w from documents where text is not null),
sized as (select r, doc_id, len(w)::bigint as n from d where len(w) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from sized),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from d) group by r, term),
q as (select row_number() over () as q, item_id, {_TERMS.format(t="text")} as w from benchmark where text is not null),
asked as (select q, item_id, term, count(*)::bigint as many from (select q, item_id, unnest(w) as term from q) group by q, item_id, term),
weighed as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as weight from tf, total where term in (select term from asked) group by term),
scored as (
  select q, item_id, doc_id, r, sum(many * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from asked join weighed using (term) join tf using (term) join sized using (r), total group by q, item_id, doc_id, r
)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0) where rank <= 20
"""
