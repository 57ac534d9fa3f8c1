"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes (2**18 of them) of its words, word pairs and pairs with one word between, each
present or not. Training rows are a bounded sample: at most `max_examples` labelled documents, by hash of their id. They
are dealt to a fixed number of shards; in each round every shard runs FTRL-proximal (a learning rate for each coordinate,
L1 sparsity) from the common state, and Spark averages the shards' states. The weights that L1 leaves are broadcast: 2**18
at most.

Edge cases: null and empty texts score as the bias alone. A document with several labels is toxic if any of them says so.
Null labels and null ids are never learnt from. With no labelled row every score is 0.5. Of repeated ids the smallest text
is learnt. A text of any length is scored whole. An empty table gives no rows. Other columns are passed on, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import checkpointed, crc_fold, table
from ebbtide.llm.text import fresh, pieces

BITS = 18
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the index of the text each comes from, repeats included."""
    words, sizes = [], []
    for text in texts:
        own = text.encode().translate(SPLIT).split()
        words += own
        sizes.append(len(own))
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    found, owners = [h * MIX[0]], [owner]
    for gap, k in ((1, 1), (2, 3)):
        same = owner[gap:] == owner[:-gap]
        found.append((h[:-gap] * MIX[k] ^ (h[gap:] * MIX[k + 1] << np.uint64(1)))[same] * MIX[0])
        owners.append(owner[:-gap][same])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def _distinct(feature: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owner << BITS | feature)
    return both & ((1 << BITS) - 1), both >> BITS


class Ftrl:
    """State of FTRL-proximal: z and n of each coordinate, the bias last."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == 1 << BITS, 0, self.l1), 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _held(texts: pd.Series) -> pd.Series:
    """Each text's distinct features, sorted."""
    out = []
    for piece in pieces(texts, 2_000_000):
        feature, owner = _distinct(*features(piece))
        out += np.split(feature.astype(np.int32), np.searchsorted(owner, np.arange(1, len(piece))))
    return pd.Series(out, dtype=object)


def _learner(state, alpha: float, beta: float, l1: float, l2: float):
    """One round over the shards of a partition, each from the common state."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = pd.concat([pd.DataFrame({"k": [], "y": [], "at": [], "shard": []}), *batches], ignore_index=True)
        for _, part in there.groupby("shard"):
            z, n = (x.copy() for x in state.value)
            own = Ftrl(z, n, alpha, beta, l1, l2)
            part = part.sort_values("k").sample(frac=1, random_state=5)
            for at, y in zip(part["at"], part["y"], strict=True):
                own.learn(np.append(np.asarray(at, np.int64), 1 << BITS), y)
            at = np.flatnonzero((z != 0) | (n != 0))
            yield pd.DataFrame({"f": at, "z": z[at], "n": n[at]})

    return learn


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 4, held_out: int = 2, max_examples: int = 20_000, shards: int = 4, rounds: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0) -> np.ndarray:
    """The weights of the 2**18 features and, last, the bias. `max_examples` bounds the sample that is learnt from."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_fold(F.col(key), folds) != held_out)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sample = marked.orderBy(F.xxhash64("k"), "k").limit(max_examples)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(sample), "k").groupBy("k").agg(F.first("y").alias("y"), F.min("t").alias("t"))
    rows = rows.select("k", "y", F.pandas_udf(_held, "array<int>")("t").alias("at"), F.pmod(F.xxhash64("k", F.lit(1)), F.lit(shards)).alias("shard"))
    rows = checkpointed(rows.repartition(shards, "shard"))  # a shard stays in one partition, so the rounds need no shuffle of it
    used = max(1, rows.select("shard").distinct().count())
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    spark = docs.sparkSession
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))
        mixed = rows.mapInPandas(_learner(state, alpha, beta, l1, l2), "f long, z double, n double").groupBy("f").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
        learnt = mixed.toArrow().to_pandas()
        z, n = np.zeros_like(z), np.zeros_like(n)
        z[learnt.f], n[learnt.f] = learnt.z / used, learnt.n / used
    return Ftrl(z, n, alpha, beta, l1, l2).weights(np.arange(len(z))).astype(np.float32)


def score(text: Column, weights) -> Column:
    """Probability of the toxic label, by broadcast weights."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = weights.value
        for batch in batches:
            out = []
            for piece in pieces(batch, 2_000_000):
                feature, owner = features(piece)
                counts = w[feature] != 0
                feature, owner = _distinct(feature[counts], owner[counts])
                out.append(1 / (1 + np.exp(-np.clip(np.bincount(owner, w[feature], len(piece)) + w[-1], -30, 30))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return scored.asNondeterministic()(text)


def judge(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with a double column `toxicity` (or a longer name)."""
    return docs.withColumn(fresh(docs, "toxicity"), score(F.col(text), docs.sparkSession.sparkContext.broadcast(weights)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
