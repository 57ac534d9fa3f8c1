"""Quality scores: regularised quadratic discriminant over transformed document statistics.

A text is described by eleven statistics: shares of capitals, symbols, full stops and commas, digits and other letters among
its bytes, mean and spread of word lengths, shares of distinct words, word pairs and lines, line ends a word. Shares go
through a logit, lengths through a logarithm, which makes them nearly normal; each is first drawn towards a typical value
with the weight of `EVIDENCE` words, so that short texts aren't outliers.

Each class is a normal density. Its covariance is shrunk twice: towards that of both classes together, with the weight of
`pooled` documents, then towards the diagonal by the share `diagonal`. The score is the logistic of the difference of the
log-densities, from Mahalanobis distances by the classes' Cholesky factors, and of the classes' frequencies. Learning sums
counts, vectors and products over all labelled documents; the sums, a few hundred numbers, are all that reaches the driver.

Edge cases: null and empty texts have the typical statistics. A document with several labels is good if none says otherwise.
Null labels and null ids are never learnt from; of repeated ids every row is. Without a label every score is 0.5; with
labels of one class every score is that class's share, one document of each class added. A text of any length is measured
whole. An empty table gives no rows. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import checkpointed, crc_fold, table
from ebbtide.llm.text import fresh

OTHER, CAPITAL, SMALL, DIGIT, SPACE, LINE, HIGH, STOP = range(8)
EVIDENCE = 8  # words
# What the statistics are drawn towards: shares of capitals, symbols, stops, digits, bytes beyond ASCII; length of words and its variance; distinct words, pairs, lines; line ends a word.
TYPICAL = (0.04, 0.005, 0.02, 0.003, 0.02, 5.0, 9.0, 0.8, 0.97, 0.95, 0.02)
SIZE = len(TYPICAL)


def _kind(c: int) -> int:
    if 65 <= c <= 90:
        return CAPITAL
    if 97 <= c <= 122:
        return SMALL
    if 48 <= c <= 57:
        return DIGIT
    if c == 10:
        return LINE
    if c in b" \t\r\x0b\x0c":
        return SPACE
    return HIGH if c >= 128 else STOP if c in b".," else OTHER


KIND = np.array([_kind(c) for c in range(256)], np.uint8)


def measured(text: str | None) -> list[float]:
    """The transformed statistics of a text."""
    raw = text.encode() if isinstance(text, str) else b""
    count = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=8).tolist()
    words = raw.split()
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in raw.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))

    def share(part: float, whole: float, typical: float, weight: float) -> float:
        p = (part + weight * typical) / (whole + weight)
        return float(np.log(p) - np.log1p(-p))

    letters = count[CAPITAL] + count[SMALL] + count[HIGH]
    shares = [share(count[k], whole, t, 5 * EVIDENCE) for k, whole, t in zip((CAPITAL, OTHER, STOP, DIGIT, HIGH), (letters, size, size, size, size), TYPICAL, strict=False)]
    mean = (lengths.sum() + EVIDENCE * TYPICAL[5]) / (n + EVIDENCE)
    spread = (((lengths - mean) ** 2).sum() + EVIDENCE * TYPICAL[6]) / (n + EVIDENCE)
    kinds = ((len(set(words)), n, TYPICAL[7], EVIDENCE), (pairs, max(n - 1, 0), TYPICAL[8], EVIDENCE), (len(set(lines)), len(lines), TYPICAL[9], 2), (min(count[LINE], n), n, TYPICAL[10], EVIDENCE))
    return [*shares, float(np.log(mean)), float(np.log(spread)) / 2, *(share(*x) for x in kinds)]


def statistics(text: Column) -> Column:
    """array<double> of SIZE transformed statistics."""

    @F.pandas_udf("array<double>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([measured(t) for t in batch], dtype=object)

    return told.asNondeterministic()(text)


@dataclass
class Discriminant:
    """Means, Cholesky factors and log weights (frequency over the square root of the determinant) of the classes 0 and 1."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    offsets: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        log = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            log.append(offset - (z * z).sum(axis=0) / 2)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each class of a partition: count, sums and sums of products, as (y, at, value)."""
    held = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for batch in batches:
        for y, rows in batch.groupby("y"):
            x = np.stack(rows["x"].to_list())
            held[y] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
    y, at = np.nonzero(held)
    yield pd.DataFrame({"y": y, "at": at, "value": held[y, at]})


def fit(rows: DataFrame, pooled: float = 50.0, diagonal: float = 0.02) -> Discriminant | float:
    """The discriminant of rows(x, y) with y 0 or 1; a constant score if a class is missing."""
    told = rows.select("x", F.col("y").cast("int").alias("y")).mapInPandas(_sums, "y int, at int, value double").groupBy("y", "at").agg(F.sum("value").alias("value")).toArrow().to_pandas()
    sums = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    sums[told["y"], told["at"]] = told["value"]
    n = sums[:, 0]
    if not n.all():
        return float((n[1] + 1) / (n.sum() + 2)) if n.any() else 0.5
    means = tuple(sums[k, 1 : 1 + SIZE] / n[k] for k in (0, 1))
    scatter = [sums[k, 1 + SIZE :].reshape(SIZE, SIZE) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    common = (scatter[0] + scatter[1]) / max(n.sum() - 2, 1)
    factors = []
    for k in (0, 1):
        own = (scatter[k] + pooled * common) / (n[k] + pooled)
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(common)) + 1e-6 * np.eye(SIZE)
        factors.append(np.linalg.cholesky((own + own.T) / 2))
    return Discriminant(means, tuple(factors), tuple(float(np.log(n[k] / n.sum()) - np.log(np.diag(factors[k])).sum()) for k in (0, 1)))


def labelled(measures: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(x, y) of the measured documents (key, x) with a label, outside the held-out fold."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_fold(F.col(key), folds) != held_out))
    known = known.groupBy(F.col(key).alias("_k")).agg((F.min(F.col(label).cast("int")) >= 1).cast("int").alias("y"))
    return measures.select(F.col(key).alias("_k"), "x").join(known, "_k").select("x", "y")


def score(x: Column, model: Discriminant | float) -> Column:
    """The probability of the good class, of statistics."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.stack(batch.to_list())) if len(batch) else np.zeros(0))

    return scored(x) if isinstance(model, Discriminant) else F.when(x.isNotNull(), F.lit(model))


def judge(docs: DataFrame, model: Discriminant | float, text: str = "text") -> DataFrame:
    """docs with a double column `quality` (or a longer name)."""
    return docs.withColumn(fresh(docs, "quality"), score(statistics(F.col(text)), model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = checkpointed(table(spark, sf_dir, "documents").select("doc_id", statistics(F.col("text")).alias("x")))  # texts are read once, to learn and to score
    judged = measures.select("doc_id", score(F.col("x"), fit(labelled(measures, table(spark, sf_dir, "labels")))).alias("score"))
    return judged.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
