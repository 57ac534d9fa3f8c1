import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.core import crc_fold
from ebbtide.llm import quality


@pytest.fixture(scope="module")
def frames(spark):
    """Prose, and four kinds of junk: symbols, capitals, one word again and again, columns."""
    random = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(1200):
        words = ["".join(random.choice(list("etaoinshrdlu"), int(random.integers(1, 10)))) for _ in range(int(random.integers(15, 120)))]
        words = [w if random.random() < 0.6 else str(random.choice(["the", "and", "of", "to"])) for w in words]
        text = " ".join(w + ("." if random.random() < 0.1 else "") for w in words).capitalize()
        good = int(i % 6 != 0)
        if not good:
            text = [" ".join(w + "###" for w in words), text.upper(), " ".join([words[0], words[1]] * 30), "\n".join(f"{w} | {w[::-1]} |" for w in words)][i // 6 % 4]
        rows.append((i, text, 0.5))
        labels.append((i, good, 0))
    rows += [(5000, None, 0.5), (5001, "", 0.5), (5002, "\n\n", 0.5), (None, "Some words.", 0.5), (3, rows[3][1], 0.5), (5003, "These are words of a long text. " * 1000 + "x" * 200_000, 0.5)]
    labels += [(None, 0, 0), (8, None, 0), (9, 0, 0), (9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def measures(docs):
    return docs.select("doc_id", quality.statistics(F.col("text")).alias("x"))


def test_held_out_accuracy_and_edges(frames):
    docs, labels = frames
    model = quality.fit(quality.labelled(measures(docs), labels))
    judged = quality.judge(docs, model)
    assert judged.columns == ["doc_id", "text", "quality", "quality_"]
    told = judged.select("doc_id", crc_fold(F.col("doc_id"), 4).alias("fold"), F.col("quality_").alias("s")).collect()
    held = [(r.s, r.doc_id % 6 != 0) for r in told if r.fold == 2 and r.doc_id < 5000]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(bad) > 30 and np.mean([s > t for s in good for t in bad]) > 0.99
    assert np.mean([s >= 0.7 for s in good]) > 0.97 and np.mean([s < 0.7 for s in bad]) > 0.95
    by = {r.doc_id: r.s for r in told}
    assert by[5000] == by[5001] > 0.5 and all(0 <= s <= 1 for s in by.values())


def test_model_as_plain_loops_would(frames):
    """Sums, shrinkage and densities again, one number at a time, by the explicit inverse."""
    docs, labels = frames
    got = quality.fit(quality.labelled(measures(docs), labels), pooled=30, diagonal=0.1)
    marks = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            marks[r.doc_id] = min(r.quality, marks.get(r.doc_id, 1))
    fold = {r.doc_id: r.f for r in docs.select("doc_id", crc_fold(F.col("doc_id"), 4).alias("f")).collect()}
    data = {0: [], 1: []}
    for r in docs.collect():
        if r.doc_id in marks and fold[r.doc_id] != 2:
            data[marks[r.doc_id]].append(quality.measured(r.text))
    p = quality.SIZE
    mean = {k: [sum(x[i] for x in data[k]) / len(data[k]) for i in range(p)] for k in data}
    scatter = {k: [[sum((x[i] - mean[k][i]) * (x[j] - mean[k][j]) for x in data[k]) for j in range(p)] for i in range(p)] for k in data}
    total = sum(map(len, data.values()))
    common = [[(scatter[0][i][j] + scatter[1][i][j]) / (total - 2) for j in range(p)] for i in range(p)]
    probes = [data[1][0], data[0][0], quality.measured("Hello there, all of you."), quality.measured(None)]
    log = {}
    for k in data:
        own = [[0.9 * (scatter[k][i][j] + 30 * common[i][j]) / (len(data[k]) + 30) + (0.1 * common[i][i] + 1e-6 if i == j else 0) for j in range(p)] for i in range(p)]
        inverse, det = np.linalg.inv(own), np.linalg.slogdet(own)[1]
        log[k] = [math.log(len(data[k]) / total) - det / 2 - sum((x[i] - mean[k][i]) * inverse[i][j] * (x[j] - mean[k][j]) for i in range(p) for j in range(p)) / 2 for x in probes]
    want = [1 / (1 + math.exp(min(500, a - b))) for a, b in zip(log[0], log[1], strict=True)]
    assert np.allclose(got.score(np.array(probes)), want, atol=1e-6)


def test_statistics_by_hand():
    x = quality.measured("Ab, 1é\nAb, 1é\n")
    logit = lambda p: math.log(p / (1 - p))
    assert x[0] == pytest.approx(logit((2 + 40 * 0.04) / (8 + 40)))  # capitals of A b and the two bytes of é, twice
    assert x[3] == pytest.approx(logit((2 + 40 * 0.003) / (16 + 40)))
    assert x[5] == pytest.approx(math.log((12 + 8 * 5) / (4 + 8)))
    assert x[7] == pytest.approx(logit((2 + 8 * 0.8) / (4 + 8))) and x[9] == pytest.approx(logit((1 + 2 * 0.95) / (2 + 2)))
    assert all(map(math.isfinite, quality.measured("\n" * 1000))) and all(map(math.isfinite, quality.measured("A" * 100_000)))


def test_missing_classes_and_empty_tables(frames):
    docs, labels = frames
    asked = measures(docs)
    assert quality.fit(quality.labelled(asked, labels.where("false"))) == 0.5
    one = quality.fit(quality.labelled(asked, labels.where("quality = 1 and doc_id <> 9")))
    assert 0.99 < one < 1 and {r[0] for r in quality.judge(docs, one).select("quality_").collect()} == {one}
    few = quality.fit(quality.labelled(asked, labels.where("doc_id in (0, 1, 3)")))
    assert quality.judge(docs.where("false"), few).count() == 0 and all(0 <= r[0] <= 1 for r in quality.judge(docs, few).select("quality_").collect())


def test_query(spark):
    got = quality.query(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert got.where("score is null or score < 0 or score > 1 or (predicted = 1) <> (score >= 0.7)").isEmpty() and got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    by = {r.doc_id: r.predicted for r in got.where("held_out").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    both = [(by[i], marks[i]) for i in by if i in marks]
    assert np.mean([a == b for a, b in both]) > 0.9
