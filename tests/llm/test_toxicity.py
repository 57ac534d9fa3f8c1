import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.core import crc_fold
from ebbtide.llm import toxicity

BAD = ["vile", "awful", "nasty"]


@pytest.fixture(scope="module")
def frames(spark):
    random = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{k}" for k in random.integers(0, 400, 40)]
        toxic = int(random.random() < 0.2)
        if toxic:
            words[int(random.integers(40))] = random.choice(BAD)
            words[int(random.integers(40))] = random.choice(BAD)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 0, toxic))
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "!!!", "x"), (None, "vile", "x"), (3, rows[3][1], "x"), (5003, "w1 " * 60_000 + "vile nasty awful", "x")]
    labels += [(None, 0, 1), (8, 0, None), (9, 0, 0), (9, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(frames):
    docs, labels = frames
    weights = toxicity.fit(docs, labels)
    assert np.count_nonzero(weights) < 5000
    judged = toxicity.judge(docs, weights)
    told = judged.select("doc_id", crc_fold(F.col("doc_id"), 4).alias("fold"), F.col(judged.columns[-1]).alias("s")).collect()
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    held = [(r.s, truth[r.doc_id]) for r in told if r.fold == 2 and r.doc_id in truth]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert len(bad) > 30 and np.mean([s > t for s in bad for t in good]) > 0.97
    by = {r.doc_id: r.s for r in told}
    bias = 1 / (1 + math.exp(-weights[-1]))
    assert all(abs(by[k] - bias) < 1e-6 for k in (5000, 5001, 5002)) and by[5003] > 0.5 and all(0 <= s <= 1 for s in by.values())


def test_gradient_step_by_hand():
    own = toxicity.Ftrl(np.zeros(1 << 18 | 1), np.zeros(1 << 18 | 1), 1.0, 1.0, 0.1, 1.0)
    at = np.array([5, 1 << 18])
    own.learn(at, 1)
    assert np.allclose(own.z[at], -0.5) and np.allclose(own.n[at], 0.25)
    assert np.allclose(own.weights(at), [0.4 / (1 + 0.5 + 1), 0.5 / (1 + 0.5 + 1)])
    own.learn(at, 0)
    w = np.array([0.16, 0.2])
    g = 1 / (1 + np.exp(-w.sum()))
    assert np.allclose(own.z[at], -0.5 + g - (np.sqrt(0.25 + g * g) - 0.5) * w)


def test_whole_model_as_plain_loops_would(spark):
    """Sharded rounds of FTRL-proximal again, one number at a time, against the weights that fit() gives."""
    random = np.random.default_rng(4)
    texts = {i: " ".join([f"w{k}" for k in random.integers(0, 30, 12)] + (["vile thing"] if i % 3 == 0 else [])) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    alpha, beta, l1, l2, rounds, shards, bias = 0.7, 1.0, 0.4, 0.5, 3, 2, 1 << 18
    got = toxicity.fit(docs, labels, shards=shards, rounds=rounds, alpha=alpha, beta=beta, l1=l1, l2=l2)
    told = labels.where(crc_fold(F.col("doc_id"), 4) != 2).select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard")).collect()
    z, n = {}, {}

    def weight(z, n, f):
        s = z.get(f, 0.0)
        kept = s if f == bias else math.copysign(max(abs(s) - l1, 0), s)
        return -kept / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    for _ in range(rounds):
        ends = []
        for shard in range(shards):
            rows = sorted(r.doc_id for r in told if r.shard == shard)
            zs, ns = dict(z), dict(n)
            for i in np.random.RandomState(5).permutation(len(rows)).tolist():
                at = sorted(set(toxicity.features([texts[rows[i]]])[0].tolist())) + [bias]
                w = {f: weight(zs, ns, f) for f in at}
                g = 1 / (1 + math.exp(-sum(w.values()))) - int(rows[i] % 3 == 0)
                for f in at:
                    old = ns.get(f, 0.0)
                    zs[f] = zs.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[f]
                    ns[f] = old + g * g
            ends.append((zs, ns))
        seen = {f for zs, _ in ends for f in zs}
        z, n = ({f: sum(e[k].get(f, 0.0) for e in ends) / shards for f in seen} for k in (0, 1))
    want = np.zeros(bias + 1)
    for f in z:
        want[f] = weight(z, n, f)
    assert np.count_nonzero(got) > 20 and np.allclose(got, want, atol=1e-5)


def test_features_are_words_pairs_and_skips():
    feature, owner = toxicity.features(["A b c", "c", ""])
    assert owner.tolist() == [0, 0, 0, 1, 0, 0, 0] and feature[2] == feature[3]
    assert set(toxicity.features(["a B c"])[0].tolist()) == set(toxicity.features(["A-b_c"])[0].tolist())


def test_nothing_to_learn_and_empty(frames):
    docs, labels = frames
    weights = toxicity.fit(docs, labels.where("false"))
    judged = toxicity.judge(docs, weights)
    assert {r[0] for r in judged.select(judged.columns[-1]).collect()} == {0.5}
    assert toxicity.judge(docs.where("false"), weights).count() == 0
