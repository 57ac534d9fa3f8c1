import numpy as np
import pytest

from ebbtide.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, links int"


def brute(rows, threshold=0.98):
    """(links, component) by row, over all pairs."""
    able = [r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    units = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if a else None for r, a in zip(rows, able, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if able[i] and able[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], n, least.get(find(i))) for i, (r, n) in enumerate(zip(rows, links, strict=True))]


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(7)
    out = []
    for label in (0, 1, None):
        for _ in range(12):
            center = random.normal(size=32)
            for s in (0, 0, 0.05, 0.1, 0.15, 0.5):
                out.append((center + s * random.normal(size=32)).astype(np.float32).tolist() + [label])
    rows = [(i, x[:-1], x[-1], 1) for i, x in enumerate(out)]
    zero = [0.0] * 32
    rows += [(900, None, 1, 1), (901, zero, 1, 1), (902, zero, 1, 1), (903, [None] + zero[1:], 1, 1), (904, [float("nan")] + zero[1:], 1, 1), (905, [float("inf")] + zero[1:], 1, 1), (906, [], 1, 1), (907, [], 1, 1), (908, [1.0, 2.0], 1, 1), (909, [2.0, 4.0], 1, 1), (910, [2.0, 4.0, 0.0], 1, 1), (911, [3.0], 1, 1), (912, [1.0], 1, 1)]
    return rows + [(None, rows[0][1], 0, 1), (5, rows[5][1], 0, 1)]


def key(x):
    return tuple((v is None, v or 0) for v in x)


def test_recall_and_edges(spark, rows):
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    found, there = sum(r.n_links for r in got), sum(n for _, n, _ in want)
    assert there > 300 and 0.97 * there <= found <= there
    alone = {x[0]: x for x in want if x[1] == 0}
    assert all((r.vec_id, r.n_links, r.component_id) == alone[r.vec_id] for r in got if r.vec_id in alone)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def _toward(random, x, cosine):
    """Unit vectors at the given cosines to the unit vector x."""
    side = random.normal(size=(len(cosine), len(x)))
    side -= side @ x[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    return cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * side


def test_recall_on_planted_pairs_and_clusters(spark):
    """6,000 vectors: 600 pairs just above the threshold, clusters of up to 300, a background without links; none wrong, recall 0.99."""
    random = np.random.default_rng(3)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(random.normal(size=(n, 64)))
    parts = [unit(4200)]
    for x in unit(600):
        parts.append(np.stack([x, *_toward(random, x, random.uniform(0.98, 0.99, 1))]))
    for size in (300, 150, 100, *[5] * 10):
        parts.append(_toward(random, unit(1)[0], random.uniform(0.985, 0.999, size)))
    vectors = np.concatenate(parts).astype(np.float32)
    labels = np.concatenate([np.full(len(p), k % 3) for k, p in enumerate(parts)])
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), int(c), 1) for i, (v, c) in enumerate(zip(vectors, labels, strict=True))], SCHEMA)).collect()}
    got = np.array([found[i] for i in range(len(vectors))])
    wide = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    linked = (wide @ wide.T >= 0.98) & (labels[:, None] == labels)
    want = linked.sum(axis=1) - 1
    assert len(vectors) >= 6000 and (got <= want).all() and got.sum() >= 0.99 * want.sum()
    pairs = want[4200:5400]
    assert pairs.sum() > 1100 and got[4200:5400].sum() >= 0.99 * pairs.sum()  # the hardest ones by themselves


def test_large_buckets_are_tiled(spark, rows, monkeypatch):
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(spark.createDataFrame(rows[:150], SCHEMA)).collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 2)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(spark.createDataFrame(rows[:150], SCHEMA)).collect())) == whole


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
