import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ebbtide.llm import graph, simhash
from ebbtide.llm.graph import components


def brute_print(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: list of ints; root index of each."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


TEXTS = ["", None, " \t\n ", "One", "one two", "One two THREE", "one two three", "a b c d e a b c d e", "É x y z É x y", "x" * 50_000, "word " * 3000, "a\x0bb\x0cc d", "a b c d"]


def test_fingerprints():
    got = simhash.fingerprints([t or "" for t in TEXTS]).view(np.uint64).tolist()
    assert got == [brute_print(t) for t in TEXTS]


def test_links_miss_nothing(spark):
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 31, 1 << 63, 1 << 30]
    prints = set(base)
    for p in base:
        for _ in range(12):
            q = p
            for b in random.sample(range(64), random.randrange(1, 5)):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).distinct().collect()}
    expected = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert found == expected and len(expected) > 200


@pytest.mark.parametrize("hub", [100_000, 20])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    random.seed(8)
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(random.randrange(2000, 2100), random.randrange(2000, 2100)) for _ in range(80)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in chain:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def docs(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        words = random.choices(vocabulary, k=200)
        for _ in range(3):
            rows.append(" ".join(words))
            words[random.randrange(200)] = "changed"
    rows += [t for t in TEXTS]
    frame = [(i, t, "en", "s", 1, i) for i, t in enumerate(rows)] + [(None, "alone in its kind and null", "en", "s", 1, 1), (3, rows[3], "en", "s", 1, 1)]
    return spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long, _row int").withColumn("fp", F.lit(1))


def test_near_duplicates_and_kept_rows(spark):
    df = docs(spark)
    rows = df.collect()
    prints = [brute_print(r.text) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    expected = sorted((r.doc_id if r.doc_id is not None else -1, p, least.get(root, -1)) for r, p, root in zip(rows, prints, roots, strict=True))
    got = simhash.near_duplicates(df).na.fill(-1).collect()
    assert sorted((r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in got) == expected
    assert len(set(roots)) < len(set(prints))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(least.get(root, -1) for root in set(roots))
    assert simhash.near_duplicates(df.where("false")).count() == 0 and simhash.keep_one(df.where("false")).count() == 0
    shown = simhash.near_duplicates(df).select(F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f")).collect()
    assert all(len(r.f) == 16 for r in shown)


def test_one_is_kept_of_any_frame(spark, tmp_path):
    """Unions, joins and aggregates have no file and row; a column named _metadata is one like others."""
    df = docs(spark).where("doc_id is not null")
    df.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted(r.doc_id for r in simhash.keep_one(read).collect())
    labels = read.select("doc_id").distinct().withColumn("quality", F.lit(1))
    frames = [read.union(read), read.join(labels, "doc_id", "left"), read.groupBy(*read.columns).agg(F.count("*").alias("many")), read.distinct(), read.withColumn("_metadata", F.lit("x")), read.where("doc_id >= 0").select("text", "doc_id"), df]
    for frame in frames:
        kept = simhash.keep_one(frame)
        assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == want
