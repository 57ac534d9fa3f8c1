import math
import re
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import ranked_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, queries, k):
    """Every document scored for every query."""
    held = [(key, Counter(split(t))) for key, t in docs if t is not None and split(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scores = []
        for key, c in held:
            size, score = sum(c.values()), 0
            for term in split(text or ""):
                if c[term]:
                    m = 100 - 25 + 25 * size * n // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (10**9 * c[term] // (1000 * c[term] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, r, key, -low) for r, (low, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    random = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ñ9", "x_y"]
    rank = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(random.choice(vocabulary, n, p=rank / rank.sum()))
    docs = [(i, text(int(random.integers(1, 120)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[5][1]), (None, None), (2000, None), (2001, ""), (2002, "!? _"), (2003, text(30_000)), (2004, "W1, w2;W3")]
    queries = [(i, text(int(random.integers(1, 40)))) for i in range(25)]
    queries += [(50, docs[5][1]), (50, "w1 w1 w300"), (51, None), (52, ""), (53, "never seen"), (None, "w7 W7"), (54, "été ÉTÉ x y"), (55, docs[9][1] + " never seen")]
    return docs, queries


def frames(spark, docs, queries):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string"), spark.createDataFrame([(*q, 1) for q in queries], "item_id long, text string, rank int")


@pytest.mark.parametrize("parts, shard, block, k", [(1, 10**9, 10**9, 20), (6, 3_000, 10**9, 20), (3, 40_000, 500, 3)])
def test_as_brute_force_ranks(spark, tables, parts, shard, block, k):
    docs, queries = frames(spark, *tables)
    got = ranked_search.ranked(docs.repartition(parts), queries, k, shard=shard, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(*tables, k)


def test_blocks_are_skipped(tables):
    """On lists of many blocks most stay compressed, with the same answers."""
    random = np.random.default_rng(1)
    sizes = np.concatenate([np.full(20_000, 400), np.full(60, 20)])
    n = len(sizes)
    common, rare = np.arange(n), np.sort(random.choice(n, 70, replace=False))
    tf = np.concatenate([random.integers(1, 3, n), np.ones(70, np.int64)])
    row = ranked_search._shard(list(range(n)), sizes, np.concatenate([np.zeros(n, np.int64), np.ones(70, np.int64)]), np.concatenate([common, rare]), tf)
    held = type("Row", (), {c: v if c in ("packed", "keys", "documents", "terms") else np.asarray(v) for c, v in row.items()})
    shard, best = ranked_search.Shard(held, n, int(sizes.sum())), []
    ranked_search.search(shard, [(0, 40), (1, 7000)], best, 20)
    lifts = ranked_search.impact(tf, np.concatenate([sizes, sizes[rare]]), n, int(sizes.sum()))
    scores = 40 * lifts[:n]
    scores[rare] += 7000 * lifts[n:]
    want = sorted((-int(s), False, i) for i, s in enumerate(scores))[:20]
    assert best == want and len(shard.open) < len(shard.first) * 0.6


def test_bit_fields():
    for values in ([], [0], [0, 0, 0], [1], [5, 0, 7, 1], [2**40, 3], list(range(127))):
        data = ranked_search.pack(np.array(values, np.int64))
        got, taken = ranked_search.unpack(data + b"rest", len(values))
        assert got.tolist() == values and taken == len(data)


def test_empty_tables_and_text_keys(spark):
    docs, queries = frames(spark, [(1, "a b")], [(7, "a")])
    assert ranked_search.ranked(docs.where("false"), queries).count() == 0 == ranked_search.ranked(docs, queries.where("false")).count()
    named = spark.createDataFrame([("é", "q r"), ("z", "q r"), ("b", "s")], "doc_id string, text string")
    asked = spark.createDataFrame([("i", "q"), ("j", "R q")], "item_id string, text string")
    got = sorted(map(tuple, ranked_search.ranked(named, asked).select("item_id", "rank", "doc_id").collect()))
    assert got == [("i", 1, "z"), ("i", 2, "é"), ("j", 1, "z"), ("j", 2, "é")]
