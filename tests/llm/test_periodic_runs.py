import hashlib
import time
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import periodic_runs


def brute(words, least=6, times=4):
    """Every period, every maximal stretch, its smallest period by trial."""
    out, n = set(), len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            smallest = next(p for p in range(1, q + 1) if all(words[k] == words[k + p] for k in range(a, e - p)))
            if smallest == q and e - a >= max(least, times * q):
                out.add((a, e - a, q))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 4)), max_size=5))
def test_runs_as_brute_force_finds_them(parts):
    words = []
    for unit, times, cut in parts:
        words += (unit * times)[: max(1, len(unit) * times - cut)]
    assert periodic_runs.runs(words) == brute(words)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_words(letters):
    random = np.random.default_rng(letters)
    for n in (0, 1, 5, 6, 7, 40, 160):
        for _ in range(12):
            words = random.integers(0, letters, n).tolist()
            assert periodic_runs.runs(words) == brute(words)


def test_every_alignment_and_period():
    for q in (1, 2, 3, 5, 8, 11, 16):
        unit = [f"u{i}" for i in range(q)]
        for before in range(0, 18):
            words = [f"a{i}" for i in range(before)] + (unit * 9)[: max(6, 4 * q) + before % 3] + ["z"]
            assert periodic_runs.runs(words) == [(before, max(6, 4 * q) + before % 3, q)]
            assert periodic_runs.runs(words[: before + max(6, 4 * q) - 1]) == []


def test_long_texts_end_soon():
    assert periodic_runs.runs(["a"] * 300_000) == [(0, 300_000, 1)]
    ramp = [str(i) for i in range(4999)]
    assert periodic_runs.runs(ramp * 41) == [(0, 4999 * 41, 4999)]
    hashed = ["x" if i % 7 else "y" for i in range(60_000)]
    began = time.time()
    assert periodic_runs.runs(hashed + ["x"] * 9 + hashed)[0] == (0, 60_004, 7)  # the last y is due at 60,004
    assert time.time() - began < 60


def model(doc_id, text):
    words = (text or "").encode().split()
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *shown, sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_on_edges(spark, tmp_path):
    random = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in random.integers(0, 5 + i % 60, int(random.integers(0, 90)))), "en") for i in range(300)]
    rows += [(None, "a a a a a a a", "x"), (900, None, None), (901, "", "x"), (902, " \t\n ", "x"), (7, rows[7][1], "x"), (903, " é  é é é é é é é é\x00 b", "x"), (904, "no\x0bno\x0cno\rno no no", "x")]
    rows += [(1000 + i, "la " * i + "fin", None) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, periodic string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c.endswith("256")} == {"string"} and {t for c, t in got.dtypes if not c.endswith("256")} == {"bigint"}
    told = sorted(map(tuple, got.collect()), key=repr)
    assert told == sorted((model(i, t) for i, t, _ in rows), key=repr) and sum(r[1] for r in told) > 20


def test_operator_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x y x y x y x y x z", "p")], "doc_id long, text string, periodic string")
    row = periodic_runs.collapse(docs).first()
    assert row.periodic == "p" and [tuple(r) for r in row[-1].runs] == [(0, 9, 2)] and row[-1].collapsed == "x y z"
    assert periodic_runs.collapse(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs(["a"], times=3)
