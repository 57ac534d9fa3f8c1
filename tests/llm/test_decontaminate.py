import hashlib
import random
import re

import numpy as np
import pytest

from ebbtide.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, benchmark, width=13):
    own, hit, items, longest = words(text), set(), set(), 0
    for item, t in benchmark:
        w = words(t)
        n = min(width, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[p : p + n]:
                    hit |= set(range(i, i + n))
                    items |= {str(item)} if item is not None else set()
        for shift in range(-len(w), len(own)):
            run = 0
            for i in range(max(shift, 0), min(shift + len(w), len(own))):
                run = run + 1 if own[i] == w[i - shift] else 0
                longest = max(longest, run)
    return len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own), longest


@pytest.fixture(scope="module")
def case(spark):
    random.seed(12)
    vocabulary = ["alpha", "Beta", "gamma", "élan", "x1", "zeta", "the", "of"]
    benchmark = [(i, " ".join(random.choices(vocabulary, k=n))) for i, n in enumerate([30, 20, 13, 14, 40])] + [(10, "unique-word"), (11, "two words"), (12, ""), (13, None), (14, "the"), (None, "nobody asks this"), (0, "unique-word"), (9, "9 " * 15)]
    docs = []
    for _ in range(80):
        parts = random.choices(vocabulary, k=random.randrange(60))
        if random.random() < 0.6:
            w = words(random.choice(benchmark)[1])
            a = random.randrange(len(w) + 1)
            parts[random.randrange(len(parts) + 1) : 0] = w[a : a + random.randrange(25)]
        docs.append(random.choice([" ", ", ", "-", "\n"]).join(parts).upper() if random.random() < 0.3 else " ".join(parts))
    docs += ["", None, "9 " * 5000 + "end", "beta", "Two WORDS", "nobody asks this now", "two.words", " ".join(benchmark[0][1].split()) + " " + "fill " * 700, "héllo THE"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)] + [(3, docs[3], 1), (None, docs[4], 1)], "doc_id long, text string, overlap int")
    return frame, spark.createDataFrame(benchmark, "item_id long, text string"), benchmark


def test_matches_equal_brute_force(case):
    """Among others the longest match, of any length, and that its item and place hold it."""
    frame, table, benchmark = case
    told = decontaminate.match(frame, table).select("text", "overlap_.*").collect()
    assert len(told) == frame.count()
    for r in told:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest_match) == brute(r.text, benchmark), r.text
        if r.longest_match and r.longest_item:
            match = words(r.text)[r.longest_at : r.longest_at + r.longest_match]
            assert any(f" {' '.join(match)} " in f" {' '.join(words(t))} " for item, t in benchmark if str(item) == r.longest_item)
    assert sum(r.contaminated for r in told) > 20 and any(0 < r.longest_match < 13 for r in told)


def test_suffix_array_is_sorted_whole():
    random.seed(4)
    for size, kinds in ((1, 1), (2, 1), (50, 1), (300, 2), (400, 9)):
        ids = np.array([random.randrange(kinds) for _ in range(size)])
        array = decontaminate.suffix_array(ids, size)
        assert array.tolist() == sorted(range(size), key=lambda i: ids[i:].tolist())


def test_blocks_and_shards_change_nothing(case, monkeypatch):
    """One item a pass, a text or two a shard."""
    frame, table, benchmark = case
    few = frame.where("doc_id % 3 = 0")
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    monkeypatch.setattr(decontaminate, "SHARD", 300)
    assert len(list(decontaminate.blocks(table))) > 3
    told = decontaminate.match(few, table).select("text", "overlap_.*").collect()
    assert len(told) == few.count()
    for r in told:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest_match) == brute(r.text, benchmark), r.text


def test_empty_tables_and_the_kept(case):
    frame, table, benchmark = case
    assert decontaminate.match(frame.where("false"), table).count() == 0
    clean = decontaminate.keep_clean(frame, table.where("false"))
    assert clean.columns == frame.columns and clean.count() == frame.count()
    assert sorted(r.doc_id for r in decontaminate.keep_clean(frame, table).collect() if r.doc_id) == sorted(r.doc_id for r in frame.collect() if r.doc_id and not brute(r.text, benchmark)[4])
