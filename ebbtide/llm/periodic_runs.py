"""Periodic runs of words: block matching at power-of-two scales, seeds extended both ways.

Words are split at ASCII white space and numbered from 0. A run is a stretch of words with smallest period q, at least
max(`least`, `times` * q) long (times 4 or more), that no neighbouring word extends keeping the period.

For a scale s = 2**k the document is cut into aligned blocks of s words; the blocks are the integer-sequence keys of an
Aho-Corasick automaton, and the whole document is searched for them. An occurrence s to 2s - 1 words after a block is a seed.
A run [a, e) of period s <= q < 2s has one: its first aligned block starts before a + s, and the copy q further ends before
a + 2s + q < a + 4q <= e. A seed is extended word by word in both directions, and the extent is cut to its smallest period,
a divisor of the distance since the extent holds it four times. Only blocks that can seed are keys: every word of a run
comes again within q < 2s words, so a block with a word that doesn't is left out. Where a block lies in a run found at a
smaller scale, only what reaches beyond that run is searched: within it a seed's distance is a multiple of the run's period,
which gives that run again. Neither leaves out a run. A place gives one seed a scale at most.

A word is dropped if a run holds it after the run's first q words; the words left are joined by one space. Documents are
independent, so there is no shuffle.

Edge cases: null, empty and blank texts have no word, no run and an empty collapsed text. Texts of any length are searched
whole, one at a time. Equal rows give equal results; an empty table gives no rows. Other columns are passed on, whatever their
names. A null key is a document like any other (the query plants nothing in it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import table
from ebbtide.llm.text import fresh

FOUND = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _agreement(w: np.ndarray, at: int, d: int, step: int) -> int:
    """The first place from `at` on, in direction step, whose word differs from the one d further on, or the end."""
    end = len(w) - d if step > 0 else -1
    size = 32
    while at != end:
        much = min(size, abs(end - at))
        a, b = (at, at + much) if step > 0 else (at - much + 1, at + 1)
        differ = w[a:b] != w[a + d : b + d]
        if differ.any():
            return a + int(differ.argmax()) if step > 0 else b - 1 - int(differ[::-1].argmax())
        at, size = at + step * much, min(2 * size, 1 << 18)
    return end


def _smallest_period(w: np.ndarray, a: int, e: int, d: int) -> int:
    """Of a stretch that has period d several times over."""
    p, rest, f = d, d, 2
    while rest > 1:
        f = f if f * f <= rest else rest
        if rest % f:
            f += 1
            continue
        rest //= f
        if np.array_equal(w[a : e - p // f], w[a + p // f : e]):
            p //= f
    return p


def _next_occurrence(w: np.ndarray) -> np.ndarray:
    """How far on each word comes again; beyond the document if it doesn't."""
    order = np.argsort(w, kind="stable")
    gap = np.full(len(w), len(w), np.int64)
    same = w[order[1:]] == w[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _seeds(text: tuple, start: np.ndarray, windows: list[list[int]], s: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of the occurrences in these windows of a block of s words from `start` at a distance of s to 2s - 1."""
    keys: dict[tuple, int] = {}
    held = np.full(len(text) // s + 2, -1, np.int64)
    for b in start.tolist():
        held[b // s] = keys.setdefault(text[b : b + s], len(keys))
    search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, number in keys.items():
        search.add_word(key, number)
    search.make_automaton()
    met = np.fromiter((x for lo, hi in windows for e, number in search.iter(text[lo:hi]) for x in (lo + e, number)), np.int64).reshape(-1, 2)
    at = met[:, 0] - s + 1
    block = at // s - 1  # the only one from which the distance fits the scale
    fits = (block >= 0) & (held[block] == met[:, 1])
    return block[fits] * s, (at - block * s)[fits]


def runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if times < 4:
        raise ValueError("blocks seed runs that hold their period four times or more")
    ids: dict = {}
    text = tuple([ids.setdefault(x, len(ids)) for x in words])
    w, found, s = np.array(text, np.int64), {}, 1
    again = _next_occurrence(w)
    inside, ends, periods = np.full(len(w), -1), [], []  # for each place a run that holds it, by number, if there is any
    while times * s <= len(w):
        blocks = len(w) // s
        able = again[: blocks * s].reshape(blocks, s).max(axis=1) < 2 * s
        start = np.flatnonzero(able) * s
        lo, hi = start + s, np.minimum(start + 3 * s - 1, len(w))
        if ends:
            run, end = inside[start], np.array(ends)[inside[start]]
            lo = np.where((run >= 0) & (np.array(periods)[run] <= s) & (end >= lo), np.maximum(lo, end - s + 1), lo)
        start, lo, hi = (x[hi - lo >= s] for x in (start, lo, hi))
        if len(start):
            windows: list[list[int]] = []
            for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                if windows and windows[-1][0] <= x <= windows[-1][1]:
                    windows[-1][1] = max(y, windows[-1][1])
                else:
                    windows.append([x, y])
            at, far = _seeds(text, start, windows, s)
            if ends:
                run = inside[at]
                known = (run >= 0) & (far % np.array(periods)[run] == 0) & (at + far + s <= np.array(ends)[run])
                at, far = at[~known], far[~known]
            done: dict[int, int] = {}
            for b, d in zip(at.tolist(), far.tolist(), strict=True):
                if b < done.get(d, 0):
                    continue
                a, last = _agreement(w, b, d, -1) + 1, _agreement(w, b + s, d, 1)
                done[d], e = last, last + d
                if e - a >= times * d:
                    q = _smallest_period(w, a, e, d)
                    if e - a >= max(least, times * q) and (a, q) not in found:
                        found[a, q] = (a, e - a, q)
                        inside[a:e] = len(ends)
                        ends.append(e)
                        periods.append(q)
        s *= 2
    return sorted(found.values())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def collapse(docs: DataFrame, text: str = "text", key: str = "doc_id", rewrite: Callable[[object, list], list] | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """docs with a struct column `periodic` (or a longer name) of `runs` and `collapsed`. rewrite: of a key and its words, before the search."""

    @F.pandas_udf(FOUND)
    def searched(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            out = []
            for k, t in zip(keys, texts, strict=True):
                words = t.encode().split() if isinstance(t, str) else []
                words = rewrite(k, words) if rewrite else words
                found = runs(words, least, times)
                left = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()] if found else words
                out.append(([dict(zip(("start", "length", "period"), x, strict=True)) for x in found], b" ".join(left).decode()))
            yield pd.DataFrame(out, columns=["runs", "collapsed"])

    return docs.withColumn(fresh(docs, "periodic"), searched.asNondeterministic()(F.col(key).cast("string"), F.col(text)))


def planted(key: str | None, words: list) -> list:
    """Every tenth document, by crc32 of its id, made periodic from some word on."""
    h = crc32(key.encode()) if isinstance(key, str) else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    greatest = "aggregate(periodic.runs, cast(null as struct<start:long,length:long,period:long>), (m, x) -> if(m is null or x.length * m.period > m.length * x.period, x, m))"
    listed = "array_join(transform(periodic.runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')"
    told = found.select("doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), F.expr(greatest).alias("best"), F.expr(f"sha2({listed}, 256)").alias("runs_sha256"), F.expr("sha2(periodic.collapsed, 256)").alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
