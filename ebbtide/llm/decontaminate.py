r"""Benchmark decontamination by suffix arrays of the training words.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. Texts stay where they are read: each Arrow piece of about
SHARD characters is a shard. All its suffixes are sorted (prefix doubling, to the depth of the longest benchmark item, which
is all that a search can tell apart), and every suffix of every benchmark item is binary-searched in that array. The places
found give, with the common prefixes of the neighbours, the longest verbatim match at every word of the shard, of any
length. A second pair of searches, by the first `width` words, gives the range of all occurrences of each window: `width`
consecutive words of an item; an item of fewer words, but not none, is one window.

The benchmark is a stated set of queries. It is taken in blocks of BLOCK characters (and one item at least), one pass over
the texts for each: a block, and no more, is on the driver and in a worker at once, and what a pass finds is written before
the next begins. A benchmark of up to BLOCK characters takes one pass, without any shuffle.

Edge cases: null and wordless texts have no words and no hit. Repeated benchmark rows count once for an item_id; a null
item_id hits words but is no item. An empty benchmark contaminates nothing; an empty table gives no rows. Repeated rows are
judged alike. A text is never cut: one longer than SHARD is a shard of its own. Of equally long matches the first in the
text is told, with one of the items that hold it. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import checkpointed, table
from ebbtide.llm.text import fresh, pieces

WIDTH, SHARD, BLOCK = 13, 4_000_000, 8_000_000
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "n_words long, spans array<struct<start: int, end: int>>, items array<string>, longest_match long, longest_item string, longest_at long"


def words(text: str) -> list[bytes]:
    return text.encode().translate(KEEP).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids, sorted by the `depth` (or more) ids from there on."""
    rank, size = ids.astype(np.int64), 1
    while True:
        later = np.zeros_like(rank)
        later[:-size] = rank[size:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + later
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        size *= 2
        if size >= depth or size >= len(ids) or rank[order[-1]] == len(ids) - 1:
            return order


def common(a: np.ndarray, at: np.ndarray, b: np.ndarray, there: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many ids from a's places `at` and b's places `there` agree, `most` at most. Both end in an id that the other lacks."""
    n, going = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(going):
        k = n[going]
        going = going[(k < most[going]) & (a[at[going] + k] == b[there[going] + k])]
        n[going] += 1
    return n


def bound(ids: np.ndarray, array: np.ndarray, tests: np.ndarray, places: np.ndarray, sizes: np.ndarray, after: bool = False) -> np.ndarray:
    """Binary search: for each test (the `sizes` ids from `places`), how many suffixes come before it; `after`: or begin with it."""
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(array))
    going = np.arange(len(places))
    while len(going := going[low[going] < high[going]]):
        middle = (low[going] + high[going]) // 2
        at, p, most = array[middle], places[going], sizes[going]
        n = common(ids, at, tests, p, most)
        whole = n == most
        right = np.where(whole, after, ids[at + n] < tests[p + n])
        low[going[right]] = middle[right] + 1
        high[going[~right]] = middle[~right]
    return low


def _spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (many of them) of each."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start, many)


class Tests:
    """All suffixes of some benchmark items, sorted, and their distinct windows."""

    def __init__(self, rows: list[tuple[str | None, str]], width: int = WIDTH):
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in rows if item is not None})
        name = {item: i for i, item in enumerate(self.names)}
        flat, ends, owner, windows = [], [], [], []
        for item, text in rows:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            start, size = len(flat), min(width, len(own))
            flat += own
            ends += [len(flat)] * len(own)
            owner += [name.get(item, -1)] * len(own)
            windows += [(p, size) for p in range(start, start + len(own) - size + 1) if own]
        self.ids = np.array([*flat, 0], np.int64)
        self.room = np.array(ends, np.int64) - np.arange(len(flat))
        self.owner = np.array(owner, np.int64)
        self.depth = int(self.room.max(initial=1))
        # one blank after each item, for sorting alone: a suffix ends with its item
        cut = np.flatnonzero(self.room == 1)
        spaced = np.insert(self.ids[:-1], cut + 1, 0)
        array = suffix_array(spaced, self.depth) if len(flat) else np.zeros(0, np.int64)
        back = np.cumsum(spaced > 0) - 1
        self.array = back[array[spaced[array] > 0]]
        at, size = np.array(windows, np.int64).reshape(-1, 2).T
        rank = np.zeros(len(flat), np.int64)  # of equal windows one stands for all
        rank[self.array] = np.arange(len(flat))
        order = np.lexsort((rank[at], size))
        at, size = at[order], size[order]
        same = np.zeros(len(at), bool)
        same[1:] = (size[1:] == size[:-1]) & (common(self.ids, at[1:], self.ids, at[:-1], size[1:]) == size[1:])
        group = np.cumsum(~same) - 1
        self.window, self.size = at[~same], size[~same]
        pairs = np.unique(np.stack((group, self.owner[at])), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        self.items = pairs[1]  # of each window, one after the other
        self.many = np.bincount(pairs[0], minlength=len(self.window)).astype(np.int64)
        self.first = np.cumsum(self.many) - self.many

    def examine(self, texts: list[str]) -> list[tuple]:
        """A row of FOUND for each text of a shard."""
        owned = [words(t) for t in texts]
        sizes = np.fromiter(map(len, owned), np.int64, len(owned))
        if not len(self.array) or not len(texts):
            return [(n, [], [], 0, "", 0) for n in sizes.tolist()]
        number = defaultdict(count(len(self.number) + 1).__next__, self.number)  # further words follow those of the tests
        ids = np.fromiter((number[w] for own in owned for w in (*own, b"")), np.int64, int(sizes.sum()) + len(sizes))
        starts = np.cumsum(sizes + 1) - sizes - 1
        ids[starts + sizes] = 0  # a blank after each text
        array = suffix_array(ids, self.depth)
        spans, items = self._windows(ids, array, starts, sizes)
        return list(zip(sizes.tolist(), spans, items, *self._longest(ids, array, starts, sizes), strict=True))

    def _windows(self, ids: np.ndarray, array: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[list, list]:
        """Spans of words inside window occurrences, and the items of the windows, of each text."""
        low = bound(ids, array, self.ids, self.window, self.size)
        many = bound(ids, array, self.ids, self.window, self.size, after=True) - low
        window = np.repeat(np.arange(len(many)), many)
        at = array[_spread(low, many)]
        edges = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + self.size[window], -1)
        covered = np.concatenate(([0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0]))
        change = np.diff(covered)
        begin, end = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
        spans: list = [[] for _ in starts]
        owner = np.searchsorted(starts, begin, "right") - 1
        for i, a, b in zip(owner.tolist(), (begin - starts[owner]).tolist(), (end - starts[owner]).tolist(), strict=True):
            spans[i].append({"start": a, "end": b})
        pairs = np.unique((np.searchsorted(starts, at, "right") - 1) * np.int64(len(many)) + window)
        text, window = pairs // max(len(many), 1), pairs % max(len(many), 1)
        found = np.unique(np.repeat(text, self.many[window]) * np.int64(len(self.names) + 1) + self.items[_spread(self.first[window], self.many[window])])
        items: list = [[] for _ in starts]
        for i, k in zip((found // (len(self.names) + 1)).tolist(), (found % (len(self.names) + 1)).tolist(), strict=True):
            items[i].append(self.names[k])
        return spans, items

    def _longest(self, ids: np.ndarray, array: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[list, list, list]:
        """The longest match of any length, its item and its first word, of each text."""
        low = bound(ids, array, self.ids, self.array, self.room[self.array])  # of the sorted tests: rises
        shared = np.flatnonzero((ids[array] > 0) & (ids[array] <= len(self.number)))
        at, next_ = array[shared], np.searchsorted(low, shared, "right")
        length, source = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for side in (next_ - 1, next_):
            ok = (side >= 0) & (side < len(low))
            test = self.array[side[ok]]
            n = common(ids, at[ok], self.ids, test, self.room[test])
            more = n > length[at[ok]]
            length[at[ok][more]], source[at[ok][more]] = n[more], test[more]
        best = np.maximum.reduceat(length * np.int64(len(ids)) + (len(ids) - 1 - np.arange(len(ids))), starts)
        n, place = best // len(ids), len(ids) - 1 - best % len(ids)
        owner = self.owner[source[place]]
        return n.tolist(), [self.names[k] if m and k >= 0 else "" for k, m in zip(owner.tolist(), n.tolist(), strict=True)], np.where(n > 0, place - starts, 0).tolist()


_TESTS: list = []


def _tests(rows: list, width: int) -> Tests:
    """One a worker process: the block that is searched now."""
    if not _TESTS or _TESTS[0] is not rows or _TESTS[1] != width:
        _TESTS[:] = rows, width, Tests(rows, width)
    return _TESTS[2]


def searched(text: Column, held, width: int = WIDTH) -> Column:
    """A struct column (FOUND) of a text column; `held` is a broadcast list of (item, text)."""

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tests = _tests(held.value, width)
        names = ["n_words", "spans", "items", "longest_match", "longest_item", "longest_at"]
        for batch in batches:
            yield pd.DataFrame([row for piece in pieces(batch, SHARD) for row in tests.examine(piece)], columns=names)

    return found.asNondeterministic()(text)


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's distinct rows (item, text), in lists of about BLOCK characters; one list at least."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-total // BLOCK))
    for k in range(many):
        own: pa.Table = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k).toArrow()
        yield list(zip(own["item"].to_pylist(), own["text"].to_pylist(), strict=True))


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with a struct column `overlap` (or a longer name): n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_item, longest_at."""
    name, context = fresh(docs, "overlap"), docs.sparkSession.sparkContext
    out, parts = docs, []
    for own in blocks(benchmark):
        if parts:
            out = checkpointed(out)
        parts.append(fresh(out, "found_"))
        out = out.withColumn(parts[-1], searched(F.col(text), context.broadcast(own), width))
    spans = F.array_sort(F.flatten(F.array(*(F.col(p)["spans"] for p in parts))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    more = lambda sofar, x: F.struct((sofar["n"] + F.greatest(x["end"] - F.greatest(x["start"], sofar["to"]), F.lit(0))).alias("n"), F.greatest(x["end"], sofar["to"]).alias("to"))
    hit = F.aggregate(spans, zero, more)["n"]
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(p)["items"] for p in parts)))))
    best = reduce(lambda a, b: F.when(b["longest_match"] > a["longest_match"], b).otherwise(a), (F.col(p) for p in parts))
    n = F.col(parts[0])["n_words"]
    told = F.struct(
        n.alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= n)).alias("contaminated"),
        *(best[c].alias(c) for c in ("longest_match", "longest_item", "longest_at")),
    )
    return out.withColumn(name, told).select(*docs.columns, name)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that are not contaminated."""
    found = match(docs, benchmark)
    return found.where(~F.col(found.columns[-1])["contaminated"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(f"overlap.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, w, least({WIDTH}, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
dw as (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
h as (select doc_id, i, dw.n as n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from h)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, (coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w)) as contaminated
from d left join c using (doc_id) left join t using (doc_id)"""
