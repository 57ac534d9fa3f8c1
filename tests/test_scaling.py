"""Sequential steps against the plain loops they stand for, and their time on large inputs."""

import json
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.functions.fuzzy import jaro_winkler
from ebbtide.operators import dedupe, detect, lines
from ebbtide.sources import captures, dictionary


def plain_leaders(keys):
    leaders, joined = [], []
    for key in keys:
        leader = next((x for x in leaders if x == key or (len(key) >= detect.LEAST_KEY and jaro_winkler(x, key) >= detect.SAME_MERCHANT)), None)
        if leader is None:
            leaders.append(leader := key)
        joined.append(leader)
    return joined


def led(keys):
    return detect._leaders(pd.DataFrame({"import_id": "i", "prefix": "label", "key": keys, "first": range(len(keys))}))["leader"].tolist()


def merchants(random, many, letters="ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", kinds=None):
    """Names, and names with a letter or two changed, dropped, added or swapped."""
    base = ["".join(random.choice(list(letters), int(random.integers(3, 22)))) for _ in range(kinds or many // 3)]
    out = list(dict.fromkeys(base))
    while len(out) < many:
        name = list(base[int(random.integers(len(base)))])
        for _ in range(int(random.integers(1, 3))):
            at = int(random.integers(len(name)))
            edit = int(random.integers(4))
            if edit == 0:
                name[at] = str(random.choice(list(letters)))
            elif edit == 1 and len(name) > 3:
                del name[at]
            elif edit == 2:
                name.insert(at, str(random.choice(list(letters))))
            elif at:
                name[at - 1], name[at] = name[at], name[at - 1]
        out.append("".join(name))
    out = list(dict.fromkeys(out))
    random.shuffle(out)
    return out


@pytest.mark.parametrize("letters", ["AB1", "ABCDEFGHIJ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AÉŒ文字a"])
def test_leaders_as_the_plain_loop_finds_them(letters):
    random = np.random.default_rng(len(letters))
    keys = merchants(random, 500, letters)
    assert led(keys) == plain_leaders(keys)
    assert len(set(led(keys))) < len(keys)
    odd = ["", "A", "ABCD", "ABCDE", "ABCDF", "X" * 300, "X" * 299 + "Y", "X" * 600]
    assert led(odd) == plain_leaders(odd)


def test_many_merchants_of_one_import():
    keys = merchants(np.random.default_rng(3), 20_000)
    began = time.time()
    assert len(led(keys)) == len(keys) and time.time() - began < 60


def plain_rows(page):
    tops, bottoms, out = [], [], []
    for y0, y1 in page:
        chosen, most = len(tops), lines.LEAST_OVERLAP
        for k, (a, b) in enumerate(zip(tops, bottoms, strict=True)):
            shared = min(b, y1) - max(a, y0)
            ratio = shared / min(b - a, y1 - y0) if shared > 0 else 0
            if ratio >= most:
                chosen, most = k, ratio
        if chosen == len(tops):
            tops.append(y0)
            bottoms.append(y1)
        else:
            tops[chosen], bottoms[chosen] = min(tops[chosen], y0), max(bottoms[chosen], y1)
        out.append(chosen)
    return out


def swept(page):
    return [r[2] for r in lines._rows_of_page([("p", i, a, b, (a + b) / 2) for i, (a, b) in enumerate(page)])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 120), st.sampled_from([1, 2, 3, 5, 8, 20, 90, 0.5])), max_size=40))
def test_rows_as_the_plain_loop_finds_them(boxes):
    page = sorted(((float(y), float(y + h)) for y, h in boxes), key=sum)
    assert swept(page) == plain_rows(page)


def test_a_long_page_is_swept_soon():
    random = np.random.default_rng(4)
    boxes = [(20.0 * line + up, 20.0 * line + up + 14) for line in range(12_000) for up in random.uniform(-2, 2, 5)]
    boxes += [(0.0, 240_000.0)]  # one word as high as the page, in the middle of it: what follows joins it
    page = sorted(boxes, key=sum)
    began = time.time()
    assert len(set(swept(page))) > 5_000 and time.time() - began < 30
    assert swept(page[:600]) == plain_rows(page[:600])


def test_line_files_in_one_read(spark, tmp_path):
    """A line's place is its place in the file; damaged files have one row; the plan reads the files once."""
    line = lambda text, y: {"text": text, "segments": [text], "words": [{"text": text, "confidence": 90, "bbox": {"x0": 0, "y0": y, "x1": 9, "y1": y + 9.5}}], "bbox": {"x0": 0, "y0": y, "x1": 9, "y1": y + 9.5}, "confidence": 90}
    pages = {f"p{k}": [line(f"{k}.{i}", 10 * i) for i in range(k)] for k in range(6)}
    for name, held in pages.items():
        Path(tmp_path, f"{name}.json").write_text(json.dumps(held, indent=1), encoding="utf-8")
    for name, body in (("cut", json.dumps(pages["p3"])[:40]), ("object", "{}"), ("empty", ""), ("word", "nothing")):
        Path(tmp_path, f"{name}.json").write_text(body, encoding="utf-8")
    read = captures.lines_json(spark, str(tmp_path))
    rows = read.collect()
    assert sorted((r.capture_id, r.line_pos, r.text) for r in rows if not r.unreadable) == sorted((name, i, x["text"]) for name, held in pages.items() for i, x in enumerate(held))
    assert sorted(r.capture_id for r in rows if r.unreadable) == ["cut", "object", "word"] and all(r.text is None for r in rows if r.unreadable)
    assert next(r for r in rows if r.text == "5.4").words[0].y1 == 49.5
    assert read._jdf.queryExecution().executedPlan().toString().count("Scan binaryFile") == 1


def test_leaders_of_imports_across_batches():
    """Imports share a task and its batches; leaders don't pass from one to the next, and none is lost where a batch ends."""
    random = np.random.default_rng(5)
    imports = {("a", "label"): merchants(random, 300), ("a", "store"): ["CINEFLUX"], (None, "label"): merchants(random, 9), (None, "store"): ["CINEFLUXX", "", "AB"], ("b", "label"): ["CINEFLUX", "CINEFLUXX", "AB"]}
    rows = [{"import_id": i, "prefix": p, "key": k} for (i, p), keys in imports.items() for k in keys]
    batches = [pa.RecordBatch.from_pylist(rows[at : at + 7], pa.schema([(c, pa.string()) for c in ("import_id", "prefix", "key")])) for at in range(0, len(rows), 7)]
    found = [x for b in detect._led(batches) for x in b.column("leader").to_pylist()]
    assert found == [x for keys in imports.values() for x in plain_leaders(keys)] and found != [r["key"] for r in rows]


def test_small_imports_are_grouped_by_many_tasks_and_soon(spark):
    """4,000 imports of twelve merchants: no call of Python for each, and no one task for their few bytes."""
    rows = spark.range(48_000).selectExpr("cast(id div 12 as string) as import_id", "id as pos", "concat('label:', chr(cast(65 + id % 12 as int)), 'INEFLUX', id % 3) as route", "true as unknown_merchant")
    out = detect.clustered(rows).groupBy("group_key").count()
    began = time.time()
    assert {r[0]: r[1] for r in out.collect()} == {f"label:{chr(65 + i)}INEFLUX{i % 3}": 4_000 for i in range(12)} and time.time() - began < 15
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "REPARTITION_BY_NUM" in plan


def test_first_captures_as_a_plain_loop_finds_them(spark):
    """Nulls are keys like others; only keys that several captures show are joined, sorted by a hash of them."""
    random = np.random.default_rng(6)
    pick = lambda *values: values[int(random.integers(len(values)))]
    rows = [(pick("a", "b", None), n, pick("s", None), pick("X", "Y", ""), pick(1, 2, None), pick("2025-01-05", None), "debit", pick(0, 0, 0, 1, None)) for n in range(400)]
    rows += [(f"alone {n}", 400 + n, "s", "X", 1, None, "debit", 3) for n in range(50)]
    frame = spark.createDataFrame(rows, "import_id string, pos long, source string, normalized_label string, amount_cents long, date string, direction string, capture_index int")
    first, out = {}, dedupe.first_captures(frame)
    for r in rows:
        first.setdefault((r[0], *r[2:7]), r[7])
    told = {r.pos: r.is_first for r in out.collect()}
    assert told == {r[1]: first[(r[0], *r[2:7])] == r[7] for r in rows} and 50 < sum(told.values()) < len(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and out.columns == [*frame.columns, "is_first"]


def test_few_labels_are_not_a_reason_to_deal_rows(spark):
    """What a few labels say is brought to the rows; rows of intermediaries alone are dealt by their group."""
    rows = spark.range(400).selectExpr("cast(id % 7 as string) as import_id", "id as pos", "elt(1 + id % 4, 'CINEFLUX', 'NETFLIX', 'APPLE.COM BILL', 'ONDEA') as normalized_label", "299 + id % 3 as amount_cents", "if(id % 5 = 0, 'screenshot_store', 'screenshot_bank_debits') as source")
    found = detect.routed(rows, dictionary.services(spark))
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" in plan
    led = detect.clustered(found)
    moved = detect.reconciled(led)
    assert moved.columns == [*(c for c in led.columns if c != "group_key"), "group_key", "moved"] and moved.count() == 400
    lead, seen = {}, {(r.import_id, r.pos): r for r in led.collect()}
    for r in sorted(seen.values(), key=lambda r: r.pos):
        lead.setdefault((r.import_id, r.group_key), r.pos)
    hidden = lambda r: r.group_key.startswith("via:") and r.amount_cents is not None
    listed = {}
    for (i, g), at in sorted(lead.items(), key=lambda x: x[1]):
        for r in seen.values():
            if (r.import_id, r.group_key) == (i, g) and r.source == detect.STORE:
                listed.setdefault((i, r.amount_cents), g)
    assert {(r.import_id, r.pos): r.group_key for r in moved.collect()} == {k: listed.get((r.import_id, r.amount_cents), r.group_key) if hidden(r) else r.group_key for k, r in seen.items()}
    assert moved.where("moved is not null").count() > 0


def test_pages_of_banks_are_read_in_one_pass(spark):
    """Classified and read where their lines were dealt to: one fold, one shuffle of lines, whatever kinds there are; amounts are cut once a text."""
    from test_engine import LINE, page
    from test_recorded_pages import BANK, DEBITS, STORE

    rows = [(f"p{n}", "u", n, *r[3:]) for n, lines in enumerate((BANK, DEBITS, STORE)) for r in page(lines)]
    read = captures.transactions(spark.createDataFrame(rows, LINE))
    assert {r[0]: r[1] for r in read.groupBy("source").count().collect()} == {"screenshot_card_history": 6, "screenshot_bank_debits": 4, "screenshot_store": 1}
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines()]
    assert nodes.count("MapInArrow") == 1 and "MapInPandas" not in nodes and nodes.count("RepartitionByExpression") == 3, nodes  # two are of the pages that may be of a store


def test_one_reading_of_amounts(spark):
    """A single cut of a text tells what the separate functions tell; whole numbers too large for cents have none and end no job."""
    from pyspark.sql import functions as F

    from ebbtide.functions import money

    random = np.random.default_rng(8)
    parts = ["12", "3", ",50", ".05", " ", "€", "EUR", "E", "l", "O", "-", "+", "/", "1 234,50 €", "1O,9l", "CB", " ", "−9,99"]
    texts = ["".join(random.choice(parts, int(random.integers(0, 7)))) for _ in range(2000)] + [None, "", "123456789012345678 €", "12,50 E"]
    t = F.col("t")
    found, last = money.amounts(t), money.last_amount(t)
    apart = F.struct(F.size(found).alias("n"), F.exists(found, lambda a: a["direction"] != "unknown").alias("signed"), F.when(last.isNotNull(), F.struct(*(last[c].alias(c) for c in ("cents", "direction", "text")))).alias("last"), money.without_amounts(t).alias("rest"))
    told = spark.createDataFrame([(x,) for x in texts], "t string").select("t", money.reading(t).alias("once"), F.when(t.isNotNull(), apart).alias("apart")).collect()
    assert [r.once for r in told] == [r.apart for r in told] and sum(r.once.n > 0 for r in told if r.once) > 200
    assert told[-2].once.n == 1 and told[-2].once.last.cents is None and told[-1].once.last.cents == 1250
