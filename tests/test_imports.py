"""Imports that arrive in parts: the same portfolio however the files fall into micro-batches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ebbtide.sources.store import Portfolio
from ebbtide.streaming import imports


def now():
    return F.lit(datetime(2026, 10, 5, 10))


#: import, capture, its lines; two captures of import 1 overlap, one of import 2 can't be read.
PAGES = {
    ("1", 0): ["Lundi 7 septembre", "PRLV SEPA NETFLIX.COM -10,00 €", "PRLV SEPA CINEFLUX -11,99 €"],
    ("1", 1): ["Lundi 7 septembre", "PRLV SEPA CINEFLUX -11,99 €", "PRLV SEPA ONDEA MUSIQUE -9,99 €"],
    ("1", 2): ["Vendredi 7 août", "PRLV SEPA CINEFLUX -11,99 €"],
    ("2", 0): ["Lundi 7 septembre", "CB SPOTIFY -10,99 €"],
    ("2", 1): None,
}
MANY = {"1": 3, "2": 2}


@pytest.fixture(scope="module")
def frames(spark):
    def frame(keys, many=MANY):
        rows = []
        for i, c in keys:
            for k, text in enumerate(PAGES[i, c] or [None]):
                y = 100.0 * (k + 1)
                words = text and [(w, 95.0, 10.0 * j, y, 10.0 * j + 9, y + 30) for j, w in enumerate(text.split())]
                rows.append((i, f"{i}-{c}", c, k, text, text and [text], words, 0.0, y, 900.0, y + 30, 95.0, None, text is None, many.get(i) if k == 0 else None))
        return spark.createDataFrame(rows, imports.LINES).withColumn("reference", F.lit("2026-10-05").cast("date"))

    return frame


def lines_seen(lines):
    """Instead of detection: a row for each import, with all its lines in order, as they were seen together."""
    from ebbtide.operators.portfolio import DETECTED

    order = F.array_sort(F.collect_list(F.struct("capture_index", "line_pos", F.coalesce("text", F.lit("?")).alias("text"))))
    told = {"id": F.lit("all"), "display_name": F.lit("all"), "status": F.lit("pending"), "kind": F.lit("subscription"), "source_lines": F.transform(order, lambda x: x["text"]), "source_transaction_ids": F.array(F.count("*").cast("string"))}
    names = [f.split() for f in DETECTED.split(", ")]
    return lines.groupBy("import_id").agg(*((told[n] if n in told else F.lit(None).cast(kind)).alias(n) for n, kind in names))


def run(spark, frames, folder, batches, files_per_batch=1000, **options):
    saved, told, options = Portfolio(spark, f"{folder}/saved", "import_id string"), imports.Progress(), {"analyse": lines_seen} | options
    spark.streams.addListener(told)
    try:
        runs = []
        for n, files in enumerate(batches):
            for keys in files:
                frames(keys).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            query = imports.merge_stream(imports.line_stream(spark, f"{folder}/in", files_per_batch), saved, f"{folder}/state", now, **options)
            query.awaitTermination()
            runs.append(told.of(query))
    finally:
        spark.streams.removeListener(told)
    return sorted((r.import_id, r.source_transaction_ids, r.source_lines) for r in saved.read().collect()), runs, saved


def test_every_split_gives_the_same_portfolio(spark, frames, tmp_path):
    keys = list(PAGES)
    whole, counts, _ = run(spark, frames, tmp_path / "whole", [[keys]])
    assert whole == [("1", ["8"], sum((PAGES["1", c] for c in range(3)), [])), ("2", ["3"], [*PAGES["2", 0], "?"])] and counts == [{"read": 5, "skipped": 1, "done": 5}]
    for n, split in enumerate([[[[keys[0]], [keys[3]]], [[keys[1], keys[4]]], [[keys[2]]]], [[[keys[4], keys[2]]], [[keys[3], keys[1]], [keys[0]]]]]):
        got, counts, _ = run(spark, frames, tmp_path / f"runs{n}", split)
        assert got == whole and sum(c["read"] for c in counts) == 5 and sum(c["done"] for c in counts) == 5 and counts[0]["done"] < 3
    got, counts, _ = run(spark, frames, tmp_path / "small", [[[k] for k in keys[::-1]]], files_per_batch=1)
    assert got == whole and counts == [{"read": 5, "skipped": 1, "done": 5}]


def test_time_out_and_batches_run_again(spark, frames, tmp_path):
    rows, counts, saved = run(spark, frames, tmp_path, [[[("1", 0)]], [[("2", 0), ("2", 1)]]], wait_seconds=0.001)
    assert [r[0] for r in rows] == ["1", "2"] and rows[0][2] == PAGES["1", 0], "what had come of import 1 was merged when its time was up"
    assert counts[0] == {"read": 1, "skipped": 0, "done": 0} and counts[1] == {"read": 2, "skipped": 1, "done": 3}
    found = lines_seen(frames([("1", 0)]))
    assert tuple(saved.save_detections(found, now(), f"stream {tmp_path}/state", 1).first()) == (0, 0), "a batch that is run again is known"


def test_imports_of_one_user_in_order(spark, frames, tmp_path):
    """Two imports of a user in one batch are two merges: the second refreshes what the first added."""
    PAGES["u/1", 0], PAGES["u/2", 0] = ["Lundi 7 septembre", "CB SPOTIFY -10,99 €"], ["Mercredi 7 octobre", "CB SPOTIFY -12,99 €", "CB NETFLIX.COM -5,99 €"]
    try:
        saved = Portfolio(spark, f"{tmp_path}/saved", "user string")
        frames([("u/1", 0), ("u/2", 0)], {"u/1": 1, "u/2": 1}).coalesce(1).write.parquet(f"{tmp_path}/in")
        imports.merge_stream(imports.line_stream(spark, f"{tmp_path}/in"), saved, f"{tmp_path}/state", now, owner={"user": F.split("import_id", "/")[0]}).awaitTermination()
    finally:
        PAGES.pop(("u/1", 0)), PAGES.pop(("u/2", 0))
    rows = {r.display_name: (r.user, r.amount_cents, len(r.source_lines)) for r in saved.read().collect()}
    assert rows == {"Spotify": ("u", 1299, 2), "Netflix": ("u", 599, 1)}


def test_following_versions(spark, frames, tmp_path):
    saved, seen = Portfolio(spark, f"{tmp_path}/saved", "import_id string"), []
    note = lambda rows, version: seen.append((version, sorted((r.import_id, r.display_name, r.weight) for r in rows.collect())))
    saved.save_detections(lines_seen(frames([("2", 0)])), now())
    imports.follow(saved, note, f"{tmp_path}/state").awaitTermination()
    saved.delete(saved.read())
    saved.save_detections(lines_seen(frames([("1", 2)])), now())
    imports.follow(saved, note, f"{tmp_path}/state").awaitTermination()
    imports.follow(saved, note, f"{tmp_path}/state").awaitTermination()
    assert seen == [(0, [("2", "all", 1)]), (2, [("1", "all", 1), ("2", "all", -1)])]


def test_state_is_held_by_import_and_batch():
    """An import that is whole in one batch writes no state; one in parts writes one value a batch, however many its lines."""
    from pyspark.sql import Row

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def get(self):
            return self.held if self is rows else self.held[-1] if self.held else None

        def exists(self):
            return bool(self.held)

        def update(self, value):
            calls.append("update")
            self.held = [value]

        def appendValue(self, value):
            calls.append("append")
            self.held.append(value)

        def clear(self):
            self.held = []

    rows, many = State(), State()

    class Handle:
        timers = []

        getListState = lambda self, *_: rows
        getMapState = getValueState = lambda self, *_: many
        listTimers = lambda self: iter(self.timers)
        registerTimer = lambda self, at: self.timers.append(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

    class Now:
        getCurrentProcessingTimeInMs = lambda self: 5

    lines = lambda capture, n: [Row(capture=capture, of_captures=2, body=f'{{"n":{i}}}') for i in range(n)]
    held = imports.Assembly(1)
    held.init(Handle())
    given = lambda got: [r.body.count("n") for r in held.handleInputRows(("k",), iter(got), Now())]
    assert given(lines("0", 50) + lines("1", 50)) == [100] and calls == [] and not Handle.timers
    assert given(lines("0", 50)) == [] and calls == ["append", "update"] and Handle.timers == [1005]
    assert given(lines("0", 3) + lines("1", 2)) == [50, 5] and len(calls) == 2 and not Handle.timers and not rows.held and not many.held


def test_runs_over_what_is_there_hold_files(spark, frames, tmp_path):
    """No state and no call of Python for an import: lines that wait lie in the last batches' folders, and the other kind of run is refused."""
    got, counts, _ = run(spark, frames, tmp_path, [[[k] for k in list(PAGES)[::-1]]], files_per_batch=1)
    assert [r[0] for r in got] == ["1", "2"] and counts == [{"read": 5, "skipped": 1, "done": 5}]
    assert not (tmp_path / "state/state").exists() and sorted(p.name for p in (tmp_path / "state/held").iterdir()) == ["3", "4"]
    assert [p.name for p in (tmp_path / "state/held/4").iterdir() if p.is_dir()] == ["_done=true"], "nothing waits any more"
    with pytest.raises(ValueError, match="runs over what is there"):
        imports.merge_stream(imports.line_stream(spark, f"{tmp_path}/in"), Portfolio(spark, f"{tmp_path}/saved", "import_id string"), f"{tmp_path}/state", available_now=False)


def test_a_batch_run_again_keeps_its_decision(spark, frames, tmp_path, monkeypatch):
    """What was held when the batch first ran stays held, though its time is up by now; a capture's number of rows or repeats change nothing."""
    held, clock = imports.Held(spark, str(tmp_path), wait_seconds=10), [1000.0]
    monkeypatch.setattr(imports.time, "time", lambda: clock[0])
    captures = lambda rows: rows and sorted({r.capture_id for r in rows.collect()})
    assert held.taken(frames([("1", 0), ("1", 0)]), 0) is None
    clock[0] += 5
    assert captures(held.taken(frames([("2", 0), ("2", 1)]), 1)) == ["2-0", "2-1"]
    clock[0] += 6
    assert captures(held.taken(frames([("2", 0), ("2", 1)]), 1)) == ["2-0", "2-1"], "import 1 waits as it did"
    assert captures(held.taken(frames([("2", 0)]), 2)) == ["1-0"], "its time is up with the next batch"
    assert captures(held.taken(frames([("2", 1)]), 3)) == ["2-0", "2-1"] and held.taken(frames([]), 4) is None
