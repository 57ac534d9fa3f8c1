"""Files: pages as JSON, images, the day of a capture, bank profiles; and the registered queries' names."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ebbtide.functions import dates, web
from ebbtide.operators.portfolio import STORED
from ebbtide.sources import captures
from ebbtide.sources.store import LiveTotals, Portfolio


def line(text, y):
    box = {"x0": 0, "y0": y, "x1": 900, "y1": y + 30.5}
    return {"text": text, "segments": [text], "words": [{"text": w, "confidence": 95, "bbox": box} for w in text.split()], "bbox": box, "confidence": 95}


def test_json_pages(spark, tmp_path):
    for name, lines in (("a", [("Lundi 7 septembre", 100), ("CB X -1,00 €", 200)]), ("b", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps([line(*x) for x in lines]), encoding="utf-8")
    (tmp_path / "c.json").write_text("{not json", encoding="utf-8")
    read = captures.lines_json(spark, str(tmp_path)).orderBy("capture_id", "line_pos").collect()
    assert [(r.capture_id, r.line_pos, r.text, r.unreadable) for r in read] == [("a", 0, "Lundi 7 septembre", False), ("a", 1, "CB X -1,00 €", False), ("c", 0, None, True)]
    assert read[1].words[0].y1 == 230.5


def test_images_by_extension(spark, tmp_path):
    for name in ("a.png", "b.JPG", "noextension", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in captures.images(spark, str(tmp_path)).select("path").collect()) == ["a.png", "b.JPG", "noextension"]


def test_capture_day(spark):
    now = datetime(2026, 10, 5, 12)
    rows = spark.createDataFrame([(datetime(2026, 9, 1, 3),), (datetime(2026, 10, 6),), (datetime(2020, 1, 1),), (None,)], "t timestamp")
    assert [r[0] for r in rows.select(dates.capture_day(F.col("t"), F.lit(now))).collect()] == [date(2026, 9, 1)] + [date(2026, 10, 5)] * 3


def test_profiles_rewrite_only_what_fits(spark):
    rows = spark.createDataFrame([("a", "BANK ONE"), ("a", "x"), ("b", "y")], "capture_id string, text string")
    profile = (lambda df: df.where("text = 'BANK ONE'"), lambda df: df.withColumn("text", F.lower("text")))
    assert sorted(r.text for r in captures.apply_profiles(rows, [profile]).collect()) == ["bank one", "x", "y"]
    assert captures.apply_profiles(rows, []).count() == 3


def test_clicks(spark):
    rows = [(0, False, None, "/a", True), (1, False, None, "/a", False), (0, True, None, "/a", False), (0, False, "_blank", "/a", False), (0, False, "_self", "https://A.example:443/b", True), (0, False, None, "https://b.example/", False), (0, False, None, "//a.example/c", True), (0, False, None, "mailto:x", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, button int, modified boolean, target string, href string, want boolean")
    no = F.lit(False)
    got = df.select("want", web.intercepts_click(F.col("button"), F.col("modified"), no, no, F.col("target"), F.col("href"), F.lit("https://a.example")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_entry_and_registration(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 40
    assert __spark_entry__.entry(spark).columns[:2] == ["import_id", "id"]


def stored(spark):
    from ebbtide.operators.portfolio import STORED

    names = [f.split()[0] for f in STORED.split(", ")]
    return lambda *rows: spark.createDataFrame([(u, *({"id": i, "display_name": d, "updated_at": t, "status": "confirmed", "kind": "subscription", "user_status": "keep", "monthly_equivalent_cents": 100}.get(n) for n in names)) for u, i, d, t in rows], f"user string, {STORED}")


EARLY, LATE = datetime(2026, 1, 1), datetime(2026, 2, 1)


def test_portfolio_parts(spark, tmp_path):
    """A write touches the parts of its rows alone; repeated ids and null scopes are keys like others; emptied parts stay empty."""
    make, saved = stored(spark), Portfolio(spark, str(tmp_path / "p"), "user string")
    saved.add(make(*((f"u{k}", "a", "x", EARLY) for k in range(40)), (None, "a", "old", EARLY), (None, "a", "new", LATE)))
    told = lambda: {(r.user, r.id): r.display_name for r in saved.read().collect()}
    assert len(told()) == 41 and told()[None, "a"] == "new"
    saved.add(make((None, "a", "newer", EARLY), ("u3", "b", "y", EARLY)))
    assert saved.table.numbers() == [0, 1] and 1 <= len(saved.table.changed_parts(0, 1)) <= 2 < len(saved.table.version(0).folders)
    assert len(told()) == 42 and told()[None, "a"] == "newer" and told()["u3", "b"] == "y"
    assert {(r.user, r.id): r.display_name for r in saved.read(0).collect()}[None, "a"] == "new"
    seen = {(r.user, r.id, r.display_name, r.weight) for r in saved.table.changes(0, 1).collect()}
    assert seen == {(None, "a", "new", -1), (None, "a", "newer", 1), ("u3", "b", "y", 1)}
    saved.delete(make((None, "a", "", EARLY)))
    assert len(told()) == 41 and (None, "a") not in told()
    saved.delete(saved.read())
    assert told() == {}
    saved.prune(1, 0)
    assert told() == {} and saved.table.numbers() == [3] and len(list((tmp_path / "p" / "subscriptions" / "data").iterdir())) == 0


def test_two_writers_at_once_lose_no_row(spark, tmp_path):
    """Many threads write to parts they share; and a writer that is overtaken while it works builds only the parts it lost."""
    make, path = stored(spark), str(tmp_path / "p")
    writers = [Portfolio(spark, path, "user string", parts=4) for _ in range(4)]

    def work(w):
        for k in range(3):
            writers[w].add(make((f"u{w}", f"{k}", "x", EARLY), ("shared", f"{w}.{k}", "x", EARLY)))
        writers[w].delete(make((f"u{w}", "0", "", EARLY)))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    saved = writers[0]
    assert sorted((r.user, r.id) for r in saved.read().collect()) == sorted([(f"u{w}", f"{k}") for w in range(4) for k in (1, 2)] + [("shared", f"{w}.{k}") for w in range(4) for k in range(3)])
    assert saved.table.numbers() == list(range(16)), "each write is a version"
    built = []

    def slow(rows, parts):
        built.append(set(parts))
        if len(built) == 1:
            writers[1].add(make(("shared", "late", "x", EARLY)))
        return rows.withColumn("display_name", F.lit("seen"))

    shared = next(iter(saved._touched(make(("shared", "", "", EARLY)))))
    saved.table.commit({0, 1, 2, 3}, slow)
    assert built == [{0, 1, 2, 3}, {shared}] and {r.display_name for r in saved.read().collect()} == {"seen"} and saved.read().where("id = 'late'").count() == 1


def test_a_number_is_written_once_and_an_unclaimed_write_is_not_seen(spark, tmp_path):
    make, saved = stored(spark), Portfolio(spark, str(tmp_path / "p"), "user string")
    found = make(("u", "a", "x", EARLY)).drop("origin", "user_status", "created_at", "updated_at")
    now = F.lit(LATE)
    assert tuple(saved.save_detections(found, now, "stream", 0).first()) == (1, 0)
    assert tuple(saved.save_detections(found, now, "stream", 0).first()) == (0, 0) and saved.table.numbers() == [0]
    assert tuple(saved.save_detections(found.withColumn("id", F.lit("b")), now, "stream", 1).first()) == (1, 0)
    saved.table._write(make(("u", "ghost", "x", EARLY)))  # a job that died before its claim
    assert sorted(r.id for r in saved.read().collect()) == ["a", "b"]
    saved.prune(1)
    assert len(list((tmp_path / "p" / "subscriptions" / "data").iterdir())) == 3, "it may still be claimed"
    saved.prune(1, 0)
    assert len(list((tmp_path / "p" / "subscriptions" / "data").iterdir())) == 1 and saved.read().count() == 2


def test_live_totals_follow_every_version(spark, tmp_path):
    from ebbtide.operators.portfolio import portfolio_totals

    make, saved = stored(spark), Portfolio(spark, str(tmp_path / "p"), "user string")
    live = LiveTotals(saved)
    assert live.catch_up() == -1 and live.read().count() == 0
    counted = lambda: sorted(map(tuple, portfolio_totals(saved.read(), saved.scope).collect()), key=repr)
    told = lambda: sorted(map(tuple, live.read().select(*portfolio_totals(saved.read(), saved.scope).columns).collect()), key=repr)
    saved.add(make(*((f"u{k}", "a", "x", EARLY) for k in range(20)), (None, "a", "x", EARLY)))
    assert live.catch_up() == 0 and told() == counted() and len(told()) == 21
    saved.add(make(("u1", "b", "x", EARLY)))
    saved.delete(make(("u2", "a", "", EARLY), (None, "a", "", EARLY)))
    assert live.catch_up() == 2 and told() == counted() and len(told()) == 19
    assert live.catch_up() == 2 and live.table.numbers() == [0, 1]
    with ThreadPoolExecutor(3) as pool:
        saved.wipe()
        assert set(pool.map(lambda _: LiveTotals(saved).catch_up(), range(3))) == {3}
    assert told() == [] and live.table.numbers() == [0, 1, 2]


def test_calendar_sink(spark, tmp_path):
    """Bytes as they were, any name, whole writes only: one that fails leaves what was there."""
    from ebbtide.sources import calendars

    contents = {"u/1": "BEGIN\r\nEND\r\n", "é ü%2F?": "﻿x\r\n y ", "..": "", "plain": "z" * 100_000, None: "null"}
    rows = spark.createDataFrame(list(contents.items()), "who string, content string")
    calendars.write_calendars(rows.repartition(3), f"file://{tmp_path}/out", "who")
    told = lambda: {r.name: r.content for r in calendars.read_calendars(spark, f"file://{tmp_path}/out").collect()}
    assert {k: v for k, v in told().items() if v} == {k: v for k, v in contents.items() if v}
    one = [p for p in tmp_path.glob("out/*/*/*.ics") if p.stat().st_size == 12]
    assert len(one) == 1 and one[0].read_bytes() == b"BEGIN\r\nEND\r\n"
    fail = F.udf(lambda x: 1 // 0 if x == "plain" else x)
    with pytest.raises(Exception, match="division"):
        calendars.write_calendars(rows.repartition(3).withColumn("content", fail("who")), f"file://{tmp_path}/out", "who")
    assert told()["plain"] == "z" * 100_000 and told()["u/1"] == contents["u/1"]
    calendars.write_calendars(rows.where("who = 'plain'"), f"file://{tmp_path}/out", "who")
    assert told() == {"plain": "z" * 100_000}


def test_totals_are_caught_up_without_pairing_rows(spark, tmp_path, monkeypatch):
    """Sums of changes need no shuffle of whole rows: they are taken before it, and equal a recount."""
    from ebbtide.operators.portfolio import portfolio_totals
    from ebbtide.plans.views import portfolio as saved_rows
    from ebbtide.sources.store import LiveTotals, Portfolio
    from ebbtide.sources.versions import Versions

    saved = Portfolio(spark, f"{tmp_path}/p", "user_id long")
    live, rows = LiveTotals(saved), saved_rows(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(Versions, "changes", None)
    saved.add(rows.limit(300))
    live.catch_up()
    saved.delete(rows.limit(300).where("user_id % 3 = 0"))
    live.catch_up()
    recount = portfolio_totals(saved.read(), ("user_id",))
    assert live.read().select(recount.columns).exceptAll(recount).isEmpty() and live.read().count() == recount.count()


def test_images_are_dealt_over_all_cores(spark):
    """Small images stay in many tasks, whatever Spark makes of their bytes."""
    from ebbtide.plans.queries import QUERIES

    for name in ("prepared_images",):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_calendars_are_read_by_folder(spark, tmp_path):
    """Tasks grow with the folders and not with the files, and a write without a row is an empty frame."""
    from ebbtide.sources import calendars

    rows = spark.range(12_000).select(F.concat(F.lit("u/"), "id").alias("who"), F.concat(F.lit("é"), "id").alias("content"))
    calendars.write_calendars(rows, f"{tmp_path}/out", "who")
    read = calendars.read_calendars(spark, f"{tmp_path}/out")
    assert read.rdd.getNumPartitions() <= calendars.FOLDERS
    assert read.exceptAll(rows.withColumnRenamed("who", "name")).isEmpty() and read.count() == 12_000
    calendars.write_calendars(rows.where("false"), f"{tmp_path}/out", "who")
    assert calendars.read_calendars(spark, f"{tmp_path}/out").isEmpty()


def test_resizing_as_overlaps_would():
    """Means of areas, exactly: against the overlap of every pair of pixels."""
    from fractions import Fraction

    from ebbtide.operators.pixels import resized

    rng = np.random.default_rng(3)
    for w, h, nw, nh in [(1, 1, 3, 2), (3, 2, 6, 4), (5, 4, 3, 2), (7, 3, 4, 5), (2, 9, 5, 1), (6, 6, 6, 6)]:
        image = rng.integers(0, 256, (h, w, 4), np.uint8)
        share = lambda i, x, n, new: max(0, min((i + 1) * n, (x + 1) * new) - max(i * n, x * new))
        expected = [
            int(Fraction(sum(int(image[y, x, c]) * share(i, x, w, nw) * share(j, y, h, nh) for x in range(w) for y in range(h)), w * h) + Fraction(1, 2)) for j in range(nh) for i in range(nw) for c in range(4)
        ]
        assert list(resized(image.tobytes(), w, h, nw, nh)) == expected
    wide = np.zeros((3000, 4000, 4), np.uint8)
    wide[:, 2000:] = 255
    small = np.frombuffer(resized(wide.tobytes(), 4000, 3000, 40, 30), np.uint8).reshape(30, 40, 4)
    assert (small[:, :20] == 0).all() and (small[:, 20:] == 255).all()


def test_scales_as_the_column_says(spark):
    from ebbtide.operators import pixels

    sizes = [(999, 10), (1000, 10), (1, 1), (4000, 3000), (4001, 3000), (720, 30_000)]
    told = spark.createDataFrame(sizes, "w int, h int").select(pixels.choose_scale(F.col("w"), F.col("h"))).collect()
    for (w, h), (scale,) in zip(sizes, told, strict=True):
        if w * h < 1000_000:
            rgba, wide, high, used = pixels._scaled(bytes(4 * w * h), w, h, None)
            assert used == scale and (wide, high) == (int(w * scale + 0.5), int(h * scale + 0.5)) and len(rgba) == 4 * wide * high
    assert pixels._scaled(bytes(4 * 1000), 1000, 1, 0.0001)[1:3] == (1, 1)


def test_files_to_lines(spark, tmp_path):
    """Image files on disk to lines of words: the whole chain, with files that can't be decoded, read or recognised."""
    from ebbtide.sources.photos import prepared_files, read_captures

    def decode(content):
        w, h = content[0], content[1]
        if w == 77:
            raise OSError("no such format")
        return w, h, content[2:]

    def recognise(rgba, width, height):
        assert width != 2 * 13, "unlucky"
        dark = [i for i in range(width) if rgba[4 * i] < 128]
        return [("NOIR", 95, min(dark), 0, max(dark) + 1, height), (" ", 10, 0, 0, 1, 1), ("x", 50, 0, 0, 1, 0)] if dark else []

    def image(w, h, ink):
        return bytes([w, h]) + b"".join(bytes([*[0 if x in ink else 255] * 3, 255]) for _ in range(h) for x in range(w))

    made = {"a": image(10, 2, (3, 4)), "b": image(10, 2, ()), "c": image(10, 2, ())[:-1], "d": image(77, 1, ()), "e": image(13, 1, (2,)), "f": b"", "g": bytes([0, 5]), "h": image(200, 200, range(50))}
    for name, content in made.items():
        (tmp_path / f"{name}.png").write_bytes(content)
    (tmp_path / "notes.txt").write_text("no image")
    files = captures.images(spark, str(tmp_path)).withColumn("capture_id", F.regexp_extract("path", r"([^/]+)\.png$", 1))
    got = read_captures(files, decode, recognise)
    pages = {r.capture_id: r for r in got.pages.collect()}
    assert {k: bool(r.error) for k, r in pages.items()} == dict(zip("abcdegh", (False, False, True, True, True, True, False), strict=True))  # Spark's reader passes over f
    assert "no such format" in pages["d"].error and "unlucky" in pages["e"].error and (pages["a"].width, pages["a"].height, pages["a"].scale) == (20, 4, 2.0)
    assert sorted((r.capture_id, r.text, r.x0, r.x1, r.confidence) for r in got.lines.collect()) == [("a", "NOIR", 6.0, 10.0, 95.0), ("h", "NOIR", 0.0, 100.0, 95.0)]
    assert got.counts.collect() == [(3, 4, 7)]
    none = read_captures(files.where("false"), decode, recognise)
    assert none.pages.count() == none.lines.count() == 0 and none.counts.collect() == [(0, 0, 0)]
    odd = spark.createDataFrame([(1, None, "kept"), (2, bytearray(made["a"]), None)], "capture_id int, content binary, prepared_ string")
    told = {r.capture_id: r for r in prepared_files(odd, decode).collect()}
    assert told[1].prepared.error == "ValueError: no content" and told[1].prepared.pixels is None and told[1].prepared_ == "kept" and len(told[2].prepared.pixels) == 20 * 4 * 4


def test_a_write_shuffles_what_is_saved_and_what_comes_once(spark, tmp_path):
    """Saved and new rows meet where they are written; null keys are keys; a part has no more files than before."""
    ddl = f"user_id string, {STORED}"
    stamp = lambda day: f"timestamp '2026-09-{day:02d} 00:00:00'"
    known = {"user_id": "if(id % 9 = 0, null, cast(id % 9 as string))", "id": "cast(id as string)", "status": "if(id % 2 = 0, 'pending', 'confirmed')", "amount_cents": "id", "source_lines": "array('old')", "created_at": stamp(1), "updated_at": stamp(1)}
    rows = lambda ids, **more: ids.selectExpr(*(f"cast({(known | more).get(f.split()[0], 'null')} as {f.split()[1]}) as {f.split()[0]}" for f in ddl.split(", ")))
    saved, now = Portfolio(spark, str(tmp_path / "p"), "user_id string"), F.lit("2026-10-05 10:00:00").cast("timestamp")
    saved.add(rows(spark.range(400)))
    files = lambda: max(len(list(p.glob("*/*.parquet"))) for p in (tmp_path / "p/subscriptions/data").iterdir())
    assert 0 < files() <= 16 * 8
    held = saved.read()
    for built in (saved._without(held, held), saved._replaced(held, held)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan
    saved.add(rows(spark.range(390, 410), amount_cents="-id"))
    assert tuple(saved.save_detections(rows(spark.range(380, 500), amount_cents="7", source_lines="array('new')"), now).first()) == (90, 15)
    saved.delete(rows(spark.range(0, 500, 7)).select("user_id", "id"))
    amount = lambda n: 7 if n >= 410 or (n >= 380 and n % 2 == 0) else -n if n >= 390 else n
    assert sorted((r.user_id or "", int(r.id), r.amount_cents, len(r.source_lines)) for r in saved.read().collect()) == sorted(
        (str(n % 9) if n % 9 else "", n, amount(n), 2 if 380 <= n < 410 and n % 2 == 0 else 1) for n in range(500) if n % 7
    )
    assert files() <= 16 * 8
