"""Small operators that no query compares: overlap of heights, saved rows of detections, pending order, header files."""

from datetime import datetime

from pyspark.sql import functions as F

from ebbtide.functions import money, web
from ebbtide.operators import lines, portfolio


def test_overlap_of_heights(spark):
    rows = spark.createDataFrame([(0.0, 10.0, 5.0, 15.0), (0.0, 10.0, 2.0, 4.0), (0.0, 10.0, 10.0, 20.0), (0.0, 10.0, 30.0, 40.0)], "a double, b double, c double, d double")
    assert [r[0] for r in rows.select(lines.overlap_ratio(*map(F.col, "abcd"))).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_detections_as_saved_rows(spark):
    now = F.lit(datetime(2026, 10, 5, 10))
    found = portfolio.as_detected(spark.createDataFrame([("u", "a", 5), ("u", "b", None)], "user string, id string, amount_cents int"))
    saved = portfolio.from_detection(found, now)
    names = [f.split()[0] for f in portfolio.STORED.split(", ")]
    assert saved.columns == ["user", *names] and {(r.origin, r.user_status, r.created_at) for r in saved.collect()} == {("detected", "keep", datetime(2026, 10, 5, 10))}
    merged = portfolio.merge_detections(spark.createDataFrame([], f"user string, {portfolio.STORED}"), found, now, ("user",))
    assert sorted(map(repr, merged.drop("change").collect())) == sorted(map(repr, saved.collect()))


def test_pending_rows_surest_first(spark):
    rows = spark.createDataFrame([("a", "low", 900, 900), ("b", "high", None, 100), ("c", "high", 200, 200), ("d", "medium", 300, 300), ("e", "high", None, 700)], "id string, confidence string, monthly_equivalent_cents long, amount_cents long")
    assert [r.id for r in rows.orderBy(*portfolio.pending_order()).collect()] == ["c", "e", "b", "d", "a"]


def test_amounts_and_headers(spark):
    rows = spark.createDataFrame([("CB X -4,20 €",), ("05/09",), (None,)], "t string")
    assert [bool(r[0]) for r in rows.select(money.has_amount(F.col("t"))).collect()] == [True, False, False]
    told = spark.range(1).select(web.headers_file(F.create_map(F.lit("X-A"), F.lit("1"), F.lit("X-B"), F.lit("2")))).first()[0]
    assert told.splitlines()[0].startswith("/*") and "X-A: 1" in told and "X-B: 2" in told
