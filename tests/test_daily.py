"""The stored daily run: repeatable, a day at a time, and unharmed by failed writes."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fareloom.plans import daily
from fareloom.plans.daily import done, run_day
from fareloom.sources.stored import Store

SCHEMA = "route_code string, booking_window string, flight_date date, carrier string, flight_no long, portal string, total_fare double, flight_status string, lead_days int, captured_at timestamp, seq long"
DAY = dt.date(2024, 3, 1)


def days_quotes(spark, days=3):
    rows = []
    for d in range(days):
        day = DAY + dt.timedelta(days=d)
        for k in range(40):
            fare = 4000.0 + 37 * (k % 7) + 100 * d + (9000 if d == 2 and k % 8 == 3 else 0)
            rows.append((["A-B", "B-C"][k % 2], ["T+1", "T+7"][k // 2 % 2], day, ["6E", "AI"][k % 3 % 2], k % 5, ["indigo", "yatra"][k % 4 // 2], fare, "cancelled" if k == 39 else None, [1, 7][k // 2 % 2], dt.datetime.combine(day, dt.time(8)), k))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def base(spark):
    return spark.createDataFrame([("A-B", 4000.0, 3), ("B-C", 4200.0, 1), ("X-Y", 0.0, 5)], "route_code string, base_fare double, weight long")


def content(target):
    return {t: sorted(map(repr, target.read(t, s).collect())) for t, s in daily.TABLES.items()}


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_days_run_twice_give_the_same_rows_and_touch_no_other_day(spark, base, tmp_path):
    target, quotes = Store(spark, str(tmp_path / "store")), days_quotes(spark)
    for d in range(3):
        run_day(target, quotes, DAY + dt.timedelta(days=d), ["seq"], base)
    first, before = content(target), files(tmp_path / "store")
    assert all(first.values()) and target.read("alerts", daily.ALERTS).where("day = '2024-03-03'").count() > 0
    middle = DAY + dt.timedelta(days=1)
    run = run_day(target, quotes, middle, ["seq"], base)
    assert content(target) == first
    after = files(tmp_path / "store")
    assert {p for p in before if f"day={middle}" not in str(p)} == {p for p in after if f"day={middle}" not in str(p)}
    assert all(after[p] == t for p, t in before.items() if f"day={middle}" not in str(p))
    runs = {r.day: r for r in done(target).collect()}
    assert len(runs) == 3 and runs[middle].run_id == run and not any(r.fallback for r in runs.values())
    assert target.read("national", daily.NATIONAL).where(F.col("day") == F.lit(DAY)).first().n_routes == 2


def test_a_failed_run_leaves_the_old_state(spark, base, tmp_path):
    target, quotes = Store(spark, str(tmp_path / "store")), days_quotes(spark, 1)
    run = run_day(target, quotes, DAY, ["seq"], base)
    before, rows = files(tmp_path / "store"), content(target)
    broken = target.read("routes", daily.ROUTES).withColumn("composite", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        target.replace("routes", broken, [DAY])
    bad = quotes.withColumn("total_fare", F.when(F.col("seq") == 7, F.raise_error(F.lit("bad quote")).cast("double")).otherwise(F.col("total_fare")))
    with pytest.raises(Exception, match="bad quote"):
        run_day(target, bad, DAY, ["seq"], base)
    assert files(tmp_path / "store") == before and content(target) == rows and [r.run_id for r in done(target).collect()] == [run]


def test_a_day_without_quotes_falls_back_and_an_empty_feed_empties_it(spark, base, tmp_path):
    target, quotes, later = Store(spark, str(tmp_path / "store")), days_quotes(spark), DAY + dt.timedelta(days=20)
    run_day(target, quotes, later, ["seq"], base, fallback_rows=40)
    assert [(r.day, r.fallback) for r in done(target).collect()] == [(later, True)] and target.read("windows", daily.WINDOWS).count() == 4
    run_day(target, quotes.limit(0), later, ["seq"], base)
    assert not any(content(target).values()) and [r.n_rows for r in done(target).collect()] == [0]


def test_closed_alerts_stay_closed(spark, base, tmp_path):
    target, quotes, last = Store(spark, str(tmp_path / "store")), days_quotes(spark), DAY + dt.timedelta(days=2)
    for d in range(3):
        run_day(target, quotes, DAY + dt.timedelta(days=d), ["seq"], base)
    alerts = target.read("alerts", daily.ALERTS).where(F.col("day") == F.lit(last))
    closed = alerts.orderBy("route_code", "booking_window").limit(1).withColumn("status", F.lit("CLOSED"))
    n = alerts.count()
    target.upsert("alerts", closed, ["route_code", "booking_window", "day"], when=F.col("status") == "OPEN")
    run_day(target, quotes, last, ["seq"], base)
    statuses = [r.status for r in target.read("alerts", daily.ALERTS).where(F.col("day") == F.lit(last)).collect()]
    assert sorted(statuses) == ["CLOSED", *["OPEN"] * (n - 1)]


def test_upserts_and_expiry_of_stored_rows(spark, tmp_path):
    target, schema = Store(spark, str(tmp_path / "store"), "d"), "k int, v string, seen int, d date"
    day = lambda n: DAY + dt.timedelta(days=n)
    rows = spark.createDataFrame([(k, "old", k, day(k % 4)) for k in range(12)], schema)
    target.replace("t", rows, [day(n) for n in range(4)])
    before = files(tmp_path / "store")
    target.upsert("t", spark.createDataFrame([(1, "new", 50, day(1)), (99, "new", 50, day(1)), (5, "kept", 50, day(1))], schema), ["k", "d"], when=F.col("k") != 5)
    got = {r.k: r.v for r in target.read("t", schema).collect()}
    assert got == {k: "old" for k in range(12)} | {1: "new", 99: "new"}
    assert {p for p in before if "d=2024-03-02" not in str(p)} <= set(files(tmp_path / "store"))
    target.expire("t", schema, day(1), F.col("seen") > 40)
    left = {r.k for r in target.read("t", schema).collect()}
    assert left == {k for k in range(12) if k % 4 >= 1 and k != 1}
    target.expire("t", schema, day(9), F.col("seen") < 0)
    assert target.read("t", schema).count() == 0
    target.expire("nothing", schema, day(0))
    assert target.read("nothing", schema).collect() == []
