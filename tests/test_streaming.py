"""The stream gives every quote what its replay and plain Python give it."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from fareloom.streaming.counters import COUNTS, Counters, counts, observed
from fareloom.streaming.dedup import STATE_STORE, replay, resolve_batch, resolve_stream, resolved_flights, with_event_time

SCHEMA = "flight string, portal string, event_time timestamp, seq long, fare double, status string"
FLAGS = ["new_flight", "new_minimum", "duplicate_price", "out_of_order", "least", "previous_least", "best_portal", "n_portals", "spread", "spread_pct"]
START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*STATE_STORE)


def quotes(n, flights=6, portals=3, seed=5, jitter=0):
    """``n`` quotes in order of arrival; event times are up to ``jitter`` seconds older than that."""
    rng = random.Random(seed)
    at = lambda k: START + dt.timedelta(seconds=10 * k - rng.randrange(jitter + 1))
    return [(f"F{rng.randrange(flights)}", f"p{rng.randrange(portals)}", at(k), k, float(rng.randrange(3000, 3010)), rng.choice([None, "scheduled", "cancelled", "sold_out"])) for k in range(n)]


def feed(spark, tmp_path, rows=None, parts=4):
    rows = quotes(120) if rows is None else rows
    each = -(-len(rows) // parts)
    for part in range(parts):
        spark.createDataFrame(rows[each * part : each * (part + 1)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    return rows, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def plain(rows):
    """The flags of each quote by seq: all portals are looked through for every quote."""
    flights, newest, out = {}, {}, {}
    for flight, portal, at, seq, fare, status in sorted(rows, key=lambda r: r[3]):
        held = flights.setdefault(flight, {})
        best = lambda: min(((f, k, p) for k, (p, (f, s)) in enumerate(held.items()) if f is not None and s not in ("cancelled", "sold_out")), default=None)  # noqa: B023, E731
        portal, before, known = portal or "unknown", best(), held.get(portal or "unknown")
        new_flight = not held
        held[portal] = (fare, status)
        least = best()
        minimum = before is None or (least is not None and least[0] < before[0] - 1e-6)
        same = known is not None and None not in (known[0], fare) and abs(known[0] - fare) < 1e-6
        late = at is not None and newest.get(flight) is not None and at < newest[flight]
        newest[flight] = max([t for t in (newest.get(flight), at) if t is not None], default=None)
        spread = round(max(f for f, _ in held.values() if f is not None) - least[0], 2) if len(held) > 1 and least and least[0] > 0 else None
        out[seq] = (new_flight, minimum, same, late, least and least[0], before and before[0], least and least[2], len(held), spread, spread is not None and round(spread / least[0] * 100, 4) or spread)
    return out


def by_seq(df):
    return {r.seq: tuple(r[c] for c in FLAGS) for r in df.select("seq", *FLAGS).collect()}


def test_stream_replay_and_plain_python_agree_quote_by_quote(spark, tmp_path):
    rows, stream = feed(spark, tmp_path, quotes(160, jitter=200))
    expected = plain(rows)
    assert any(v[3] for v in expected.values()) and any(v[4] is None for v in expected.values())
    assert by_seq(run(resolve_stream(stream), tmp_path, "append", "resolved")) == expected
    for block in (1, 4, 4096):
        assert by_seq(replay(spark.createDataFrame(rows, SCHEMA), ["flight"], "portal", "event_time", "fare", "status", ["seq"], rows=block)) == expected
    batch = {r.flight: (r.fare, r.n_portals, r.spread) for r in resolve_batch(spark.createDataFrame(rows, SCHEMA), ["flight"], "portal", "fare", "status", ["seq"]).collect()}
    last = {flight: expected[seq] for flight, _, _, seq, _, _ in rows}
    assert batch == {f: (v[4], v[7], v[8]) for f, v in last.items()}


def test_an_older_quote_that_arrives_last_counts(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("A", "p", at(0), 1, 100.0, None), ("A", "q", at(100), 2, 120.0, None), ("A", "p", at(50), 3, 80.0, None)]
    rows, stream = feed(spark, tmp_path, rows, 3)
    found = by_seq(run(resolve_stream(stream), tmp_path, "append", "older"))
    assert found[3] == (False, True, False, True, 80.0, 100.0, "p", 2, 40.0, 50.0)


def test_cancelled_and_sold_out_quotes_are_no_minimum(spark):
    """As published: 5000 scheduled, a cancelled 3000, a sold-out 2000, then 4500."""
    rows = [("A", p, None, k, f, s) for k, (p, f, s) in enumerate([("m", 5000.0, "scheduled"), ("e", 3000.0, "cancelled"), ("y", 2000.0, "sold_out"), ("i", 4500.0, "scheduled"), ("i", 4500.0, None), ("i", 5200.0, None)])]
    found = by_seq(replay(spark.createDataFrame(rows, SCHEMA), ["flight"], "portal", "event_time", "fare", "status", ["seq"]))
    assert [found[k][1] for k in range(6)] == [True, False, False, True, False, False]
    assert [found[k][4] for k in range(6)] == [5000.0, 5000.0, 5000.0, 4500.0, 4500.0, 5000.0]
    assert [found[k][8] for k in range(6)] == [None, 0.0, 0.0, 500.0, 500.0, 200.0] and found[4][2] and found[5][6] == "m"


def test_a_flight_with_a_thousand_portals_and_odd_quotes(spark, tmp_path):
    rng = random.Random(9)
    rows = [("H", f"p{rng.randrange(1000)}", START, k, float(rng.randrange(1, 400)), rng.choice([None, None, "cancelled"])) for k in range(2400)]
    rows += [("N", None, None, 2400, 5.0, None), ("N", "unknown", START, 2401, None, None), (None, "p", START, 2402, 1.0, None), (None, "p", START, 2403, 1.0, None), ("N", "a", None, 2404, 0.0, None), ("N", "b", None, 2405, 2.0, None)]
    rows, stream = feed(spark, tmp_path, rows, 2)
    expected = plain(rows)
    assert by_seq(run(resolve_stream(stream), tmp_path, "append", "portals")) == expected
    laid = replay(spark.createDataFrame(rows, SCHEMA).withColumn("least", F.lit("clash")), ["flight"], "portal", "event_time", "fare", "status", ["seq"], rows=256)
    assert laid.columns == [*SCHEMA.replace(",", "").split()[::2], "least", *(c if c != "least" else "_least" for c in ["new_flight", "new_minimum", "duplicate_price", "out_of_order", "least", "previous_least", "best_portal", "n_portals", "most", "spread", "spread_pct"])]
    assert by_seq(laid.drop("least").withColumnRenamed("_least", "least")) == {k: v for k, v in expected.items() if rows[k][0] is not None} | {k: v for k, v in expected.items() if rows[k][0] is None}
    assert replay(spark.createDataFrame([], SCHEMA), ["flight"], "portal", "event_time", "fare", "status", ["seq"]).collect() == []


def test_a_hot_flight_is_replayed_by_several_tasks(spark):
    rows = quotes(3000, flights=1, portals=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = replay(spark.createDataFrame(rows, SCHEMA), ["flight"], "portal", "event_time", "fare", "status", ["seq"], rows=128)
    shares = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 2 and max(shares) < 2000, shares
    assert by_seq(df) == plain(rows)


def test_a_flight_without_quotes_is_forgotten(spark, tmp_path):
    rows = [("A", "p", START, 1, 10.0, None), *(("B", "p", START, k, 10.0, None) for k in (2, 3, 4)), ("A", "q", START, 5, 20.0, None), ("A", "q", START, 6, 20.0, None)]
    rows, stream = feed(spark, tmp_path, rows, 6)
    kept = by_seq(run(resolve_stream(stream), tmp_path, "append", "remembered"))
    gone = by_seq(run(resolve_stream(stream, retention_ms=1), tmp_path, "append", "forgotten"))
    assert kept == plain(rows) and kept[5][7] == 2 and not kept[5][0]
    assert gone[5] == (True, True, False, False, 20.0, None, "q", 1, None, None)


def test_late_quotes_are_dropped_only_if_asked_for(spark, tmp_path):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    batches = [[("A", "p", at(5), 1, 10.0, None)], [("A", "q", at(4, 55), 2, 8.0, None), ("B", "p", at(1), 3, 9.0, None)], [("B", "p", at(0, 50), 4, 7.0, None)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    everything = {r.seq: (r.out_of_order, r.least) for r in run(resolve_stream(stream()), tmp_path, "append", "kept").collect()}
    assert everything == {1: (False, 10.0), 2: (True, 8.0), 3: (False, 9.0), 4: (True, 7.0)}
    some = {r.seq: (r.out_of_order, r.least) for r in run(resolve_stream(stream(), "1 hour"), tmp_path, "append", "dropped").collect()}
    assert some == {1: (False, 10.0), 2: (True, 8.0), 3: (True, 9.0)}


def test_counters_equal_the_replay(spark, tmp_path):
    rows, stream = feed(spark, tmp_path, quotes(80, jitter=100))
    listener = Counters()
    spark.streams.addListener(listener)
    try:
        run(observed(resolve_stream(stream)), tmp_path, "append", "counted")
        for _ in range(100):  # progress is reported after the batch
            if listener.totals["processed"] >= len(rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    twin = replay(spark.createDataFrame(rows, SCHEMA), ["flight"], "portal", "event_time", "fare", "status", ["seq"]).agg(*counts()).first()
    assert listener.totals == {c: twin[c] for c in COUNTS} and twin["processed"] == len(rows) and twin["out_of_order"] > 0
    assert next(iter(listener.rows.values()))["state"] > 0


def test_event_time_is_the_first_known_one(spark):
    rows = [("2024-01-01T10:00:00", "2024-02-01", None), (None, "2024-02-01T08:00:00", "2024-02-01T10:00:00"), ("", None, "1700000000")]
    df = with_event_time(spark.createDataFrame(rows, "b string, d string, a string"), "b", "d", "a")
    assert [r.x for r in df.select(F.date_format("event_time", "yyyy-MM-dd HH:mm").alias("x")).collect()] == ["2024-01-01 10:00", "2024-02-01 08:00", "2023-11-14 22:13"]


def test_updating_table(spark, tmp_path):
    rows, stream = feed(spark, tmp_path)
    table = run(resolved_flights(stream), tmp_path, "complete", "latest")
    expected = {}
    for flight, portal, at, seq, fare, _ in rows:
        expected[flight, portal] = max(expected.get((flight, portal), (at, seq, fare)), (at, seq, fare))
    assert {(r.flight, r.portal): r.fare for r in table.collect()} == {k: v[2] for k, v in expected.items()}


def test_scores_equal_the_batch_window(spark, tmp_path):
    from fareloom.operators.anomaly import rolling_rows
    from fareloom.streaming.anomaly import append_alerts, evaluate_stream

    rows, _ = feed(spark, tmp_path)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).selectExpr("flight AS key", "event_time", "seq", "fare")
    scored = evaluate_stream(stream, 5, "1 hour")
    got = {r.seq: (r.n_base, r.mean and round(r.mean, 6)) for r in run(scored, tmp_path, "append", "scores").collect()}
    twin = rolling_rows(spark.createDataFrame(rows, SCHEMA), ["flight"], "seq", "fare", 5)
    assert got == {r.seq: (r.n_base, r.mean and round(r.mean, 6)) for r in twin.collect()}
    append_alerts(scored, str(tmp_path / "alerts"), str(tmp_path / "alerts-checkpoint"), 1.0).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "alerts")).where("abs(z) < 1").count() == 0
