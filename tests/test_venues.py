"""The stream of two operators ends a micro-batch where the batch twin ends on all quotes so far."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from fareloom.operators.arbitrage import is_direct
from fareloom.streaming.dedup import STATE_STORE
from fareloom.streaming.venues import venue_stream, venues_batch

SCHEMA = "flight string, portal string, direct boolean, event_time timestamp, seq long, fare double, status string"
SHOWN = ["n_portals", "least", "most", "spread", "spread_pct", "direct_fare", "direct_portal", "agency_fare", "agency_portal", "gap", "percent", "buy_at", "sell_at", "direction"]


def feed(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name):
    """The rows of each micro-batch."""
    seen = {}

    def keep(batch, number):
        seen[number] = batch.collect()

    query = df.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return [seen[n] for n in sorted(seen)]


def shown(rows):
    return {r.flight: tuple(r[c] for c in SHOWN) for r in rows}


def twin(spark, rows):
    return shown(venues_batch(spark.createDataFrame(rows, SCHEMA), ["flight"], "portal", "direct", "fare", "status", ["seq"]).collect())


def test_stream_equals_its_twin_at_every_batch(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    portals = {"indigo": True, "air_india": True, "yatra": False, "ixigo": False, "odd": None, None: False}
    rows = []
    for k in range(150):
        portal = rng.choice(list(portals))
        rows.append((rng.choice(["hot", "hot", "hot", "A", "B", None]), portal, portals[portal], start, k, rng.choice([None, 0.0, -5.0, *(float(f) for f in range(100, 106))]), rng.choice([None, None, "scheduled", "cancelled", "sold_out"])))
    rows += [("lone", "yatra", False, None, 150, 9.0, None), ("none", "yatra", False, None, 151, None, "cancelled"), ("tie", "b", True, None, 152, 7.0, None), ("tie", "a", True, None, 153, 7.0, None), ("tie", "c", False, None, 154, 7.0, None)]
    batches = [rows[:50], rows[50:100], rows[100:], rows[100:]]  # the last one repeats: nothing changes
    found = run(venue_stream(feed(spark, tmp_path, batches)), tmp_path, "venues")
    found = [b for b in found if b]
    assert len(found) in (3, 4)
    current, last = {}, {}
    for number, batch in enumerate(found[:3]):
        assert len({r.flight for r in batch}) == len(batch)  # a row a flight
        current |= shown(batch)
        assert current == twin(spark, rows[: [50, 100, 155][number]])
        last |= {r.flight: r.at for r in batch}
    assert current["tie"][6] == "a" and current["tie"][-1] == "parity" and current["lone"][9] is None and current["none"][1] is None
    if len(found) == 4:  # within the repeated batch only quotes that another one of it replaced can come up again
        assert current | shown(found[3]) == twin(spark, rows)


def test_forgotten_offers_are_withdrawn(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    quote = lambda flight, portal, own, seq, fare: (flight, portal, own, None, seq, fare, None)
    batches = [[quote("A", "own", True, 1, 10.0), quote("A", "shop", False, 2, 12.0)], [quote("B", "own", True, 3, 5.0)], [quote("A", "shop", False, 4, 11.0)], [quote("B", "own", True, 5, 5.0)], [quote("B", "own", True, 6, 6.0)]]
    stream = feed(spark, tmp_path, batches)
    kept = [shown(b) for b in run(venue_stream(stream), tmp_path, "kept") if b]
    assert kept[0]["A"][9] == 2.0 and [b["A"][9] for b in kept if "A" in b] == [2.0, 1.0]
    assert kept[-1] == {"B": (1, 6.0, 6.0, None, None, 6.0, "own", *[None] * 7)}
    gone = [shown(b) for b in run(venue_stream(stream, retention_ms=1), tmp_path, "gone") if b]
    states = [b["A"] for b in gone if "A" in b]
    # A's own portal is forgotten when its shop quotes again, the shop two batches later
    assert [s[:2] for s in states] == [(2, 10.0), (1, 11.0), (0, None)]
    assert states[1][5] is None and states[1][7] == 11.0 and states[1][9] is None


def test_own_portals_by_name_brand_and_code(spark):
    rows = [("indigo", "AI", True), (" IndiGo ", None, True), ("www.indigo.example", "6E", True), ("www.indigo.example", "QP", False), ("book-sg", "sg", True), ("ixigo", "IX", True), ("ixigo", "6E", False), (None, "6E", False), ("", "", False), ("yatra", None, False), ("carrier_direct", "UK", True), ("vistara.example", " uk ", True)]
    df = spark.createDataFrame(rows, "portal string, carrier string, expected boolean").withColumn("found", is_direct(F.col("portal"), F.col("carrier")))
    assert df.where("not (found <=> expected)").collect() == []


def test_twin_of_nothing(spark):
    assert twin(spark, []) == {}
