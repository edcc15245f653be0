"""Payload shapes, written down by hand."""

import json

from pyspark.sql import functions as F

from fareloom.sources.payloads import flights


def read(spark, *payloads):
    df = spark.createDataFrame([(k, p if isinstance(p, str | None) else json.dumps(p), "clash") for k, p in enumerate(payloads)], "k int, payload string, status string")
    return df, flights(df, "payload")


def test_lists_of_flights_in_all_places(spark):
    one = {"flightNo": "1", "price": 10}
    shapes = [{k: [one, "x", None]} for k in ("flights", "journeys", "FlightDetails", "availability", "results")] + [{"data": {k: [one]}} for k in ("flights", "journeys", "availability")]
    shapes += [{"trips": [{"journeys": [one]}, 5, {"journeyList": [one]}, {"journeys": [], "journeyList": [one]}, {"journeys": {"a": 1}}]}, {"AirSearchResult": {"FlightDetails": [one]}}, {"flights": {}, "journeys": [one]}]
    _, found = read(spark, *shapes)
    counts = {r.k: r["count"] for r in found.groupBy("k").count().collect()}
    assert counts == {k: 3 if k == 8 else 1 for k in range(len(shapes))}
    none = [None, "", "no json", "[1]", "7", {}, {"flights": []}, {"flights": [], "results": [one]}, {"trips": []}, {"data": [one]}, {"AirSearchResult": [one]}]
    assert read(spark, *none)[1].count() == 0


def test_prices_in_nested_parts(spark):
    items = [
        {"totalFare": None, "fare": "", "price": "Rs 1,234.567 only"},
        {"price": "on request", "amount": -5, "tf": 99},
        {"fares": [{"amount": 70}, {"amount": 1}], "fareDetails": {"fare": 60}},
        {"fares": [{"fareDetails": {"totalPrice": "45"}}]},
        {"fareDetails": {"fares": [{"tf": 30.5}], "baseFare": 20, "tax": 2}, "priceBreakup": {"bf": 1}},
        {"fares": "none", "fareDetails": [], "segments": [{"fare": 12, "fn": "S1", "ac": "ai", "dt": "08:00", "at": "09:00"}, {"at": "11:00"}], "fn": "outer"},
        {"priceBreakup": {"basePrice": 9, "fees": "1.5"}, "status": "Sold Out", "duration": 95},
        {"fare": 0, "stops": -1, "Stops": 2},
        {"fare": True, "price": {"amount": 5}},
        {"flightNumber": 417, "carrierCode": " 6e ", "depTime": "", "DepTime": "07:15", "stops": "1"},
    ]
    df, found = read(spark, {"flights": items})
    rows = found.collect()
    assert found.columns == ["k", "status", "flight_number", "carrier", "total_fare", "base_fare", "taxes", "departure", "arrival", "stops", "minutes", "_status"]
    assert [r.total_fare for r in rows] == [1234.57, 99.0, 70.0, 45.0, 30.5, 12.0, None, None, None, None]
    assert [(r.base_fare, r.taxes) for r in rows[4:7]] == [(20.0, 2.0), (None, None), (9.0, 1.5)]
    assert (rows[5].flight_number, rows[5].carrier, rows[5].departure, rows[5].arrival, rows[5].stops) == ("S1", "AI", "08:00", "11:00", 1)
    assert (rows[6]._status, rows[6].minutes) == ("sold_out", 95) and (rows[9].flight_number, rows[9].carrier, rows[9].departure, rows[9].stops) == ("417", "6E", "07:15", 1)
    assert [r.stops for r in rows[:1]] == [0] and rows[7].stops == 0
    assert flights(df.limit(0), "payload").collect() == []


def test_payloads_stay_in_the_jvm(spark):
    plan = flights(spark.range(5).select(F.lit("{}").alias("payload")), "payload")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
