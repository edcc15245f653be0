from fareloom.sources import parsers


def test_traffic_csv_and_json(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("# provenance: official\nperiod,route,pax\n2024-01,DEL-BOM,300\n2024-01,BOM-DEL,200\n2024-01,DEL-BLR,100\n2024-01,X-Y,bad\n")
    rows = {r.route_code: r for r in parsers.read_traffic(spark, str(path)).collect()}
    assert sorted(rows) == ["BOM-DEL", "DEL-BLR", "DEL-BOM"] and abs(sum(r.share_weight for r in rows.values()) - 1) < 1e-9
    assert rows["DEL-BOM"]["rank"] == 1 and rows["DEL-BOM"].provenance == "official"
    (tmp_path / "t.json").write_text('{"records": [{"year_month": "2024-01", "route_code": "A-B", "pax_volume": 5, "provenance": "x"}]}')
    assert [r.provenance for r in parsers.read_traffic(spark, str(tmp_path / "t.json"), "json").collect()] == ["x"]


def test_cpi_changes_need_calendar_neighbours(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("month,cpi_transport\n2024-01,100\n2024-02,110\n2024-04,121\n")
    rows = {r.year_month: r for r in parsers.read_cpi(spark, str(path)).collect()}
    assert rows["2024-01"].mom_pct is None and abs(rows["2024-02"].mom_pct - 10) < 1e-9 and rows["2024-04"].mom_pct is None and rows["2024-01"].airfare is None


def test_offers_and_journeys(spark, tmp_path):
    offer = '{"itineraries":[{"duration":"PT2H15M","segments":[{"carrierCode":"AI","departure":{"iataCode":"DEL"},"arrival":{"iataCode":"HYD"}},{"carrierCode":"AI","departure":{"iataCode":"HYD"},"arrival":{"iataCode":"BLR"}}]}],"price":{"total":"5000.5","base":"4000","taxes":[{"amount":"600"},{"amount":"400.5"}]}}'
    row = parsers.offers(spark.createDataFrame([(offer,)], "p string"), "p").first()
    assert tuple(row) == ("AI", "DEL", "BLR", 135, 1, 5000.5, 4000.0, 1000.5)
    journey = '{"journeys":[{"number":"1","fares":{"x":{"key":"k1","available":0,"type":"ADT"},"y":{"key":"k2","available":3,"type":"ADT"},"z":{"key":"k3","available":3,"type":"CHD"}}},{"number":"2","fares":{}}],"prices":{"k1":10.0,"k2":30.0,"k3":5.0}}'
    assert sorted(map(tuple, parsers.cheapest_bookable(spark.createDataFrame([(journey,)], "p string"), "p").collect())) == [("1", 30.0), ("2", None)]


def test_flights_without_a_fare_stay_without(spark):
    rows = [('{"flights":[{"flightNo":"1","price":0},{"flightNo":"2","fare":7}]}',), ("{}",), (None,)]
    got = sorted((r.flight_number, r.total_fare) for r in parsers.flights(spark.createDataFrame(rows, "p string"), "p").collect())
    assert got == [("1", None), ("2", 7.0)]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    for kind in ("csv", "json", "parquet"):
        parsers.write_table(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).options(header=True).load(str(tmp_path / kind)).count() == 1
