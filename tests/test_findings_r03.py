"""What round 3 found: days without a positive baseline, what is shuffled and kept on disk, and code too long to be compiled."""

import re
import time

import duckdb
import pytest

from fareloom.llm import storage
from fareloom.llm.substring_dedup import remove_repeats
from fareloom.operators import records
from fareloom.plans import fixtures, registry

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def refunds(tmp_path_factory):
    """The smallest tables with all flights in one month, two fifths of them refunds (fares below zero)."""
    path, con = tmp_path_factory.mktemp("refunds"), duckdb.connect()
    for name in TABLES:
        rows = f"SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'"
        if name == "lineitem":
            rows = rows.replace("*", "* REPLACE (CASE WHEN l_partkey % 5 < 2 THEN -2 * l_extendedprice ELSE l_extendedprice END AS l_extendedprice, TIMESTAMP '1998-01-01' + INTERVAL 1 DAY * (l_partkey % 28) AS l_shipdate)")
        con.execute(f"COPY ({rows}) TO '{path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["alert_gate", "alert_summary"])
def test_alerts_without_a_positive_baseline(spark, refunds, name):
    path, con = refunds
    rows = registry.queries()[name](spark, path)
    twin = con.sql(registry.oracle_sql()[name])
    ours = sorted(tuple(r[c] for c in twin.columns) for r in rows.collect())
    assert ours == sorted(twin.fetchall())
    assert rows.where("kind = 'SURGE_PRICING'").count() > 0


def test_line_items_do_not_meet_customers(spark, tables):
    plan = fixtures.quotes(spark, tables)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(plan) if "Join" in line and "o_custkey" in line and "c_custkey" in line)
    depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    below = []
    for line in plan[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert below and not any("l_orderkey" in line for line in below)


def test_replay_carries_what_is_asked_for(spark):
    from fareloom.streaming.dedup import replay

    rows = spark.range(40).selectExpr("concat('f', id % 2) AS flight", "concat('p', id % 3) AS portal", "id AS seq", "timestamp_seconds(id * 7 % 11) AS at", "100D - id AS fare", "cast(null AS string) AS status", "'x' AS wide")
    given = (["flight"], "portal", "at", "fare", "status", ["seq"])
    whole, lean = replay(rows, *given, rows=8), replay(rows, *given, rows=8, keep=["fare"])
    assert lean.columns == ["fare", *(c for c in whole.columns if c not in rows.columns)]
    assert sorted(lean.collect()) == sorted(whole.select(*lean.columns).collect())


def test_a_payload_is_parsed_once(spark):
    from fareloom.sources import payloads

    rows = spark.createDataFrame([('{"flights": [{"price": 5}]}',)], "payload string")
    plan = payloads.flights(rows, "payload")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1


def test_an_offer_is_parsed_once(spark):
    from fareloom.sources import parsers

    rows = spark.createDataFrame([("{}",)], "payload string")
    for parse in (parsers.offers, parsers.cheapest_bookable):
        plan = parse(rows, "payload")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1


@pytest.mark.parametrize("name", ["backtest_run", "cross_correlation", "index_history_monthly"])
def test_quotes_behind_months_are_made_once(spark, tables, name):
    found = registry.queries()[name](spark, tables)
    assert not [f for f in found.inputFiles() if "lineitem" in f or "orders" in f]  # what is left reads days or months from files


def test_records_are_made_by_code_that_is_compiled(spark, tables):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = registry.queries()["record_normalized"](spark, tables)._jdf.queryExecution()
        said = execution.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:([0-9]+)", said)]
    assert sizes and max(sizes) < 8000, sizes  # the JVM interprets longer methods for ever


def test_splits_of_records(spark):
    given = {k: None for k in records.RAW} | {"airline_code": "ai", "origin": "del", "destination": "bom", "booking_window": " 7"}
    cases = [("1000", "700", "200", None), ("1000", "700", None, "residual"), ("1000", None, "200", None), ("1000", None, None, None), ("1000", "700", "200", "calibrated"), (None, "", " ", None), ("1000", "0", "x", "measured")]
    rows = [given | {"total_fare": t, "base_fare": b, "taxes_and_fees": x, "fare_split_basis": how} for t, b, x, how in cases]
    made = records.normalized(spark.createDataFrame(rows, ", ".join(f"{k} string" for k in records.RAW)))
    assert [tuple(r) for r in made.select("total_fare", "base_fare", "taxes_and_fees", "fare_split_basis").collect()] == [
        (1000.0, 700.0, 200.0, "measured"),
        (1000.0, 700.0, 300.0, "residual"),
        (1000.0, 800.0, 200.0, "residual"),
        (1000.0, 810.0, 190.0, "calibrated"),
        (1000.0, 810.0, 190.0, "calibrated"),
        (0.0, 0.0, 0.0, "calibrated"),
        (1000.0, 0.0, 1000.0, "residual"),
    ]


def test_shuffles_of_a_written_table_are_deleted(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = blocks.getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    before = shuffled()
    out = storage.materialize(spark.range(100_000).repartition(4, "id").groupBy("id").count(), "counts")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 100_000
    assert spark.conf.get(storage.FREES_SHUFFLES, None) is None


def test_removed_ranges_come_from_files(spark):
    words = " ".join(f"w{k}" for k in range(60))
    cut, (_, removed) = remove_repeats(spark.createDataFrame([(1, words), (2, f"more {words}"), (3, "few")], "doc_id long, text string"))
    assert [f for f in cut.inputFiles() if "repeated-ranges" in f] and not [f for f in cut.inputFiles() if "repeated-windows" in f]
    assert {r["doc_id"]: (r["text"], r[removed]) for r in cut.collect()} == {1: (words, 0), 2: ("more", 60), 3: ("few", 0)}
