"""Queries on stored tables, weights, set operations and parsed payloads, each with its DuckDB twin."""

import datetime as dt
import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from fareloom.functions import scoring
from fareloom.functions.normalize import fingerprint
from fareloom.operators import store
from fareloom.operators.layout import written
from fareloom.operators.topk import page
from fareloom.plans import daily
from fareloom.plans.fixtures import SEQUENCE, pick, quote_facts, quotes, quotes_of, with_quotes
from fareloom.plans.index_queries import BOUNDS_SQL, COMPOSITE_SQL, INSIDE_SQL, MEDIAN_SQL
from fareloom.sources import deliveries, parsers, payloads
from fareloom.sources.lookup import Lookup
from fareloom.sources.scratch import new_path
from fareloom.sources.stored import Store

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


VOLUMES_SQL = """,
volumes AS (SELECT period, route_code, count(*) AS pax FROM quotes GROUP BY ALL)"""


def volumes(spark, sf_dir):
    return quotes(spark, sf_dir).groupBy("period", "route_code").agg(F.count("*").alias("pax"))


@query(with_quotes(VOLUMES_SQL + """,
w AS (SELECT *, round(pax / sum(pax) OVER (PARTITION BY period), 6) AS w0, row_number() OVER (PARTITION BY period ORDER BY pax DESC, route_code) AS rank FROM volumes),
r AS (SELECT *, 1 - sum(w0) OVER (PARTITION BY period) AS rest FROM w)
SELECT strftime(period, '%Y-%m-%d') AS period, route_code, pax, rank, round(CASE WHEN rank = 1 THEN w0 + rest ELSE w0 END, 6) AS weight FROM r"""))
def weights_normalized(spark, sf_dir):
    w = store.normalized_weights(volumes(spark, sf_dir), "period", "route_code", "pax")
    return w.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "route_code", "pax", F.col("rank").cast("long").alias("rank"), "weight")


@query(with_quotes(""",
twoway AS (SELECT least(origin, destination) AS a, greatest(origin, destination) AS b, period, count(*) FILTER (origin < destination) AS outward, count(*) FILTER (origin > destination) AS inward FROM quotes GROUP BY ALL),
flows AS (SELECT a AS origin, b AS destination, outward AS volume FROM twoway UNION ALL SELECT b, a, inward FROM twoway)
SELECT origin, destination, CAST(sum(volume) AS BIGINT) AS volume FROM flows GROUP BY ALL"""))
def directed_flows(spark, sf_dir):
    q = quotes(spark, sf_dir).groupBy(F.least("origin", "destination").alias("a"), F.greatest("origin", "destination").alias("b"), "period")
    both = q.agg(F.count_if(F.col("origin") < F.col("destination")).alias("outward"), F.count_if(F.col("origin") > F.col("destination")).alias("inward"))
    return store.directed_flows(both, "a", "b", "outward", "inward")


@query(with_quotes(VOLUMES_SQL + """
SELECT a.route_code, strftime(a.period, '%Y-%m-%d') AS period, round((a.pax - b.pax) * 100.0::DOUBLE / b.pax, 4) AS growth_pct FROM volumes a JOIN volumes b ON a.route_code = b.route_code AND b.period = a.period - INTERVAL 12 MONTH"""))
def corridor_growth(spark, sf_dir):
    """Growth against the same quarter a year earlier."""
    v = volumes(spark, sf_dir)
    before = v.select("route_code", F.add_months("period", 12).alias("period"), F.col("pax").alias("before"))
    return v.join(before, ["route_code", "period"]).select("route_code", F.date_format("period", "yyyy-MM-dd").alias("period"), F.round((F.col("pax") - F.col("before")) * 100.0 / F.col("before"), 4).alias("growth_pct"))


@query(with_quotes(VOLUMES_SQL + """,
latest AS (SELECT max(period) AS p FROM volumes WHERE period <= DATE '2030-01-01')
SELECT strftime(period, '%Y-%m-%d') AS period, count(*) AS n_routes, CAST(sum(pax) AS BIGINT) AS total, arg_max(route_code, (pax, route_code)) AS busiest FROM volumes WHERE period = (SELECT p FROM latest) GROUP BY 1"""))
def network_summary(spark, sf_dir):
    """The latest period at or before the one asked for."""
    v = volumes(spark, sf_dir)
    latest = v.where("period <= date'2030-01-01'").agg(F.max("period").alias("period"))
    return v.join(latest, "period").groupBy(F.date_format("period", "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("n_routes"), F.sum("pax").alias("total"), F.max_by("route_code", F.struct("pax", "route_code")).alias("busiest"))


@query(with_quotes(""",
keyed AS (SELECT *, carrier || ':' || flight_no || ':' || route_code || ':' || booking_window || ':' || strftime(flight_date, '%Y-%m') AS key FROM quotes),
target AS (SELECT * FROM (SELECT key, total_fare, seq2 % 2 = 0 AS synthetic, row_number() OVER (PARTITION BY key ORDER BY seq1, seq2, seq3, seq4, flight_date, total_fare) AS rn FROM keyed WHERE seq4 <= 3) WHERE rn = 1),
source AS (SELECT * FROM (SELECT key, total_fare, false AS synthetic, row_number() OVER (PARTITION BY key ORDER BY seq1, seq2, seq3, seq4, flight_date, total_fare) AS rn FROM keyed WHERE seq4 >= 3) WHERE rn = 1),
merged AS (SELECT coalesce(t.key, s.key) AS key, CASE WHEN t.key IS NULL OR (s.key IS NOT NULL AND t.synthetic) THEN s.total_fare ELSE t.total_fare END AS total_fare,
  CASE WHEN t.key IS NULL OR (s.key IS NOT NULL AND t.synthetic) THEN s.synthetic ELSE t.synthetic END AS synthetic, t.key IS NULL AS is_new FROM target t FULL JOIN source s ON t.key = s.key)
SELECT CAST(synthetic AS INT) AS synthetic, count(*) AS n, round(sum(total_fare) / 1000, 2) AS thousands FROM merged GROUP BY 1"""))
def upsert_replay(spark, sf_dir):
    """A batch into a stored table: new keys are added, known ones replaced only where the stored row is
    synthetic; the result of replaying the batch is the same."""
    key = F.concat_ws(":", "carrier", F.col("flight_no").cast("string"), "route_code", "booking_window", F.date_format("flight_date", "yyyy-MM"))
    rows = quotes(spark, sf_dir).withColumn("key", key)
    pick = lambda df, synthetic: store.first_per_key(df, ["key"], SEQUENCE).select("key", "total_fare", synthetic.alias("synthetic"))
    target = pick(rows.where("seq4 <= 3"), F.col("seq2") % 2 == 0)
    source = pick(rows.where("seq4 >= 3"), F.lit(False))
    merged = store.upsert(target, source, ["key"], when=F.col("synthetic"))
    merged = store.upsert(merged, source, ["key"], when=F.col("synthetic"))
    return merged.groupBy(F.col("synthetic").cast("int").alias("synthetic")).agg(F.count("*").alias("n"), F.round(F.sum("total_fare") / 1000, 2).alias("thousands"))


@query(with_quotes("""
SELECT booking_window, count(*) AS n FROM quotes WHERE NOT (event_time < TIMESTAMP '1997-01-01' OR flight_date < DATE '1996-06-01') GROUP BY 1"""))
def retention_filter(spark, sf_dir):
    kept = store.retained(quotes(spark, sf_dir), F.col("event_time") < F.to_timestamp(F.lit("1997-01-01")), F.col("flight_date") < F.to_date(F.lit("1996-06-01")))
    return kept.groupBy("booking_window").agg(F.count("*").alias("n"))


@query(with_quotes("""
SELECT route_code, CAST(max(monitored) AS INT) AS monitored, CAST(max(observed) AS INT) AS observed FROM (
  SELECT route_code, 0 AS monitored, 1 AS observed FROM quotes WHERE flight_date < DATE '1996-01-01' UNION ALL SELECT route_code, 1, 0 FROM quotes WHERE origin = 'ASIA') GROUP BY 1"""))
def corridor_union(spark, sf_dir):
    """Monitored and observed corridors, each with where it is from."""
    q = quotes(spark, sf_dir)
    observed = q.where("flight_date < date'1996-01-01'").select("route_code", F.lit(0).alias("monitored"), F.lit(1).alias("observed")).distinct()
    monitored = q.where("origin = 'ASIA'").select("route_code", F.lit(1).alias("monitored"), F.lit(0).alias("observed")).distinct()
    return observed.union(monitored).groupBy("route_code").agg(F.max("monitored").alias("monitored"), F.max("observed").alias("observed"))


@query(with_quotes(VOLUMES_SQL + """
SELECT v.route_code, count(*) AS n_periods FROM volumes v WHERE NOT EXISTS (SELECT 1 FROM volumes b WHERE b.route_code = v.route_code AND b.period = v.period + INTERVAL 3 MONTH) GROUP BY 1"""))
def missing_weights_anti(spark, sf_dir):
    """Route periods without a weight in the quarter after."""
    v = volumes(spark, sf_dir)
    following = v.select("route_code", F.add_months("period", -3).alias("period"))
    return v.join(following, ["route_code", "period"], "left_anti").groupBy("route_code").agg(F.count("*").alias("n_periods"))


@query(with_quotes("""
SELECT route_code, booking_window, total_fare, strftime(flight_date, '%Y-%m-%d') AS flight_date, seq1, seq2, seq4 FROM eligible WHERE origin = 'ASIA' AND booking_window = 'T+7' AND flight_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
ORDER BY eligible.flight_date, total_fare, seq1, seq2, seq3, seq4 LIMIT 50 OFFSET 10"""))
def quote_page(spark, sf_dir):
    """A filtered page of quotes: the filter comes before the limit."""
    q = quotes(spark, sf_dir).where("origin = 'ASIA' and booking_window = 'T+7' and flight_date between date'1997-01-01' and date'1997-12-31' and coalesce(flight_status, '') not in ('cancelled', 'sold_out')")
    rows = page(q, ["flight_date", "total_fare", "seq1", "seq2", "seq3", "seq4"], 50, 10)
    return rows.select("route_code", "booking_window", "total_fare", F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), "seq1", "seq2", "seq4")


SHOWN_SQL = "route_code, carrier, flight_no, total_fare, strftime(flight_date, '%Y-%m-%d') AS flight_date, seq1, seq2, seq3, seq4"
#: Flights that are looked up by their hash.
FLIGHTS = ["6E:7:ASIA-EUROPE", "AI:12:AMERICA-ASIA", "SG:31:EUROPE-AFRICA", "XX:0:NOWHERE"]


def _stored(spark, sf_dir):
    """All quotes with their flight's hash, laid out for look-ups: line items are dealt out, and quotes made of them behind the shuffle."""
    facts = quote_facts(spark, sf_dir)
    made = lambda rows: quotes_of(rows).withColumn("hash_id", fingerprint(F.col("carrier"), F.col("flight_no"), F.col("route_code")))
    stored = Lookup(spark, new_path(spark, "lookup"), made(facts).schema, ("origin", "destination"), "flight_date", "hash_id")
    stored.write(facts, made=made, dealt=(F.col("origin"), F.col("destination"), F.to_date("l_shipdate"), F.col("l_orderkey")))
    return stored


def _shown(rows):
    return rows.select("route_code", "carrier", "flight_no", "total_fare", F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), "seq1", "seq2", "seq3", "seq4")


@query(with_quotes(f"""
SELECT {SHOWN_SQL} FROM eligible WHERE origin = 'ASIA' AND destination = 'EUROPE' AND booking_window = 'T+7' AND flight_date BETWEEN DATE '1996-11-20' AND DATE '1997-02-10'"""))
def corridor_lookup(spark, sf_dir):
    """The payable quotes of a corridor and window between two days, from stored quotes."""
    found = _stored(spark, sf_dir).in_corridor(("ASIA", "EUROPE"), dt.date(1996, 11, 20), dt.date(1997, 2, 10))
    return _shown(found.where((F.col("booking_window") == "T+7") & scoring.eligible(F.col("flight_status"))))


@query(with_quotes(f"""
SELECT {SHOWN_SQL} FROM quotes WHERE sha256(carrier || ':' || flight_no || ':' || route_code) IN (sha256('6E:7:ASIA-EUROPE'), sha256('AI:12:AMERICA-ASIA'), sha256('SG:31:EUROPE-AFRICA'), sha256('XX:0:NOWHERE'))"""))
def hash_lookup(spark, sf_dir):
    """All quotes of some flights by hash, from stored quotes; one of the hashes is no flight's."""
    return _shown(_stored(spark, sf_dir).by_key(*(hashlib.sha256(f.encode()).hexdigest() for f in FLIGHTS)))


@query(with_quotes(""",
last AS (SELECT *, row_number() OVER (PARTITION BY route_code, period, carrier, flight_no, portal ORDER BY event_time DESC, seq1 DESC, seq2 DESC, seq3 DESC, seq4 DESC, flight_date DESC, total_fare DESC) AS rn FROM quotes),
cheap AS (SELECT route_code, period, carrier, flight_no, min(total_fare) FILTER (coalesce(flight_status, '') NOT IN ('cancelled', 'sold_out')) AS fare, count(*) AS n_portals, max(total_fare) AS most FROM last WHERE rn = 1 GROUP BY ALL)
SELECT route_code, strftime(period, '%Y-%m-%d') AS period, carrier, flight_no, n_portals, fare, CASE WHEN n_portals > 1 AND fare > 0 THEN round(most - fare, 2) END AS spread FROM cheap"""))
def portal_latest_min(spark, sf_dir):
    """The batch twin of the stream: each portal's last quote of a flight, the least payable one, the spread."""
    from fareloom.streaming.dedup import resolve_batch

    r = resolve_batch(quotes(spark, sf_dir), ["route_code", "period", "carrier", "flight_no"], "portal", "total_fare", "flight_status", ["event_time", *SEQUENCE])
    return r.select("route_code", F.date_format("period", "yyyy-MM-dd").alias("period"), "carrier", "flight_no", "n_portals", "fare", "spread")


@query(with_quotes("""
SELECT portal, count(*) AS n, count(*) FILTER (seq2 % 7 != 0) AS n_priced, round(avg(CASE WHEN seq2 % 7 != 0 THEN total_fare END), 4) AS mean_fare, max(CASE WHEN seq2 % 3 = 2 THEN 'F' || flight_no END) AS last_number FROM quotes GROUP BY 1"""))
def portal_payload_parse(spark, sf_dir):
    """Quotes written as payloads of three shapes and parsed back; a fare that is missing stays missing."""
    k, fare, number = F.col("seq2") % 3, F.when(F.col("seq2") % 7 != 0, F.col("total_fare")), F.concat(F.lit("F"), F.col("flight_no").cast("string"))
    one = F.to_json(F.struct(F.array(F.struct(number.alias("flightNo"), fare.alias("totalFare"))).alias("flights")))
    two = F.to_json(F.struct(F.struct(F.array(F.struct(number.alias("flight_number"), F.array(F.struct(fare.alias("amount"))).alias("fares"))).alias("flights")).alias("data")))
    three = F.to_json(F.struct(F.array(F.struct(number.alias("flightNo"), F.struct(fare.alias("total")).alias("fareDetails"))).alias("results")))
    raw = quotes(spark, sf_dir).select("portal", k.alias("k"), F.when(k == 0, one).when(k == 1, two).otherwise(three).alias("payload"))
    f = parsers.flights(raw, "payload")
    return f.groupBy("portal").agg(F.count("*").alias("n"), F.count("total_fare").alias("n_priced"), F.round(F.avg("total_fare"), 4).alias("mean_fare"), F.max(F.when(F.col("k") == 2, F.col("flight_number"))).alias("last_number"))


@query(with_quotes("""
SELECT carrier, strftime(min(flight_date), '%Y-%m-%d') AS first, count(DISTINCT sha256(carrier || ':' || flight_no || ':' || route_code)) AS n_flights FROM quotes GROUP BY 1"""))
def distinct_flights(spark, sf_dir):
    key = fingerprint(F.col("carrier"), F.col("flight_no"), F.col("route_code"))
    return quotes(spark, sf_dir).groupBy("carrier").agg(F.date_format(F.min("flight_date"), "yyyy-MM-dd").alias("first"), F.countDistinct(key).alias("n_flights"))


@query(with_quotes(""",
runs AS (SELECT seq4 AS batch, portal, min(event_time) AS started, max(event_time) AS completed, count(*) AS fares, count(DISTINCT route_code) AS routes, count(*) - count(DISTINCT carrier || ':' || flight_no || ':' || route_code || ':' || CAST(flight_date AS VARCHAR)) AS duplicates FROM quotes GROUP BY ALL)
SELECT batch, portal, fares, routes, duplicates, greatest(epoch(completed) - epoch(started), 0)::BIGINT AS seconds, CASE WHEN routes = 20 THEN 'success' WHEN routes > 0 THEN 'partial' ELSE 'failed' END AS status FROM runs"""))
def run_log(spark, sf_dir):
    """Collection runs: what each took, gathered and repeated."""
    flight = F.concat_ws(":", "carrier", F.col("flight_no").cast("string"), "route_code", F.col("flight_date").cast("string"))
    runs = quotes(spark, sf_dir).groupBy(F.col("seq4").alias("batch"), "portal").agg(F.min("event_time").alias("started"), F.max("event_time").alias("completed"), F.count("*").alias("fares"), F.countDistinct("route_code").alias("routes"), F.countDistinct(flight).alias("flights"))
    seconds = F.greatest(F.unix_timestamp("completed") - F.unix_timestamp("started"), F.lit(0))
    status = F.when(F.col("routes") == 20, "success").when(F.col("routes") > 0, "partial").otherwise("failed")
    return runs.select("batch", "portal", "fares", "routes", (F.col("fares") - F.col("flights")).alias("duplicates"), seconds.alias("seconds"), status.alias("status"))


@query(with_quotes(VOLUMES_SQL + """,
month AS (SELECT route_code, pax::DOUBLE / sum(pax) OVER () AS share FROM volumes WHERE period = DATE '1997-01-01' AND pax > 60),
dims AS (SELECT DISTINCT route_code, origin, destination, 0.05::DOUBLE AS weight FROM quotes)
SELECT d.route_code, d.origin, d.destination, round(coalesce(m.share, d.weight), 6) AS weight, CAST(m.share IS NOT NULL AS INT) AS updated FROM dims d LEFT JOIN month m ON d.route_code = m.route_code"""))
def dimension_sync(spark, sf_dir):
    """Route weights taken over from one period; routes without a new weight keep theirs."""
    month = volumes(spark, sf_dir).where("period = date'1997-01-01' and pax > 60")
    month = month.crossJoin(month.agg(F.sum("pax").alias("total"))).select("route_code", (F.col("pax").cast("double") / F.col("total")).alias("share"))
    dims = quotes(spark, sf_dir).select("route_code", "origin", "destination").distinct().withColumn("weight", F.lit(0.05))
    return dims.join(month, "route_code", "left").select("route_code", "origin", "destination", F.round(F.coalesce("share", "weight"), 6).alias("weight"), F.col("share").isNotNull().cast("int").alias("updated"))


@query(with_quotes("""
SELECT route_code, booking_window, count(*) AS n FROM quotes WHERE origin = 'EUROPE' AND flight_date >= DATE '1998-01-01' GROUP BY ALL HAVING count(*) > 5"""))
def filtered_counts(spark, sf_dir):
    q = quotes(spark, sf_dir).where("origin = 'EUROPE' and flight_date >= date'1998-01-01'")
    return q.groupBy("route_code", "booking_window").agg(F.count("*").alias("n")).where("n > 5")


@query("""
WITH given AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'estimated' END AS row_token, CASE o_orderkey % 3 WHEN 0 THEN 'official' END AS file_token, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS cell FROM orders)
SELECT coalesce(row_token, file_token, CASE cell WHEN true THEN 'synthetic' WHEN false THEN 'official' END, 'synthetic') AS kind, count(*) AS n FROM given GROUP BY 1""")
def provenance_counts(spark, sf_dir):
    """Provenance of a row: its own token, else the file's, else its flag, else synthetic."""
    k = F.col("o_orderkey")
    row, file = F.when(k % 4 == 0, "official").when(k % 4 == 1, "estimated"), F.when(k % 3 == 0, "official")
    cell = F.when(k % 5 == 0, "synthetic").when(k % 5 == 1, "official")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.coalesce(row, file, cell, F.lit("synthetic")).alias("kind")).agg(F.count("*").alias("n"))


@query(with_quotes("""
SELECT seq1, seq2, seq4, CASE WHEN total_fare <= 0 OR total_fare IS NULL THEN 'fare;' ELSE '' END || CASE WHEN carrier IN ('6E', 'AI', 'SG') THEN '' ELSE 'carrier;' END || CASE WHEN event_time < flight_date THEN '' ELSE 'chronology;' END AS reasons FROM quotes"""))
def record_validation(spark, sf_dir):
    """Every failed check of a record by name; an empty list is a valid record."""
    from fareloom.functions.normalize import reasons

    checks = reasons((F.col("total_fare") > 0, "fare;"), (F.col("carrier").isin("6E", "AI", "SG"), "carrier;"), (F.col("event_time") < F.col("flight_date"), "chronology;"))
    return quotes(spark, sf_dir).select("seq1", "seq2", "seq4", F.array_join(checks, "").alias("reasons"))


#: Days that run.
DAYS = ["1995-06-14", "1995-06-15"]
DAILY_RUN_SQL = with_quotes("""
, chosen AS (SELECT *, flight_date AS period FROM (SELECT * EXCLUDE (period) FROM eligible) WHERE flight_date IN (DATE '1995-06-14', DATE '1995-06-15')),
dedup AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY route_code, period, booking_window, carrier, flight_no ORDER BY total_fare, seq1, seq2, seq3, seq4) AS rn FROM chosen) WHERE rn = 1)""" + BOUNDS_SQL + INSIDE_SQL + MEDIAN_SQL + COMPOSITE_SQL + """,
bases AS (SELECT route_code, avg(total_fare) AS base_fare, count(*) AS weight FROM quotes GROUP BY 1)""")


@query(DAILY_RUN_SQL + """
SELECT strftime(period, '%Y-%m-%d') AS day, count(*) AS n_routes, round(sum(weight * composite / base_fare) / sum(weight) * 100, 4) AS index, CAST(sum(n_windows) AS BIGINT) AS n_windows,
  (SELECT count(*) FROM medians m WHERE m.period = c.period) AS stored_windows FROM composites c JOIN bases USING (route_code) GROUP BY period""")
def daily_runs(spark, sf_dir):
    """The national index of two days as it is read back from the stored tables; the second day runs again at the end. A day
    without quotes of its own is left out."""
    target = Store(spark, new_path(spark, "daily"))
    q = written(quotes(spark, sf_dir).withColumn("captured_at", F.col("flight_date").cast("timestamp")), "daily-quotes")
    base = q.groupBy("route_code").agg(F.avg("total_fare").alias("base_fare"), F.count("*").alias("weight"))
    base = written(base, "daily-base")
    for day in [*DAYS, DAYS[1]]:
        daily.run_day(target, q, dt.date.fromisoformat(day), SEQUENCE[:4], base)
    routes = target.read("routes", daily.ROUTES).groupBy("day").agg(F.sum("n_windows").alias("n_windows"))
    windows = target.read("windows", daily.WINDOWS).groupBy("day").agg(F.count("*").alias("stored_windows"))
    found = target.read("national", daily.NATIONAL).join(routes, "day").join(windows, "day").join(daily.done(target).where("not fallback").select("day"), "day")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_routes", F.round("index", 4).alias("index"), "n_windows", "stored_windows")


#: Ten ways in which sources wrap a list of flights; {} is the flight.
SHAPES = ['{"flights": [{}]}', '{"journeys": [{}, 7]}', '{"FlightDetails": [{}]}', '{"availability": [{}], "trips": []}', '{"results": [{}], "flights": {}}', '{"data": {"flights": [{}]}}', '{"data": {"journeys": [{}]}}', '{"trips": [{"journeys": [{}]}, 3]}', '{"trips": [{"journeys": [], "journeyList": [{}]}]}', '{"AirSearchResult": {"FlightDetails": [{}]}}']


@query(with_quotes("""
, read AS (SELECT portal, seq2 % 10 AS shape, carrier, flight_no, CASE WHEN seq2 % 7 != 0 THEN total_fare END AS fare, seq4 % 5 AS style, seq4 FROM quotes)
SELECT portal, shape, carrier, count(*) AS n, count(fare) AS n_priced, CAST(sum(CAST(round(fare * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CASE WHEN style = 2 THEN CAST(floor(fare) AS BIGINT) * 100 END) AS BIGINT) AS base_cents,
  max(flight_no) AS last_number, CAST(sum(CASE WHEN style = 3 THEN 1 ELSE 0 END) AS BIGINT) AS stops FROM read GROUP BY ALL"""))
def payload_shapes(spark, sf_dir):
    """Quotes wrapped in ten shapes, with prices in five places, parsed back; a missing fare stays null."""
    style, fare, number = F.col("seq4") % 5, F.when(F.col("seq2") % 7 != 0, F.col("total_fare")), F.col("flight_no").cast("string")
    plain = F.coalesce(fare.cast("decimal(18,2)").cast("string"), F.lit("null"))
    shown = F.coalesce(F.concat(F.lit('"INR '), F.format_number(fare, 2), F.lit('"')), F.lit('""'))
    named = lambda n, c: F.concat(F.lit(f'{{"{n}": "'), number, F.lit(f'", "{c}": "'), F.lower("carrier"), F.lit('", '))
    base = F.coalesce(F.floor(fare).cast("string"), F.lit("null"))
    flight = (
        F.when(style == 0, F.concat(named("flightNumber", "airlineCode"), F.lit('"totalFare": '), plain, F.lit("}")))
        .when(style == 1, F.concat(named("fn", "ac"), F.lit('"fare": null, "fares": [{"amount": '), shown, F.lit("}]}")))
        .when(style == 2, F.concat(named("FlightNo", "carrier"), F.lit('"fareDetails": {"base_fare": '), base, F.lit(', "fares": [{"tf": '), plain, F.lit("}]}}")))
        .when(style == 3, F.concat(F.lit('{"segments": ['), named("flightNo", "carrierCode"), F.lit('"price": '), plain, F.lit('}, {"x": 1}]}')))
        .otherwise(F.concat(named("flightNumber", "AirlineCode"), F.lit('"price": "on request", "grossFare": '), shown, F.lit("}")))
    )
    wrapped = F.col("seq2") % 10
    before, after = (pick([s.split("{}", 1)[k] for s in SHAPES], F.col("shape")) for k in (0, 1))
    given = quotes(spark, sf_dir).select("portal", wrapped.alias("shape"), flight.alias("flight"))
    f = payloads.flights(given.select("portal", "shape", F.concat(before, "flight", after).alias("payload")), "payload")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return f.groupBy("portal", "shape", "carrier").agg(F.count("*").alias("n"), F.count("total_fare").alias("n_priced"), cents("total_fare").alias("cents"), cents("base_fare").alias("base_cents"), F.max(F.col("flight_number").cast("long")).alias("last_number"), F.sum("stops").cast("long").alias("stops"))


#: The lines of two deliveries, a file a quarter: some with a field too few, a word for a number or no passengers; a year that the first one lacks.
LINES_SQL = """
, lines AS (SELECT period, strftime(period, '%Y-%m') AS m, route_code, pax, CASE WHEN pax % 7 = 0 THEN strftime(period, '%Y-%m') || ',' || route_code WHEN pax % 7 = 1 THEN strftime(period, '%Y-%m') || ',' || route_code || ',n/a'
  WHEN pax % 7 = 2 THEN strftime(period, '%Y-%m') || ',' || route_code || ',0' ELSE strftime(period, '%Y-%m') || ',' || route_code || ',' || pax END AS line FROM volumes),
wanted AS (SELECT m, route_code FROM (SELECT DISTINCT m FROM lines) CROSS JOIN (SELECT DISTINCT route_code FROM lines))"""
VOLUME = "month string, route_code string, pax long"


def _deliveries(spark, sf_dir):
    """The manifest of a first delivery, and the rows of a second one."""
    v = written(volumes(spark, sf_dir).withColumn("month", F.date_format("period", "yyyy-MM")), "volumes")
    kind, start = F.col("pax") % 7, F.concat_ws(",", "month", "route_code")
    line = F.when(kind == 0, start).otherwise(F.concat(start, F.when(kind == 1, ",n/a").when(kind == 2, ",0").otherwise(F.concat(F.lit(","), F.col("pax").cast("string")))))
    second = v.select("month", line.alias("line"))
    # the first quarters said otherwise of one corridor
    first = second.where("month not like '1996%'").withColumn("line", F.when(F.col("month").endswith("-01") & F.col("line").contains("ASIA-EUROPE"), F.concat("line", F.lit("9"))).otherwise(F.col("line")))
    found = []
    for name, rows in (("first", first), ("second", second)):
        path = new_path(spark, f"delivery-{name}")
        rows.withColumn("folder", F.col("month")).select("folder", "line").repartition("folder").write.partitionBy("folder").text(path)
        found.append(deliveries.delivered(spark, path, VOLUME, name=F.regexp_extract("path", "folder=([^/]*)", 1)))
    return v, deliveries.manifest(found[0]), found[1]


@query(with_quotes(VOLUMES_SQL + LINES_SQL + """
SELECT 'bad line' AS problem, m AS file, line AS what FROM lines WHERE pax % 7 < 2
UNION ALL SELECT 'no volume', m, m || ' ' || route_code FROM lines WHERE pax % 7 = 2
UNION ALL SELECT 'missing', NULL, m || ' ' || route_code FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.m = w.m AND l.route_code = w.route_code AND pax % 7 > 2)
UNION ALL SELECT 'pinned', CASE WHEN pax % 7 > 1 THEN m END, m || ' ' || route_code || ': ' || CASE WHEN pax % 7 < 2 THEN 'nothing' WHEN pax % 7 = 2 THEN '0' ELSE '' || pax END || ' for ' || pax FROM lines WHERE month(period) = 7 AND pax % 7 <= 2"""))
def delivery_faults(spark, sf_dir):
    """What is wrong with delivered files of volumes: bad lines, no volumes, missing corridors, values other than those published."""
    v, _, rows = _deliveries(spark, sf_dir)
    expected = v.select("month").distinct().crossJoin(v.select("route_code").distinct())  # months by corridors
    return deliveries.faults(rows, "month", "route_code", "pax", expected, v.where(F.col("month").endswith("-07")))


@query(with_quotes(VOLUMES_SQL + LINES_SQL + """
, files AS (SELECT m AS file, count(*) AS n_lines, count(*) FILTER (pax % 7 < 2) AS n_bad, bool_or(route_code = 'ASIA-EUROPE') AS touched FROM lines GROUP BY 1)
SELECT file, n_lines, n_bad, CASE WHEN file LIKE '1996%' THEN 'added' WHEN file LIKE '%-01' AND touched THEN 'changed' END AS change FROM files"""))
def delivery_manifest(spark, sf_dir):
    """The files of a second delivery, and which of them are new or other than in the first."""
    _, old, rows = _deliveries(spark, sf_dir)
    new = written(deliveries.manifest(rows), "manifest")
    return new.join(deliveries.changes(new, old), "file", "left").select("file", "n_lines", "n_bad", "change")
