"""Queries on raw fields, stored records, day loads, table writes and the batch twins of the stream, each with its DuckDB twin.

Texts that sources write in many ways are made from the order key, so that every variant occurs.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions import normalize, scoring
from fareloom.operators import anomaly, checks, index, records, series, store
from fareloom.operators.topk import page
from fareloom.plans.anomaly_queries import ALERT_SQL, GATED_SQL, alerts_by_inputs
from fareloom.plans.fixtures import BENCHMARK_SQL, SEQUENCE, benchmark_months, pick, quotes, table, telemetry, with_quotes, with_telemetry
from fareloom.plans.index_queries import ALL_SQL, AIRPORT_SQL, composites, numbers
from fareloom.plans.series_queries import LAGS_SQL, MONTHS_SQL, pairs
from fareloom.plans.store_queries import VOLUMES_SQL, volumes
from fareloom.operators.layout import written
from fareloom.sources import parsers, scratch
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


def literal(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def variant_sql(values: list, key: str = "o_orderkey") -> str:
    return f"list_extract([{', '.join(map(literal, values))}], CAST({key} % {len(values)} + 1 AS INT))"


def variant(values: list, key: str = "o_orderkey") -> Column:
    return pick(values, F.col(key) % len(values))


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


# -- fields -----------------------------------------------------------------------------------------

CODES, CLASSES, AMOUNTS = [" ai ", "6e", None, "", "QP ", "sg", "x"], ["y", " b ", "", None], ["0", "12.5", " ", "x", None]


@query(f"""
WITH given AS (SELECT {variant_sql(CODES)} AS v, {variant_sql(CLASSES)} AS c, {variant_sql(AMOUNTS)} AS a FROM orders)
SELECT upper(trim(coalesce(v, ''))) AS code, nullif(upper(trim(c)), '') AS booking_class, TRY_CAST(nullif(trim(a), '') AS DOUBLE) AS amount, count(*) AS n FROM given GROUP BY ALL""")
def code_normalized(spark, sf_dir):
    """Codes, booking classes and amounts as sources write them."""
    return orders(spark, sf_dir).groupBy(normalize.code(variant(CODES)).alias("code"), normalize.booking_class(variant(CLASSES)).alias("booking_class"), normalize.amount(variant(AMOUNTS)).alias("amount")).agg(F.count("*").alias("n"))


CLOCKS = ["T9:05", "2024-05-01T07:30:00", "23:59:59", "noon", None, "6:51", " 2024-05-02 "]


@query(f"""
WITH given AS (SELECT {variant_sql(CLOCKS)} AS v FROM orders),
parts AS (SELECT v, regexp_extract(v, '(?:^|[T ])([0-9]{{1,2}}):([0-9]{{2}})', 1) AS h, regexp_extract(v, '(?:^|[T ])([0-9]{{1,2}}):([0-9]{{2}})', 2) AS m FROM given)
SELECT CASE WHEN h != '' THEN lpad(h, 2, '0') || ':' || m END AS departure, split_part(trim(v), 'T', 1) AS day, count(*) AS n FROM parts GROUP BY ALL""")
def clock_normalized(spark, sf_dir):
    """Clock times and days out of timestamps and plain texts."""
    return orders(spark, sf_dir).groupBy(normalize.departure_time(variant(CLOCKS)).alias("departure"), normalize.date_text(variant(CLOCKS)).alias("day")).agg(F.count("*").alias("n"))


TIMES = ["", "000", "2024-05-01T07:30:00", "2024-05-01 07:31:00", "01/05/2024 07:32", "01-05-2024", "never", None]


@query(f"""
WITH given AS (SELECT CASE WHEN o_orderkey % 8 < 2 THEN CAST(1700000000 + o_orderkey AS VARCHAR) || {variant_sql(TIMES)} ELSE {variant_sql(TIMES)} END AS v FROM orders),
parsed AS (SELECT coalesce(CAST(CASE WHEN abs(TRY_CAST(v AS DOUBLE)) > 1e11 THEN TRY_CAST(v AS DOUBLE) / 1000 ELSE TRY_CAST(v AS DOUBLE) END AS BIGINT), CAST(epoch(TRY_CAST(v AS TIMESTAMP)) AS BIGINT),
  CAST(epoch(try_strptime(v, '%d/%m/%Y %H:%M')) AS BIGINT), CAST(epoch(try_strptime(v, '%d-%m-%Y')) AS BIGINT)) AS seconds FROM given)
SELECT seconds, count(*) AS n FROM parsed GROUP BY 1""")
def timestamp_parsed(spark, sf_dir):
    """Epoch seconds and milliseconds, ISO and local formats as one time; anything else is null."""
    v = F.when(F.col("o_orderkey") % 8 < 2, F.concat((F.col("o_orderkey") + 1_700_000_000).cast("string"), variant(TIMES))).otherwise(variant(TIMES))
    return orders(spark, sf_dir).groupBy(F.unix_timestamp(normalize.timestamp(v)).alias("seconds")).agg(F.count("*").alias("n"))


RANGES, TAGS = ["1-3d", "4-7d", "8-14d", "15-30d", "T+45", None], ["7", " t15 ", "T+30", "T99", "later", None, "T1"]


@query(f"""
WITH given AS (SELECT {variant_sql(RANGES)} AS r, upper(trim({variant_sql(TAGS)})) AS w FROM orders)
SELECT CASE r WHEN '1-3d' THEN 'T+1' WHEN '4-7d' THEN 'T+7' WHEN '8-14d' THEN 'T+15' WHEN '15-30d' THEN 'T+30' ELSE r END AS of_range,
  CASE WHEN w IS NULL THEN 'T+1' WHEN regexp_matches(w, '^[0-9]+$') THEN 'T+' || w WHEN w IN ('T1', 'T7', 'T15', 'T30', 'T45') THEN 'T+' || substr(w, 2) ELSE w END AS stored, count(*) AS n FROM given GROUP BY ALL""")
def window_aliases(spark, sf_dir):
    """Windows from ranges of days, and as stored records have them."""
    return orders(spark, sf_dir).groupBy(normalize.window_of_range(variant(RANGES)).alias("of_range"), normalize.stored_window(variant(TAGS)).alias("stored")).agg(F.count("*").alias("n"))


SPELLINGS = ["7", " t15 ", "T+30", "T99", "later", None, "T1", "T-7", "", "45"]


@query(f"""
WITH given AS (SELECT {variant_sql(SPELLINGS)} AS raw, upper(trim(coalesce({variant_sql(SPELLINGS)}, ''))) AS w FROM orders)
SELECT CASE WHEN coalesce(raw, '') = '' THEN 'T+7' WHEN w IN ('T1', 'T+1', '1', 'T7', 'T+7', '7', 'T15', 'T+15', '15', 'T30', 'T+30', '30', 'T45', 'T+45', '45') THEN 'T+' || regexp_extract(w, '[0-9]+') ELSE w END AS pipeline,
  CASE WHEN regexp_matches(replace(w, '+', ''), '^[0-9]+$') THEN 'T' ELSE '' END || replace(w, '+', '') AS engine, CASE WHEN w LIKE 'T+%' OR w LIKE 'T-%' THEN w WHEN w LIKE 'T%' THEN 'T+' || substr(w, 2) ELSE 'T+' || w END AS series, count(*) AS n FROM given GROUP BY ALL""")
def window_variants(spark, sf_dir):
    """Windows as the daily run, the index engine and the series of elasticities spell them."""
    raw = variant(SPELLINGS)
    return orders(spark, sf_dir).groupBy(normalize.pipeline_window(raw).alias("pipeline"), normalize.engine_window(raw).alias("engine"), normalize.series_window(raw).alias("series")).agg(F.count("*").alias("n"))


PLACES, PRICES, PAIRS = ["del", "DELHI", " bom", None, "b1r"], ["Rs 4,500.50", "0", "abc", "1,00,000", None, "99.999", " 12 "], ["del-bom", "DELBOM", "de-bom", None, " blr-hyd "]


@query(f"""
WITH given AS (SELECT upper(trim({variant_sql(PLACES)})) AS i, upper(trim({variant_sql(CODES)})) AS c, TRY_CAST(regexp_extract(replace({variant_sql(PRICES)}, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS f, upper(trim({variant_sql(PAIRS)})) AS p FROM orders)
SELECT CASE WHEN regexp_matches(i, '^[A-Z]{{3}}$') THEN i END AS iata, CASE WHEN regexp_matches(c, '^[A-Z0-9]{{2}}$') THEN c END AS carrier, CASE WHEN f > 0 THEN round(f, 2) END AS fare,
  CASE WHEN regexp_matches(p, '^[^-]{{3}}-[^-]{{3}}$') THEN split_part(p, '-', 1) END AS origin, count(*) AS n FROM given GROUP BY ALL""")
def field_validators(spark, sf_dir):
    """Airports, carriers, fares and route pairs; what is malformed is null."""
    columns = [normalize.iata(variant(PLACES)).alias("iata"), normalize.carrier_code(variant(CODES)).alias("carrier"), normalize.fare(variant(PRICES)).alias("fare"), normalize.route_pair(variant(PAIRS))["origin"].alias("origin")]
    return orders(spark, sf_dir).select(*columns).groupBy("iata", "carrier", "fare", "origin").agg(F.count("*").alias("n"))


SUPPLIED, STARTS, ENDS = ["135", "0", "true", "12.5", None, "90"], ["2024-05-01 07:30:00", None, "2024-05-01 07:30:30", "x"], ["2024-05-01 09:45:10", "2024-05-01 07:00:00", None, "2024-05-02 00:10:00", "?"]


@query(f"""
WITH given AS (SELECT TRY_CAST({variant_sql(SUPPLIED)} AS DOUBLE) AS s, TRY_CAST({variant_sql(STARTS)} AS TIMESTAMP) AS d, TRY_CAST({variant_sql(ENDS)} AS TIMESTAMP) AS a FROM orders)
SELECT CASE WHEN d IS NOT NULL THEN coalesce(CASE WHEN s > 0 AND floor(s) = s THEN CAST(s AS BIGINT) END, CASE WHEN a > d THEN CAST(floor((epoch(a) - epoch(d)) / 60) AS BIGINT) END) END AS minutes, count(*) AS n FROM given GROUP BY 1""")
def duration_resolved(spark, sf_dir):
    """A supplied positive number of minutes, else the time between departure and a later arrival."""
    d, a = (F.try_to_timestamp(variant(v)) for v in (STARTS, ENDS))
    return orders(spark, sf_dir).groupBy(normalize.duration_minutes(normalize.minutes(variant(SUPPLIED)), d, a).alias("minutes")).agg(F.count("*").alias("n"))


CITIES = ["Mumbai (Navi Mumbai)", "MUMBAI", "Navi Mumbai", " Calcutta ", "madras", "New Delhi", "Delhi (T3)", "Goa", None]


@query(f"""
WITH given AS (SELECT upper(trim(coalesce({variant_sql(CITIES)}, ''))) AS c FROM orders), bases AS (SELECT c, trim(split_part(c, '(', 1)) AS b FROM given)
SELECT CASE WHEN starts_with(c, 'MUMBAI') THEN CASE WHEN contains(c, 'NAVI') THEN 'NMI' ELSE 'BOM' END
  ELSE CASE b WHEN 'DELHI' THEN 'DEL' WHEN 'BENGALURU' THEN 'BLR' WHEN 'BANGALORE' THEN 'BLR' WHEN 'KOLKATA' THEN 'CCU' WHEN 'CALCUTTA' THEN 'CCU' WHEN 'HYDERABAD' THEN 'HYD' WHEN 'CHENNAI' THEN 'MAA' WHEN 'MADRAS' THEN 'MAA' ELSE b END END AS airport, count(*) AS n FROM bases GROUP BY 1""")
def city_codes(spark, sf_dir):
    """Airports of cities as traffic tables spell them."""
    return orders(spark, sf_dir).groupBy(normalize.city_code(variant(CITIES)).alias("airport")).agg(F.count("*").alias("n"))


PAYLOADS = ['{"flight_status": "Canceled"}', '{"flightStatus": "available", "soldOut": true}', '{"isCancelled": true, "status": "scheduled"}', '{"status": "SOLD-OUT"}', '{"status": "available"}', "{}", None, '{"flight_status": "schedule", "sold_out": true}', '{"sold_out": false}']


@query(f"""
WITH given AS (SELECT CAST({variant_sql(PAYLOADS)} AS JSON) AS p FROM orders),
fields AS (SELECT replace(replace(lower(trim(p->>'$.flight_status')), '-', '_'), ' ', '_') AS a, replace(replace(lower(trim(p->>'$.flightStatus')), '-', '_'), ' ', '_') AS b,
  coalesce(CAST(p->'$.soldOut' AS VARCHAR) = 'true', false) OR coalesce(CAST(p->'$.sold_out' AS VARCHAR) = 'true', false) AS sold, coalesce(CAST(p->'$.isCancelled' AS VARCHAR) = 'true', false) AS gone, replace(replace(lower(trim(p->>'$.status')), '-', '_'), ' ', '_') AS s FROM given),
named AS (SELECT CASE WHEN a IN ('scheduled', 'schedule') THEN 'scheduled' WHEN a IN ('cancelled', 'canceled') THEN 'cancelled' WHEN a IN ('sold_out', 'soldout') THEN 'sold_out' END AS a,
  CASE WHEN b IN ('scheduled', 'schedule') THEN 'scheduled' WHEN b IN ('cancelled', 'canceled') THEN 'cancelled' WHEN b IN ('sold_out', 'soldout') THEN 'sold_out' END AS b, sold, gone,
  CASE WHEN s IN ('scheduled', 'schedule') THEN 'scheduled' WHEN s IN ('cancelled', 'canceled') THEN 'cancelled' WHEN s IN ('sold_out', 'soldout') THEN 'sold_out' END AS s FROM fields)
SELECT coalesce(a, b, CASE WHEN sold THEN 'sold_out' END, CASE WHEN gone THEN 'cancelled' END, s) AS status, count(*) AS n FROM named GROUP BY 1""")
def reported_status(spark, sf_dir):
    """The status that a payload reports by text, flag or general status, in this order."""
    return orders(spark, sf_dir).groupBy(records.reported_status(variant(PAYLOADS)).alias("status")).agg(F.count("*").alias("n"))


STATES = ["SUCCESS", " partial ", "fallback_cache", "unheard of", None, "failed", "Rate_Limited", "captcha", "TIMEOUT", "OK"]


@query(f"""
WITH given AS (SELECT upper(trim(coalesce({variant_sql(STATES)}, ''))) AS s FROM orders)
SELECT s AS status, s NOT IN ('FAILED', 'ERROR', 'TIMEOUT', 'BLOCKED', 'BANNED', 'RATE_LIMITED', 'CAPTCHA') AS ok, count(*) AS n FROM given GROUP BY ALL""")
def status_success(spark, sf_dir):
    """Runs by status; only the listed failures are failures."""
    s = variant(STATES)
    return orders(spark, sf_dir).groupBy(normalize.code(s).alias("status"), scoring.succeeded(s).alias("ok")).agg(F.count("*").alias("n"))


@query(with_quotes("""
SELECT seq1, seq2, seq4, sha256(carrier || ':' || flight_no || ':' || origin || ':' || destination || ':' || strftime(event_time, '%Y-%m-%dT%H:%M:%S') || ':' || booking_window) AS stored,
  sha256(carrier || ':' || carrier || flight_no || ':' || origin || ':' || destination || ':' || strftime(flight_date, '%Y-%m-%d') || ':' || strftime(event_time, '%H:%M') || ':economy') AS streamed FROM quotes"""))
def fingerprint_keys(spark, sf_dir):
    """Both keys of an observation: as a stored record and as a flight in the stream."""
    number, at = F.col("flight_no").cast("string"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    stored = normalize.record_key(F.col("carrier"), number, F.col("origin"), F.col("destination"), at, F.col("booking_window"))
    streamed = normalize.flight_key(F.col("carrier"), number, F.col("origin"), F.col("destination"), F.date_format("flight_date", "yyyy-MM-dd"), at, F.lit(" "))
    return quotes(spark, sf_dir).select("seq1", "seq2", "seq4", stored.alias("stored"), streamed.alias("streamed"))


# -- records ----------------------------------------------------------------------------------------


@query(with_quotes(f"""
, raw AS (SELECT seq1, seq2, seq4, {AIRPORT_SQL.format(c='origin')} AS o, {AIRPORT_SQL.format(c='destination')} AS d, carrier AS c, 'f' || flight_no AS f, {variant_sql(TAGS, 'seq1')} AS w, event_time, flight_date, total_fare AS t,
  round(total_fare * 0.7 * 100) / 100.0::DOUBLE AS b, round(total_fare * 0.2 * 100) / 100.0::DOUBLE AS x FROM quotes),
rated AS (SELECT *, round(coalesce(CASE o || '-' || d WHEN 'DEL-BOM' THEN 0.78 WHEN 'BOM-DEL' THEN 0.78 WHEN 'DEL-BLR' THEN 0.81 WHEN 'BLR-DEL' THEN 0.81 WHEN 'BOM-BLR' THEN 0.74 WHEN 'BLR-BOM' THEN 0.74
    WHEN 'DEL-HYD' THEN 0.77 WHEN 'HYD-DEL' THEN 0.77 WHEN 'BLR-HYD' THEN 0.72 WHEN 'HYD-BLR' THEN 0.72 END::DOUBLE + CASE c WHEN 'AI' THEN 0.03 WHEN 'IX' THEN -0.02 WHEN 'QP' THEN -0.02 WHEN 'SG' THEN -0.04 ELSE 0.0 END::DOUBLE,
  CASE c WHEN '6E' THEN 0.78 WHEN 'AI' THEN 0.81 WHEN 'IX' THEN 0.76 WHEN 'QP' THEN 0.76 WHEN 'SG' THEN 0.74 END::DOUBLE) * 10000) / 10000.0::DOUBLE AS ratio FROM raw),
tagged AS (SELECT *, upper(trim(w)) AS u, round((t - computed) * 100) / 100.0::DOUBLE AS rest FROM (SELECT *, round(t * least(greatest(ratio, 0.60::DOUBLE), 0.90::DOUBLE) * 100) / 100.0::DOUBLE AS computed FROM rated)),
named AS (SELECT *, CASE WHEN u IS NULL THEN 'T+1' WHEN regexp_matches(u, '^[0-9]+$') THEN 'T+' || u WHEN u IN ('T1', 'T7', 'T15', 'T30', 'T45') THEN 'T+' || substr(u, 2) ELSE u END AS win,
  CASE seq2 % 3 WHEN 0 THEN 'measured' WHEN 1 THEN 'residual' ELSE 'calibrated' END AS basis FROM tagged)
SELECT seq1, seq2, seq4, o AS origin, d AS destination, c AS airline_code, upper(f) AS flight_number, win AS booking_window, strftime(flight_date, '%Y-%m-%d') AS flight_date, t AS total_fare,
  CASE seq2 % 3 WHEN 0 THEN b WHEN 1 THEN b ELSE computed END AS base_fare, CASE seq2 % 3 WHEN 0 THEN x WHEN 1 THEN round((t - b) * 100) / 100.0::DOUBLE ELSE rest END AS taxes_and_fees, basis AS fare_split_basis,
  CASE seq1 % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'B' END AS booking_class, CASE WHEN seq2 % 2 = 0 THEN 'cancelled' END AS flight_status, CASE WHEN seq4 % 2 = 0 THEN 1 ELSE 0 END AS stops,
  CASE WHEN seq4 % 3 = 0 THEN 'Business' ELSE 'Economy' END AS fare_class, CASE WHEN seq4 % 2 = 0 THEN 'portal' ELSE 'synthetic' END AS source_platform,
  sha256(c || ':' || upper(f) || ':' || o || ':' || d || ':' || strftime(event_time, '%Y-%m-%dT%H:%M:%S') || ':' || win) AS hash_id FROM named"""))
def record_normalized(spark, sf_dir):
    """Raw rows as stored records: codes, window, times, split (of both parts, one or neither), classes, defaults and fingerprint in one pass."""
    known = F.create_map(*(F.lit(x) for pair in {"AFRICA": "del", "AMERICA": "bom", "ASIA": "blr", "EUROPE": "hyd", "MIDDLE EAST": "xxx"}.items() for x in pair))
    text = lambda c: c.cast("string")
    third = F.col("seq2") % 3
    raw = quotes(spark, sf_dir).select(
        "seq1",
        "seq2",
        "seq4",
        F.concat(F.lit(" "), known[F.col("origin")]).alias("origin"),
        known[F.col("destination")].alias("destination"),
        F.lower("carrier").alias("airline_code"),
        F.concat(F.lit("f"), text(F.col("flight_no")), F.lit(" ")).alias("flight_number"),
        variant(TAGS, "seq1").alias("booking_window"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss").alias("departure_time"),
        F.date_format("flight_date", "yyyy-MM-dd'T00:00'").alias("flight_date"),
        text(F.col("total_fare")).alias("total_fare"),
        F.when(third.isin(0, 1), text(scoring.rounded(F.col("total_fare") * 0.7, 2))).alias("base_fare"),
        F.when(third == 0, text(scoring.rounded(F.col("total_fare") * 0.2, 2))).alias("taxes_and_fees"),
        F.lit(None).cast("string").alias("fare_split_basis"),
        variant([" y", "b", "", None], "seq1").alias("booking_class"),
        F.when(F.col("seq2") % 2 == 0, " CANCELED").alias("flight_status"),
        F.when(F.col("seq4") % 2 == 0, "1").alias("stops"),
        F.when(F.col("seq4") % 3 == 0, " Business ").alias("fare_class"),
        F.when(F.col("seq4") % 2 == 0, "portal").otherwise(" ").alias("source_platform"),
    )
    out = records.normalized(raw, ["seq1", "seq2", "seq4"]).drop("departure_time")
    return out.withColumn("flight_date", F.date_format("flight_date", "yyyy-MM-dd"))


@query(with_quotes(f"""
, raw AS (SELECT seq1, seq2, seq4, CASE WHEN seq1 % 7 = 0 THEN 'DELHI' ELSE {AIRPORT_SQL.format(c='origin')} END AS o, CASE WHEN seq1 % 5 = 0 THEN 'BOM' ELSE {AIRPORT_SQL.format(c='destination')} END AS d, carrier, CASE WHEN seq2 % 6 = 0 THEN ' ' ELSE 'F1' END AS f,
  CASE WHEN seq2 % 9 = 0 THEN 0 ELSE total_fare END AS fare, event_time AS departure, flight_date AS arrival FROM quotes)
SELECT seq1, seq2, seq4, concat_ws(';', CASE WHEN fare > 0 THEN NULL ELSE 'fare' END, CASE WHEN length(o) = 3 THEN NULL ELSE 'origin code' END, CASE WHEN o IN ('DEL', 'BOM', 'BLR', 'HYD') THEN NULL ELSE 'origin' END,
  CASE WHEN d IN ('DEL', 'BOM', 'HYD', 'XXX') THEN NULL ELSE 'destination' END, CASE WHEN o != d THEN NULL ELSE 'same place' END, CASE WHEN carrier IN ('6E', 'AI', 'IX') THEN NULL ELSE 'carrier' END,
  CASE WHEN trim(f) != '' THEN NULL ELSE 'flight number' END, CASE WHEN arrival > departure THEN NULL ELSE 'chronology' END) AS reasons FROM raw"""))
def record_failures(spark, sf_dir):
    """Every check that a record fails, by name: fare, places and their membership, carrier, number, chronology."""
    known = F.create_map(*(F.lit(x) for pair in {"AFRICA": "DEL", "AMERICA": "BOM", "ASIA": "BLR", "EUROPE": "HYD", "MIDDLE EAST": "XXX"}.items() for x in pair))
    o, d = F.when(F.col("seq1") % 7 == 0, "DELHI").otherwise(known[F.col("origin")]), F.when(F.col("seq1") % 5 == 0, "BOM").otherwise(known[F.col("destination")])
    number, fare = F.when(F.col("seq2") % 6 == 0, " ").otherwise("F1"), F.when(F.col("seq2") % 9 == 0, 0.0).otherwise(F.col("total_fare"))
    failed = records.failures(o, d, F.col("carrier"), number, fare, F.col("event_time"), F.col("flight_date").cast("timestamp"), ["DEL", "BOM", "BLR", "HYD"], ["6E", "AI", "IX"], ["DEL", "BOM", "HYD", "XXX"])
    return quotes(spark, sf_dir).select("seq1", "seq2", "seq4", F.array_join(failed, ";").alias("reasons"))


@query(with_quotes(ALERT_SQL + """
SELECT CASE carrier WHEN '6E' THEN 'IndiGo' WHEN 'AI' THEN 'Air India' WHEN 'IX' THEN 'Air India Express' WHEN 'QP' THEN 'Akasa Air' ELSE 'ZZ' END AS carrier_name, count(*) AS n_quotes FROM (SELECT CASE carrier WHEN 'SG' THEN 'ZZ' ELSE carrier END AS carrier FROM eligible) GROUP BY 1"""))
def carrier_names(spark, sf_dir):
    """Quotes by carrier name; a carrier without one goes by its code."""
    e = quotes(spark, sf_dir).where(scoring.eligible(F.col("flight_status"))).select(F.when(F.col("carrier") == "SG", "ZZ").otherwise(F.col("carrier")).alias("carrier"))
    names = spark.createDataFrame(list(C.CARRIER_NAMES.items()), "carrier string, carrier_name string")
    return e.join(names, "carrier", "left").groupBy(F.coalesce("carrier_name", "carrier").alias("carrier_name")).agg(F.count("*").alias("n_quotes"))


# -- sources ----------------------------------------------------------------------------------------


@query(with_quotes("""
SELECT route_code, portal, count(*) AS n FROM quotes WHERE flight_date = DATE '1997-05-05' OR CAST(event_time AS DATE) = DATE '1997-05-05' GROUP BY ALL"""))
def day_load(spark, sf_dir):
    """The quotes of a day: flown on it or captured on it."""
    rows = store.of_day(quotes(spark, sf_dir), "1997-05-05", "flight_date", "event_time", [F.desc("event_time")])
    return rows.groupBy("route_code", "portal").agg(F.count("*").alias("n"))


@query(with_quotes("""
SELECT route_code, count(*) AS n FROM (SELECT * FROM quotes ORDER BY event_time DESC, seq1, seq2, seq3, seq4, flight_date, total_fare LIMIT 500) GROUP BY 1"""))
def day_load_fallback(spark, sf_dir):
    """A day without quotes: the newest ones take their place (a top-k report)."""
    rows = store.of_day(quotes(spark, sf_dir), "2050-01-01", "flight_date", "event_time", [F.desc("event_time"), *SEQUENCE], 500)
    return rows.groupBy("route_code").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_id > 250 ORDER BY event_id LIMIT 100")
def tail_by_id(spark, sf_dir):
    """What came after the last id that was read (a page)."""
    return page(table(spark, sf_dir, "events").where("event_id > 250"), ["event_id"], 100).select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(with_quotes("""
SELECT carrier, booking_window, count(*) AS n, CAST(sum(lead_days * 60 + 15) AS BIGINT) AS minutes, CAST(sum(CASE WHEN seq4 % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stops, CAST(sum(CAST(round(total_fare * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(seq4 + 2.5) * 10 AS BIGINT) AS tax_tenths, min(origin) AS first_origin, max(destination) AS last_destination FROM quotes GROUP BY ALL"""))
def offers_parse(spark, sf_dir):
    """Quotes written as offers with itineraries, segments and taxes, and parsed back."""
    place = lambda c: F.struct(c.alias("iataCode"))
    leg = lambda a, b: F.struct(F.col("carrier").alias("carrierCode"), place(a).alias("departure"), place(b).alias("arrival"))
    legs = F.when(F.col("seq4") % 2 == 0, F.array(leg(F.col("origin"), F.lit("VIA")), leg(F.lit("VIA"), F.col("destination")))).otherwise(F.array(leg(F.col("origin"), F.col("destination"))))
    trip = F.struct(F.concat(F.lit("PT"), F.col("lead_days").cast("string"), F.lit("H15M")).alias("duration"), legs.alias("segments"))
    tax = lambda c: F.struct(c.cast("string").alias("amount"))
    price = F.struct(F.col("total_fare").cast("string").alias("total"), F.array(tax(F.col("seq4")), tax(F.lit(2.5)), tax(F.lit("?"))).alias("taxes"))
    raw = quotes(spark, sf_dir).select("booking_window", F.to_json(F.struct(F.array(trip).alias("itineraries"), price.alias("price"))).alias("payload"))
    o = parsers.offers(raw, "payload")
    return o.groupBy("carrier", "booking_window").agg(
        F.count("*").alias("n"),
        F.sum("minutes").alias("minutes"),
        F.sum("stops").alias("stops"),
        F.sum(F.round(F.col("total_fare") * 100).cast("long")).alias("cents"),
        (F.sum("taxes") * 10).cast("long").alias("tax_tenths"),
        F.min("origin").alias("first_origin"),
        F.max("destination").alias("last_destination"),
    )


@query(with_quotes("""
, fares AS (SELECT portal, CASE WHEN seq2 % 3 = 0 AND seq4 % 2 = 0 THEN least(total_fare, total_fare * 0.5) WHEN seq2 % 3 = 0 THEN total_fare WHEN seq4 % 2 = 0 THEN total_fare * 0.5 END AS fare FROM quotes)
SELECT portal, count(*) AS n, count(fare) AS n_bookable, CAST(sum(CAST(round(fare * 100) AS BIGINT)) AS BIGINT) AS cents FROM fares GROUP BY 1"""))
def bookable_parse(spark, sf_dir):
    """Journeys with nested fare buckets: the cheapest adult fare with a seat, null where none has one."""
    bucket = lambda key, seats, kind: F.struct(F.lit(key).alias("key"), seats.cast("int").alias("available"), F.lit(kind).alias("type"))
    fares = F.create_map(F.lit("a"), bucket("k1", F.when(F.col("seq2") % 3 == 0, 2).otherwise(0), "ADT"), F.lit("b"), bucket("k2", F.when(F.col("seq4") % 2 == 0, 1).otherwise(0), "ADT"), F.lit("c"), bucket("k3", F.lit(9), "CHD"))
    prices = F.create_map(F.lit("k1"), F.col("total_fare"), F.lit("k2"), F.col("total_fare") * 0.5, F.lit("k3"), F.lit(1.0))
    journey = F.struct(F.lit("1").alias("number"), fares.alias("fares"))
    raw = quotes(spark, sf_dir).select("portal", F.to_json(F.struct(F.array(journey).alias("journeys"), prices.alias("prices"))).alias("payload"))
    j = parsers.cheapest_bookable(raw, "payload")
    return j.groupBy("portal").agg(F.count("*").alias("n"), F.count("fare").alias("n_bookable"), F.sum(F.round(F.col("fare") * 100).cast("long")).alias("cents"))


@query(with_quotes(VOLUMES_SQL + """,
w AS (SELECT *, round(pax / sum(pax) OVER (PARTITION BY period), 6) AS w0, row_number() OVER (PARTITION BY period ORDER BY pax DESC, route_code) AS rank FROM volumes),
r AS (SELECT *, 1 - sum(w0) OVER (PARTITION BY period) AS rest FROM w)
SELECT strftime(period, '%Y-%m') AS year_month, route_code, pax AS pax_volume, rank, round(CASE WHEN rank = 1 THEN w0 + rest ELSE w0 END, 6) AS share_weight, CASE WHEN pax % 2 = 0 THEN 'official' END AS provenance FROM r"""))
def traffic_round_trip(spark, sf_dir):
    """Volumes exported to CSV and read again under other header names, with weights made anew."""
    path = scratch.new_path(spark, "traffic")
    rows = volumes(spark, sf_dir).select(F.date_format("period", "yyyy-MM").alias("month"), F.col("route_code").alias("corridor"), F.col("pax").alias("passengers"), F.when(F.col("pax") % 2 == 0, "official").alias("origin_of_data"))
    parsers.write_table(rows, path)
    t = parsers.read_traffic(spark, path)
    return t.select("year_month", "route_code", "pax_volume", F.col("rank").cast("long").alias("rank"), "share_weight", "provenance")


@query(f"""
WITH {BENCHMARK_SQL.strip()}
SELECT strftime(a.month, '%Y-%m') AS year_month, strftime(a.month + INTERVAL 1 MONTH + INTERVAL 11 DAY, '%Y-%m-%d') AS published, round((a.cpi - b.cpi) / b.cpi * 100, 4) AS mom_pct, round((a.cpi - y.cpi) / y.cpi * 100, 4) AS yoy_pct
FROM bench a LEFT JOIN bench b ON b.month = a.month - INTERVAL 1 MONTH LEFT JOIN bench y ON y.month = a.month - INTERVAL 12 MONTH""")
def cpi_round_trip(spark, sf_dir):
    """A monthly index exported and read again: publication and changes against calendar neighbours."""
    path = scratch.new_path(spark, "cpi")
    parsers.write_table(benchmark_months(spark, sf_dir).select(F.date_format("month", "yyyy-MM").alias("period"), F.col("cpi").alias("cpi_transport")), path)
    c = parsers.read_cpi(spark, path)
    return c.select("year_month", F.date_format("published", "yyyy-MM-dd").alias("published"), F.round("mom_pct", 4).alias("mom_pct"), F.round("yoy_pct", 4).alias("yoy_pct"))


@query(f"""
WITH given AS (SELECT o_orderkey % 4 AS k, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey % 3 AS j, o_orderkey % 50 AS v FROM orders)
SELECT CASE k WHEN 0 THEN m WHEN 1 THEN m WHEN 2 THEN m END AS period, CASE j WHEN 0 THEN v WHEN 1 THEN v END::DOUBLE AS value, count(*) AS n FROM given GROUP BY ALL""")
def monthly_fields(spark, sf_dir):
    """Month and value of rows that carry them under different names; what is nowhere is null."""
    k, j, v = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3, (F.col("o_orderkey") % 50).cast("string")
    m, d = F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = orders(spark, sf_dir).select(F.when(k == 0, m).alias("period"), F.when(k == 1, m).alias("month"), F.when(k == 2, d).alias("date"), F.when(j == 0, v).alias("cpi_transport"), F.when(j == 1, v).alias("index_value"))
    a = parsers.aligned(raw, {"when": ["period", "month", "date"], "value": ["cpi_transport", "cpi", "index_value"]})
    return a.groupBy(F.left("when", F.lit(7)).alias("period"), F.col("value").try_cast("double").alias("value")).agg(F.count("*").alias("n"))


SOURCES = ["https://example.org/note", "MOSPI", " official ", None, "press note", "see http://example.org"]


@query(f"""
WITH given AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, {variant_sql(SOURCES)} AS source, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 100.0 ELSE o_orderkey END::DOUBLE AS value FROM orders),
cited AS (SELECT *, coalesce((contains(source, 'http://') OR contains(source, 'https://')) AND lower(trim(source)) NOT IN ('mospi', 'mospi_official', 'nso', 'official'), false) AS ok FROM given),
reasoned AS (SELECT CASE WHEN lower(trim(source)) IN ('mospi', 'mospi_official', 'nso', 'official') THEN 'bare label' WHEN month = '1995-03' AND value = 100.0 THEN 'withdrawn value of 1995-03' WHEN month = '1996-07' AND value = 100.0 THEN 'withdrawn value of 1996-07' END AS reason,
  CASE WHEN NOT ok THEN 'no citation' WHEN value IS NULL THEN 'no value' WHEN value = 100.0 THEN 'placeholder' END AS lack FROM cited)
SELECT 'published' AS rule, reason, count(*) AS n FROM reasoned WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'strict', lack, count(*) FROM reasoned WHERE lack IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'latest', 'latest cited', count(*) FROM cited WHERE month = (SELECT max(month) FROM cited) AND ok""")
def citation_gate(spark, sf_dir):
    """Reference rows that can't be relied on, by reason, and how many of the latest month are cited.

    The published rule refuses bare labels, and withdrawn values in their month; the strict one tells all rows without a citation or a real value.
    """
    value = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 1, 100.0).otherwise(F.col("o_orderkey").cast("double"))
    rows = orders(spark, sf_dir).select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), variant(SOURCES).alias("source"), value.alias("value"))
    unsound = checks.unsound_references(rows, "month", "source", {"value": {"1995-03": 100.0, "1996-07": 100.0}}).groupBy("reason").agg(F.count("*").alias("n"))
    lacking = checks.unsupported_references(rows, "source", "value", [100.0]).groupBy("reason").agg(F.count("*").alias("n"))
    latest = checks.latest_cited(rows, "month", "source").agg(F.count("*").alias("n")).withColumn("reason", F.lit("latest cited"))
    named = lambda found, rule: found.select(F.lit(rule).alias("rule"), "reason", "n")
    return named(unsound, "published").unionByName(named(lacking, "strict")).unionByName(named(latest, "latest"))


# -- writes -----------------------------------------------------------------------------------------


@query(with_quotes("""
, stored AS (SELECT route_code, booking_window, CASE WHEN count(*) % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, max(total_fare) AS fare FROM quotes WHERE flight_date < DATE '1999-01-01' GROUP BY ALL),
fresh AS (SELECT route_code, booking_window, 'OPEN' AS status, max(total_fare) AS fare FROM quotes WHERE flight_date >= DATE '1999-01-01' AND origin != 'ASIA' GROUP BY ALL),
merged AS (SELECT coalesce(s.route_code, f.route_code) AS route_code, coalesce(s.booking_window, f.booking_window) AS booking_window, coalesce(f.status, s.status) AS status, coalesce(f.fare, s.fare) AS fare
  FROM (SELECT * FROM stored WHERE status = 'OPEN') s FULL JOIN fresh f ON s.route_code = f.route_code AND s.booking_window = f.booking_window UNION ALL SELECT * FROM stored WHERE status = 'CLOSED')
SELECT route_code, booking_window, status, fare FROM merged"""))
def open_alert_upsert(spark, sf_dir):
    """Alerts into a stored table: only open ones of the same key are replaced, closed ones stay beside a new one."""
    q, keys = quotes(spark, sf_dir), ["route_code", "booking_window"]
    stored = q.where("flight_date < date'1999-01-01'").groupBy(*keys).agg(F.when(F.count("*") % 3 == 0, "CLOSED").otherwise("OPEN").alias("status"), F.max("total_fare").alias("fare"))
    fresh = q.where("flight_date >= date'1999-01-01' and origin != 'ASIA'").groupBy(*keys).agg(F.lit("OPEN").alias("status"), F.max("total_fare").alias("fare"))
    return store.upsert_where(stored, fresh, keys, F.col("status") == "OPEN")


@query(with_quotes(ALL_SQL + """,
given AS (SELECT period, laspeyres, paasche, CASE WHEN month(period) = 1 THEN 0.5::DOUBLE END AS bias FROM numbers WHERE year(period) >= 1998),
old AS (SELECT period, laspeyres, paasche, -1.0::DOUBLE AS bias FROM numbers WHERE year(period) <= 1998)
SELECT strftime(period, '%Y-%m-%d') AS period, round(coalesce(bias, laspeyres - paasche), 4) AS bias FROM given UNION ALL SELECT strftime(period, '%Y-%m-%d'), bias FROM old WHERE period NOT IN (SELECT period FROM given)"""))
def index_upsert(spark, sf_dir):
    """Index rows into a stored table by period; a bias that is not given is the gap of the two indices."""
    n = numbers(spark, sf_dir).select("period", "laspeyres", "paasche")
    given = n.where("year(period) >= 1998").withColumn("bias", F.coalesce(F.when(F.month("period") == 1, 0.5), F.col("laspeyres") - F.col("paasche")))
    old = n.where("year(period) <= 1998").withColumn("bias", F.lit(-1.0))
    return store.replace_by_key(old, given, ["period"]).select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("bias", 4).alias("bias"))


@query(with_quotes("""
, rated AS (SELECT carrier, booking_window, max(total_fare) AS fare, CASE WHEN min(seq2) % 2 = 0 THEN 0 ELSE median(total_fare) END AS middle FROM quotes GROUP BY ALL)
SELECT carrier, booking_window, CASE WHEN middle > 0 THEN round(fare / middle * 100) / 100.0::DOUBLE ELSE 1.0 END AS surge_multiple, CASE WHEN carrier = 'AI' THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM rated"""))
def violation_append(spark, sf_dir):
    """Violations appended to a stored table with their multiple (1 without a median), twice, then those of one carrier set to resolved."""
    r = quotes(spark, sf_dir).groupBy("carrier", "booking_window").agg(F.max("total_fare").alias("fare"), F.when(F.min("seq2") % 2 == 0, 0.0).otherwise(F.median("total_fare")).alias("middle"))
    rows = r.select("carrier", "booking_window", F.when(F.col("middle") > 0, scoring.rounded(F.col("fare") / F.col("middle"), 2)).otherwise(1.0).alias("surge_multiple"), F.lit("OPEN").alias("status"))
    rows, keys = written(rows, "violations"), ["carrier", "booking_window"]
    target = Store(spark, scratch.new_path(spark, "violations"), "carrier")
    for _ in range(2):
        target.upsert("violations", rows, keys, when=F.lit(False))
    target.upsert("violations", rows.where("carrier = 'AI'").withColumn("status", F.lit("RESOLVED")), keys, when=F.col("status") == "OPEN")
    return target.read("violations", rows.schema)


@query(with_telemetry("""
SELECT crawler, status, count(*) AS n, CAST(sum(greatest(records_extracted - 50, 0)) AS BIGINT) AS records, count(*) FILTER (response_time_ms - 100 < 0) AS n_clamped FROM telemetry GROUP BY ALL"""))
def telemetry_append(spark, sf_dir):
    """Telemetry appended to a stored table in two batches, the first of them twice: negative counts and times become 0."""
    t = telemetry(spark, sf_dir).withColumns({"records": F.greatest(F.col("records_extracted") - 50, F.lit(0)), "time": F.greatest(F.col("response_time_ms") - 100, F.lit(0.0))})
    target = Store(spark, scratch.new_path(spark, "telemetry"), "batch")
    for batch in (0, 1, 0):
        target.replace("telemetry", t.where(F.col("event_id") % 2 == batch).withColumn("batch", F.lit(batch)), [batch])
    stored = target.read("telemetry", t.withColumn("batch", F.lit(0)).schema)
    return stored.groupBy("crawler", "status").agg(F.count("*").alias("n"), F.sum("records").alias("records"), F.count_if((F.col("time") == 0) & (F.col("response_time_ms") < 100)).alias("n_clamped"))


@query(with_quotes(VOLUMES_SQL + """,
shares AS (SELECT period, route_code, CASE WHEN pax % 5 = 0 THEN 0 ELSE pax END::DOUBLE / sum(pax) OVER (PARTITION BY period) AS share FROM volumes),
sums AS (SELECT period, sum(share) AS total FROM shares GROUP BY 1)
SELECT 'weights' AS problem, strftime(period, '%Y-%m-%d') AS what FROM sums WHERE abs(total - 1) > 1e-6
UNION ALL SELECT 'missing', p || ' ' || r FROM (SELECT DISTINCT strftime(period, '%Y-%m-%d') AS p FROM volumes) CROSS JOIN (SELECT DISTINCT route_code AS r FROM volumes) WHERE NOT EXISTS (SELECT 1 FROM volumes v WHERE strftime(v.period, '%Y-%m-%d') = p AND v.route_code = r)"""))
def weights_verified(spark, sf_dir):
    """What is wrong with a table of weights: periods that don't add up to one, corridors without a row."""
    v = volumes(spark, sf_dir).withColumn("period", F.date_format("period", "yyyy-MM-dd"))
    totals = v.groupBy("period").agg(F.sum("pax").alias("total"))  # a row a period
    shares = v.join(totals, "period").select("period", "route_code", (F.when(F.col("pax") % 5 == 0, 0).otherwise(F.col("pax")).cast("double") / F.col("total")).alias("share"))
    off = checks.weights_off(shares, "period", "share").select(F.lit("weights").alias("problem"), F.col("period").alias("what"))
    return off.unionByName(checks.missing_pairs(v, "period", "route_code").select(F.lit("missing").alias("problem"), F.concat_ws(" ", "period", "route_code").alias("what")))


# -- defaults and variants --------------------------------------------------------------------------


@query(with_quotes(ALL_SQL + """,
of_routes AS (SELECT c.*, CASE WHEN starts_with(route_code, 'ASIA') THEN NULL ELSE 0.2 END::DOUBLE AS weight, first_value(composite) OVER (PARTITION BY route_code ORDER BY period) AS base FROM composites c)
SELECT strftime(period, '%Y-%m-%d') AS period, round(sum(composite * coalesce(weight, 0.1)) / sum(coalesce(weight, 0.1)), 4) AS national_mean, round(sum(coalesce(weight, 0) * composite / base) / nullif(sum(coalesce(weight, 0)), 0) * 100, 4) AS national_index FROM of_routes GROUP BY 1"""))
def national_mean(spark, sf_dir):
    """Routes without a weight count 0.1 in the national mean and nothing in the index."""
    c = index.with_base(composites(spark, sf_dir), "route_code", "period", "composite")
    c = c.withColumns({"weight": F.when(~F.col("route_code").startswith("ASIA"), 0.2), "relative": F.col("composite") / F.col("base_composite") * 100})
    both = index.weighted_mean(c, ["period"], "composite", "weight", 0.1).withColumnRenamed("mean", "m").join(index.weighted_mean(c, ["period"], "relative", "weight", 0.0), "period")
    return both.select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("m", 4).alias("national_mean"), F.round("mean", 4).alias("national_index"))


@query(with_quotes("""
SELECT route_code, median(total_fare) AS fare FROM eligible WHERE booking_window = 'T+7' GROUP BY 1"""))
def median_without_weights(spark, sf_dir):
    """A weighted median whose weights are all 0 is the plain median."""
    rows = quotes(spark, sf_dir).where(scoring.eligible(F.col("flight_status")) & (F.col("booking_window") == "T+7")).withColumn("weight", F.lit(0.0))
    return index.weighted_median(rows, ["route_code"], "total_fare", "weight").select("route_code", "fare")


SHARES = {"T+1": 0.12, "T+15": 0.25, "T+30": 0.20}


@query(with_quotes("""
, leads AS (SELECT route_code, lead_days, avg(total_fare) AS price, coalesce(CASE booking_window WHEN 'T+1' THEN 0.12 WHEN 'T+15' THEN 0.25 WHEN 'T+30' THEN 0.20 END, 0.20)::DOUBLE AS share FROM eligible GROUP BY route_code, lead_days, booking_window),
steps AS (SELECT *, lag(price) OVER w AS p1, lag(share) OVER w AS q1 FROM leads WINDOW w AS (PARTITION BY route_code ORDER BY lead_days DESC))
SELECT route_code, CAST(lead_days AS BIGINT) AS lead_days, round(((share - q1) / ((share + q1) / 2)) / ((price - p1) / ((price + p1) / 2)), 4) + 0.0 AS arc FROM steps WHERE p1 IS NOT NULL"""))
def share_elasticity(spark, sf_dir):
    """Elasticity of passenger shares by window; a window without a share has the default 0.20."""
    e = quotes(spark, sf_dir).where(scoring.eligible(F.col("flight_status"))).groupBy("route_code", "lead_days", "booking_window").agg(F.avg("total_fare").alias("price"))
    shares = spark.createDataFrame(list(SHARES.items()), "booking_window string, share double")
    rows = e.join(shares, "booking_window", "left").withColumn("share", F.coalesce("share", F.lit(0.20)))
    a = series.arc_elasticity(rows, ["route_code"], "lead_days", "price", "share").where("arc is not null")
    return a.select("route_code", F.col("lead_days").cast("long").alias("lead_days"), (F.round("arc", 4) + 0.0).alias("arc"))


@query(with_quotes(MONTHS_SQL + """,
groups AS (SELECT year(month) AS y, CASE WHEN year(month) % 3 = 0 THEN 1.0 ELSE ours END::DOUBLE AS ours, cpi FROM pairs),
stats AS (SELECT y, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(ours) > 0 AND stddev_pop(cpi) > 0 THEN corr(ours, cpi) END AS r FROM groups GROUP BY 1)
SELECT CAST(y AS BIGINT) AS year, n, round(coalesce(r, 1.0), 4) AS engine, round(r, 4) AS nullable, round(CASE WHEN n >= 3 THEN r END, 4) AS of_three FROM stats"""))
def correlation_variants(spark, sf_dir):
    """Correlation by year in its variants: 1 or null where undefined, and of three pairs at least."""
    p = pairs(spark, sf_dir).select(F.year("month").cast("long").alias("year"), F.when(F.year("month") % 3 == 0, 1.0).otherwise(F.col("ours")).alias("x"), F.col("cpi").alias("y"))
    x, y = F.col("x"), F.col("y")
    r = p.groupBy("year").agg(F.count("*").alias("n"), series.pearson(x, y, 2, 1.0).alias("engine"), series.pearson(x, y).alias("nullable"), series.pearson(x, y, 3).alias("of_three"))
    return r.select("year", "n", *(F.round(c, 4).alias(c) for c in ("engine", "nullable", "of_three")))


@query(with_quotes(LAGS_SQL + """,
whole AS (SELECT avg(ours) AS mx, avg(cpi) AS my, sqrt(count(*) * var_pop(ours) * count(*) * var_pop(cpi)) AS scale FROM numbered)
SELECT CAST(lag AS BIGINT) AS lag, round(sum((a.ours - mx) * (b.cpi - my)) / max(scale), 4) AS correlation FROM (SELECT unnest(range(-6, 7)) AS lag) l JOIN numbered a ON true JOIN numbered b ON b.i = a.i + lag CROSS JOIN whole GROUP BY 1"""))
def cross_correlation(spark, sf_dir):
    """Lagged correlation by the means and deviations of the whole series."""
    c = series.cross_correlation(pairs(spark, sf_dir), "month", "ours", "cpi", 6)
    return c.select(F.col("lag").cast("long").alias("lag"), F.round("correlation", 4).alias("correlation"))


@query(with_quotes(MONTHS_SQL + """,
changes AS (SELECT a.month, (a.ours - b.ours) / b.ours AS x, (a.cpi - b.cpi) / b.cpi AS y FROM pairs a JOIN pairs b ON b.month = a.month - INTERVAL 1 MONTH)
SELECT (SELECT count(*) FROM pairs) AS n, round((SELECT corr(ours, cpi) FROM pairs), 4) AS correlation, round((SELECT sqrt(avg((ours - cpi) * (ours - cpi))) FROM pairs), 4) AS rmse, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END) * 100, 4) AS agreement_pct FROM changes"""))
def backtest_run(spark, sf_dir):
    """The back-test of the monthly index against the benchmark: errors and agreement of direction."""
    from fareloom.plans.pipelines import backtest

    p = pairs(spark, sf_dir)
    out = backtest(p.select("month", F.col("ours").alias("value")), p.select("month", F.col("cpi").alias("value")))
    both = out["errors"].crossJoin(out["direction"].select("agreement_pct"))  # one row each
    return both.select("n", *(F.round(c, 4).alias(c) for c in ("correlation", "rmse", "agreement_pct")))


@query(with_quotes(GATED_SQL + " SELECT inputs, severity, kind, count(*) AS n FROM gated GROUP BY ALL"))
def alert_summary(spark, sf_dir):
    """Alerts by inputs (published and measured ones), severity and kind."""
    return alerts_by_inputs(spark, sf_dir).groupBy("inputs", "severity", "kind").agg(F.count("*").alias("n"))
