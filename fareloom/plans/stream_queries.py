"""Quotes replayed in order of arrival, as-of weights: queries on one flight or route of any size, each with its DuckDB twin."""

from pyspark.sql import functions as F

from fareloom.functions import normalize
from fareloom.operators import anomaly, arbitrage
from fareloom.operators.asof import as_of, period_or_latest
from fareloom.operators.layout import written
from fareloom.plans.fixtures import pick, quotes, table, with_quotes
from fareloom.plans.store_queries import VOLUMES_SQL, volumes
from fareloom.streaming import counters, dedup, venues

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


ARRIVAL = ["flight_date", "seq1", "seq2", "seq3", "seq4", "total_fare"]
FLIGHT_KEYS = ["route_code", "carrier", "flight_no"]
EVENT_TIME_SQL = "coalesce(CASE WHEN seq2 % 3 = 0 THEN event_time END, CASE WHEN seq2 % 3 < 2 THEN CAST(flight_date AS TIMESTAMP) END, CAST(flight_date AS TIMESTAMP) + INTERVAL 1 DAY)"


def arrived(spark, sf_dir):
    """Quotes with the event time of the stream (at): booking, else departure, else arrival."""
    departure = F.col("flight_date").cast("timestamp")
    booking = F.when(F.col("seq2") % 3 == 0, F.col("event_time").cast("timestamp"))
    known = F.coalesce(booking, F.when(F.col("seq2") % 3 < 2, departure), departure + F.expr("INTERVAL 1 DAY"))
    return quotes(spark, sf_dir).withColumn("at", known)


@query(with_quotes(f"""
, timed AS (SELECT *, {EVENT_TIME_SQL} AS event_at FROM quotes),
marked AS (SELECT *, max(event_at) OVER (ORDER BY flight_date, seq1, seq2, seq3, seq4, total_fare ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM timed)
SELECT route_code, count(*) AS n, count(*) FILTER (event_at < watermark) AS n_out_of_order, count(*) FILTER (event_at < watermark AND epoch(watermark) - epoch(event_at) > 864000) AS n_stale FROM marked GROUP BY 1"""))
def stream_order(spark, sf_dir):
    """Quotes behind the newest event time of the whole stream, and those that an opt-in drop of late ones loses."""
    rows = arrived(spark, sf_dir).select("route_code", "at", *ARRIVAL)
    q = anomaly.running_max_before(rows, "flight_date", ARRIVAL[1:], "at", "watermark")
    late = F.col("at") < F.col("watermark")
    stale = late & (F.unix_timestamp("watermark") - F.unix_timestamp("at") > 864_000)
    return q.groupBy("route_code").agg(F.count("*").alias("n"), F.count_if(late).alias("n_out_of_order"), F.count_if(stale).alias("n_stale"))


#: The state of a flight after each quote: of all quotes that no later one of their portal has replaced.
REPLAY_SQL = with_quotes(f"""
, timed AS (SELECT *, {EVENT_TIME_SQL} AS event_at, coalesce(flight_status, '') NOT IN ('cancelled', 'sold_out') AS payable FROM quotes),
placed AS (SELECT *, row_number() OVER (PARTITION BY route_code, carrier, flight_no ORDER BY flight_date, seq1, seq2, seq3, seq4, total_fare) AS i,
  max(event_at) OVER (ORDER BY flight_date, seq1, seq2, seq3, seq4, total_fare ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM timed),
linked AS (SELECT *, lead(i) OVER (PARTITION BY route_code, carrier, flight_no, portal ORDER BY i) AS replaced_at, lag(total_fare) OVER (PARTITION BY route_code, carrier, flight_no, portal ORDER BY i) AS own,
  min(i) OVER (PARTITION BY route_code, carrier, flight_no, portal) AS place FROM placed),
held AS (SELECT a.route_code, a.carrier, a.flight_no, a.i, count(*) AS n_portals, max(b.total_fare) AS most, min(b.total_fare) FILTER (b.payable) AS least, arg_min(b.portal, (b.total_fare, b.place)) FILTER (b.payable) AS best_portal
  FROM linked a JOIN linked b ON a.route_code = b.route_code AND a.carrier = b.carrier AND a.flight_no = b.flight_no AND b.i <= a.i AND (b.replaced_at IS NULL OR b.replaced_at > a.i) GROUP BY ALL),
states AS (SELECT *, lag(least) OVER (PARTITION BY route_code, carrier, flight_no ORDER BY i) AS previous_least FROM held),
replayed AS (SELECT l.route_code, l.carrier, l.flight_no, l.portal, l.seq1, l.seq2, l.seq3, l.seq4, l.total_fare, l.i = 1 AS new_flight, previous_least IS NULL OR coalesce(least < previous_least - 1e-6, false) AS new_minimum,
  coalesce(abs(own - l.total_fare) < 1e-6, false) AS duplicate_price, coalesce(event_at < seen, false) AS out_of_order, least, previous_least, best_portal, CAST(s.n_portals AS INT) AS n_portals,
  CASE WHEN s.n_portals > 1 AND least > 0 THEN round(most - least, 2) END AS spread FROM linked l JOIN states s USING (route_code, carrier, flight_no, i))""")


def replayed(spark, sf_dir, keep, seen="watermark"):
    """Quotes after their replay with the columns ``keep``; without ``seen``, out_of_order goes by the flight alone."""
    rows = arrived(spark, sf_dir).select(*FLIGHT_KEYS, "portal", "at", "flight_status", *ARRIVAL)
    marked = anomaly.running_max_before(rows, "flight_date", ARRIVAL[1:], "at", "watermark") if seen else rows
    return dedup.replay(marked, FLIGHT_KEYS, "portal", "at", "total_fare", "flight_status", ARRIVAL, seen=seen, keep=keep)


@query(REPLAY_SQL + " SELECT *, CAST(new_flight AS INT) AS first, round(spread / least * 100, 4) AS spread_pct FROM replayed")
def quote_replay(spark, sf_dir):
    """Every quote with its flags and its flight's state after it, in order of arrival."""
    shown = ["new_flight", "new_minimum", "duplicate_price", "out_of_order", "least", "previous_least", "best_portal", "n_portals", "spread", "spread_pct"]
    given = [*FLIGHT_KEYS, "portal", "seq1", "seq2", "seq3", "seq4", "total_fare"]
    found = replayed(spark, sf_dir, given).select(*given, *shown)
    return found.withColumn("first", F.col("new_flight").cast("int"))


@query(REPLAY_SQL + " SELECT portal, count(*) AS n, count(*) FILTER (new_minimum) AS n_new_minimum, count(*) FILTER (duplicate_price) AS n_duplicate FROM replayed GROUP BY 1")
def stream_flags(spark, sf_dir):
    """New minima and repeated prices by portal: against the last payable quote of each portal of the flight."""
    q = replayed(spark, sf_dir, ["portal"], seen=None)
    return q.groupBy("portal").agg(F.count("*").alias("n"), F.count_if("new_minimum").alias("n_new_minimum"), F.count_if("duplicate_price").alias("n_duplicate"))


@query(REPLAY_SQL + " SELECT count(*) AS processed, count(*) FILTER (duplicate_price) AS duplicates, count(*) FILTER (new_minimum) AS minima, count(*) FILTER (out_of_order) AS out_of_order FROM replayed")
def stream_counters(spark, sf_dir):
    """The counters of the stream over all quotes."""
    return replayed(spark, sf_dir, []).agg(*counters.counts())


@query(with_quotes("""
, last AS (SELECT *, row_number() OVER (PARTITION BY route_code, carrier, flight_no, portal ORDER BY flight_date DESC, seq1 DESC, seq2 DESC, seq3 DESC, seq4 DESC, total_fare DESC) AS rn FROM quotes),
flights AS (SELECT route_code, carrier, flight_no, min(total_fare) FILTER (coalesce(flight_status, '') NOT IN ('cancelled', 'sold_out')) AS least, max(total_fare) AS most, max(flight_date) AS newest, count(*) AS n_portals FROM last WHERE rn = 1 GROUP BY ALL),
spread AS (SELECT *, CASE WHEN n_portals > 1 AND least > 0 THEN round(most - least, 2) END AS gap FROM flights)
SELECT sha256(carrier || ':' || flight_no || ':' || route_code) AS hash_id, route_code, carrier, flight_no, least, n_portals, gap AS spread, round(gap / least * 100, 4) AS spread_pct FROM spread WHERE newest >= (SELECT max(newest) FROM flights) - INTERVAL 30 DAY"""))
def resolved_snapshot(spark, sf_dir):
    """Flights that are still held (a quote arrived in the last thirty days) with their hash, least payable fare and spread."""
    q = quotes(spark, sf_dir)
    order = F.struct(*ARRIVAL)
    last = q.groupBy(*FLIGHT_KEYS, "portal").agg(F.max_by(F.struct("total_fare", "flight_status"), order).alias("q"), F.max("flight_date").alias("newest"))
    least = F.min(F.when(dedup.payable(F.col("q.flight_status")), F.col("q.total_fare"))).alias("least")
    flights = last.groupBy(*FLIGHT_KEYS).agg(least, F.max("q.total_fare").alias("most"), F.max("newest").alias("newest"), F.count("*").alias("n_portals"))
    end = q.agg(F.max("flight_date").alias("end"))  # one row
    held = flights.crossJoin(end).where(F.col("newest") >= F.date_sub("end", 30))
    key = normalize.fingerprint(F.col("carrier"), F.col("flight_no"), F.col("route_code"))
    return dedup.with_spread(held).select(key.alias("hash_id"), *FLIGHT_KEYS, "least", "n_portals", "spread", "spread_pct")


#: Portals under the names that sources give them, and those that are a carrier's own.
SITES = ["indigo", " IndiGo ", "book-indigo.example", "spicejet.example", "air_india", "my-air_india", "Akasa_Air", "akasa.example", "ixigo", "makemytrip", "yatra", "carrier_direct"]
SITES_SQL = """
, sited AS (SELECT *, list_extract(['indigo', ' IndiGo ', 'book-indigo.example', 'spicejet.example', 'air_india', 'my-air_india', 'Akasa_Air', 'akasa.example', 'ixigo', 'makemytrip', 'yatra', 'carrier_direct'], CAST(seq2 % 12 + 1 AS INT)) AS site FROM quotes),
own AS (SELECT *, lower(trim(site)) IN ('indigo', 'spicejet', 'airindia', 'air_india', 'akasa', 'akasa_air', 'vistara', '6e', 'sg', 'ai', 'qp', 'uk', 'airline_direct', 'direct', 'carrier_direct') OR contains(lower(site), lower(carrier))
  OR contains(lower(site), CASE carrier WHEN '6E' THEN 'indigo' WHEN 'SG' THEN 'spicejet' WHEN 'AI' THEN 'air_india' WHEN 'QP' THEN 'akasa' ELSE 'no brand' END) AS direct FROM sited),
last_offer AS (SELECT *, coalesce(flight_status, '') NOT IN ('cancelled', 'sold_out') AS may FROM own QUALIFY row_number() OVER (PARTITION BY route_code, carrier, flight_no, site ORDER BY flight_date DESC, seq1 DESC, seq2 DESC, seq3 DESC, seq4 DESC, total_fare DESC) = 1),
by_flight AS (SELECT route_code, carrier, flight_no, count(*) AS n_portals, min(total_fare) FILTER (may) AS least, max(total_fare) AS most,
  min(total_fare) FILTER (may AND direct) AS direct_fare, arg_min(site, (total_fare, site)) FILTER (may AND direct) AS direct_portal, min(total_fare) FILTER (may AND NOT direct) AS agency_fare, arg_min(site, (total_fare, site)) FILTER (may AND NOT direct) AS agency_portal FROM last_offer GROUP BY ALL),
gaps AS (SELECT *, agency_fare - direct_fare AS gap FROM by_flight)"""


@query(with_quotes(SITES_SQL + """
SELECT route_code, carrier, flight_no, n_portals, least, CASE WHEN n_portals > 1 AND least > 0 THEN round(most - least, 2) END AS spread, direct_fare, agency_fare, round(gap / direct_fare * 100, 4) AS percent,
  CASE WHEN gap > 0 THEN direct_portal WHEN gap <= 0 THEN agency_portal END AS buy_at, CASE WHEN gap > 0 THEN agency_portal WHEN gap <= 0 THEN direct_portal END AS sell_at,
  CASE WHEN gap > 1e-4 THEN 'agency_premium' WHEN gap < -1e-4 THEN 'agency_discount' WHEN gap IS NOT NULL THEN 'parity' END AS direction FROM gaps"""))
def resolved_venues(spark, sf_dir):
    """Each portal's last offer of a flight, and the best of a carrier's own portals against the best of the agencies: where ``venue_stream`` ends."""
    q = quotes(spark, sf_dir).withColumn("site", pick(SITES, F.col("seq2") % 12))
    own = q.withColumn("direct", arbitrage.is_direct(F.col("site"), F.col("carrier")))
    found = venues.venues_batch(own, FLIGHT_KEYS, "site", "direct", "total_fare", "flight_status", ARRIVAL)
    return found.select(*FLIGHT_KEYS, "n_portals", "least", "spread", "direct_fare", "agency_fare", F.round("percent", 4).alias("percent"), "buy_at", "sell_at", "direction")


DATED_SQL = """
, dated AS (SELECT route_code, CAST(date_trunc('month', flight_date) + INTERVAL 1 MONTH AS DATE) AS valid_from, seq4 % 2 AS release, count(*) AS weight FROM quotes WHERE month(flight_date) % 4 != 1 GROUP BY ALL),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_code, valid_from ORDER BY release DESC) AS rn FROM dated) WHERE rn = 1)"""


@query(with_quotes(DATED_SQL + """
SELECT q.route_code, strftime(q.period, '%Y-%m-%d') AS period, count(*) AS n, count(w.weight) AS n_weighted, CAST(sum(w.weight) AS BIGINT) AS weight, strftime(max(w.valid_from), '%Y-%m-%d') AS newest
FROM quotes q ASOF LEFT JOIN newest w ON q.route_code = w.route_code AND q.flight_date >= w.valid_from GROUP BY 1, 2"""))
def weights_as_of(spark, sf_dir):
    """Quotes with the latest weight of their route that was valid on their day; some months have none, others two releases."""
    q = quotes(spark, sf_dir).select("route_code", "flight_date", "period", "seq4")
    valid = F.add_months(F.trunc("flight_date", "month"), 1)
    dated = q.where(F.month("flight_date") % 4 != 1).groupBy("route_code", valid.alias("valid_from"), (F.col("seq4") % 2).alias("release")).agg(F.count("*").alias("weight"))
    found = as_of(q, dated, ["route_code"], "flight_date", "valid_from", ["weight", "valid_from"], ties=("release",))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.groupBy("route_code", shown("period").alias("period")).agg(F.count("*").alias("n"), F.count("weight").alias("n_weighted"), F.sum("weight").alias("weight"), shown(F.max("valid_from")).alias("newest"))


@query(with_quotes(VOLUMES_SQL + """
, held AS (SELECT * FROM volumes WHERE quarter(period) != 2 AND period < DATE '1998-01-01'),
asked AS (SELECT date_trunc('quarter', o_orderdate) AS wanted, count(*) AS n_orders FROM orders GROUP BY 1),
used AS (SELECT wanted, n_orders, CASE WHEN CAST(wanted AS DATE) IN (SELECT period FROM held) THEN CAST(wanted AS DATE) ELSE (SELECT max(period) FROM held) END AS p FROM asked)
SELECT strftime(wanted, '%Y-%m-%d') AS wanted, strftime(p, '%Y-%m-%d') AS used, n_orders, count(*) AS n_routes, CAST(sum(pax) AS BIGINT) AS pax FROM used JOIN held ON period = p GROUP BY ALL"""))
def weights_of_period(spark, sf_dir):
    """The weights of each quarter asked for, and those of the latest quarter where that one has none."""
    some = written(volumes(spark, sf_dir).where("quarter(period) != 2 and period < date'1998-01-01'"), "period-weights")
    asked = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg(F.count("*").alias("n_orders"))
    used = period_or_latest(asked, some, "period").withColumnRenamed("period", "wanted")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    found = used.join(some, F.col("found_period") == F.col("period")).withColumn("used", F.col("found_period"))
    return found.groupBy(shown("wanted"), shown("used"), "n_orders").agg(F.count("*").alias("n_routes"), F.sum("pax").alias("pax"))
