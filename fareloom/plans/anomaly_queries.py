"""Queries on anomalies, violations, venues and lead times, each with its DuckDB twin."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions import scoring
from fareloom.operators import anomaly, arbitrage, index
from fareloom.plans.fixtures import SEQUENCE, quotes, with_quotes

QUERIES: dict = {}
SQL: dict = {}
KEYS = ["route_code", "booking_window"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def eligible(spark, sf_dir):
    return quotes(spark, sf_dir).where(scoring.eligible(F.col("flight_status")))


def daily(spark, sf_dir):
    """The mean fare of each route, window and day."""
    return eligible(spark, sf_dir).groupBy(*KEYS, "flight_date").agg(F.avg("total_fare").alias("fare"), F.min("lead_days").alias("lead_days"))


DAILY_SQL = """,
daily AS (SELECT route_code, booking_window, flight_date, avg(total_fare) AS fare, min(lead_days) AS lead_days FROM eligible GROUP BY ALL)"""
BASELINE_SQL = DAILY_SQL + """,
baseline AS (SELECT *, count(*) OVER w AS n_base, avg(fare) OVER w AS mean, CASE WHEN count(*) OVER w > 0 THEN coalesce(stddev_samp(fare) OVER w, 0) END AS deviation,
  last_value(fare) OVER w AS previous FROM daily WINDOW w AS (PARTITION BY route_code, booking_window ORDER BY flight_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))"""
Z_SQL = """CASE WHEN {d} <= 1e-9 THEN CASE WHEN abs(fare - mean) <= 1e-9 THEN 0.0::DOUBLE WHEN fare > mean THEN 999.0 ELSE -999.0 END ELSE (fare - mean) / {d} END"""
DOD_SQL = "CASE WHEN previous <= 0 THEN CASE WHEN fare > 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE (fare - previous) / previous END"
SCORED_SQL = BASELINE_SQL + f""",
scored AS (SELECT *, {Z_SQL.format(d='deviation')} AS z, {DOD_SQL} AS dod, {Z_SQL.format(d='(deviation * (1 + 0.35 * exp(-greatest(lead_days, 1) / 10.0::DOUBLE)))')} AS dz
  FROM (SELECT * REPLACE (coalesce(mean, fare) AS mean, coalesce(deviation, 0) AS deviation) FROM baseline))"""


def baselines(spark, sf_dir):
    return anomaly.rolling_days(daily(spark, sf_dir), KEYS, "flight_date", "fare", 30)


def scored(spark, sf_dir):
    """Days without a history are their own baseline: their Z is 0."""
    fare, mean, deviation = F.col("fare"), F.col("mean"), F.col("deviation")
    known = baselines(spark, sf_dir).withColumns({"mean": F.coalesce("mean", "fare"), "deviation": F.coalesce("deviation", F.lit(0.0))})
    return known.withColumns({"z": scoring.z_score(fare, mean, deviation), "dod": scoring.change(fare, F.col("previous")), "dz": scoring.dynamic_z(fare, mean, deviation, F.col("lead_days"))})


@query(with_quotes(BASELINE_SQL + """
SELECT route_code, booking_window, strftime(flight_date, '%Y-%m-%d') AS flight_date, n_base, round(mean, 4) AS mean, round(deviation, 4) AS deviation, round(previous, 4) AS previous FROM baseline"""))
def rolling_baseline_30d(spark, sf_dir):
    b = baselines(spark, sf_dir)
    return b.select(*KEYS, F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), "n_base", *(F.round(c, 4).alias(c) for c in ("mean", "deviation", "previous")))


@query(with_quotes(DAILY_SQL + """
SELECT route_code, booking_window, strftime(flight_date, '%Y-%m-%d') AS flight_date, count(*) OVER w AS n_base, round(avg(fare) OVER w, 4) AS mean FROM daily
WINDOW w AS (PARTITION BY route_code, booking_window ORDER BY flight_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"""))
def rolling_obs_30(spark, sf_dir):
    b = anomaly.rolling_rows(daily(spark, sf_dir), KEYS, "flight_date", "fare", 30)
    return b.select(*KEYS, F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), "n_base", F.round("mean", 4).alias("mean"))


@query(with_quotes(SCORED_SQL + """
SELECT route_code, booking_window, strftime(flight_date, '%Y-%m-%d') AS flight_date, round(z, 4) AS z, round(dod, 4) AS dod,
  CASE WHEN z >= 3 OR coalesce(dod, 0) >= 0.40 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM scored WHERE z >= 2 OR coalesce(dod, 0) >= 0.40"""))
def zscore_alerts(spark, sf_dir):
    level = scoring.severity(F.col("z"), F.col("dod"))
    s = scored(spark, sf_dir).withColumn("severity", level).where("severity is not null")
    return s.select(*KEYS, F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), F.round("z", 4).alias("z"), F.round("dod", 4).alias("dod"), "severity")


@query(with_quotes(SCORED_SQL + """
SELECT booking_window, count(*) AS n, round(avg(dz) FILTER (abs(dz) < 999), 4) AS mean_dz, count(*) FILTER (dz >= 2) AS n_high FROM scored GROUP BY 1"""))
def dynamic_z(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("booking_window").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.abs("dz") < 999, F.col("dz"))), 4).alias("mean_dz"), F.count_if(F.col("dz") >= 2).alias("n_high"))


HHI_SQL = """,
carriers AS (SELECT route_code, carrier, count(*) AS n FROM eligible GROUP BY ALL),
hhis AS (SELECT route_code, sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE AS hhi, count(*) AS n_carriers FROM carriers GROUP BY 1),
routes AS (SELECT route_code, count(*) AS n_peers, median(total_fare) AS route_median, quantile_cont(total_fare, 0.25) AS q1, quantile_cont(total_fare, 0.75) AS q3 FROM eligible GROUP BY 1)"""


def judgement_sql(source: str) -> str:
    """DuckDB twin of ``scoring.surge`` over ``source``: fare, mean, deviation, raw_dz, previous, route_median, n_peers, q1, q3, hhi."""
    return f""",
figures AS (SELECT *, round(raw_dz * 10000) / 10000.0::DOUBLE AS r_dz, CASE WHEN previous > 0 THEN round((fare - previous) / previous * 10000) / 10000.0::DOUBLE END AS r_dod,
  round(fare / CASE WHEN route_median > 0 THEN route_median WHEN mean > 0 THEN mean ELSE 5000.0 END * 1000) / 1000.0::DOUBLE AS multiple,
  CASE WHEN n_peers >= 4 THEN round(greatest(q1 - 1.5 * greatest(q3 - q1, 0), 0) * 100) / 100.0::DOUBLE ELSE round(greatest(mean - 2.5 * deviation, 0) * 100) / 100.0::DOUBLE END AS lower_fence,
  CASE WHEN n_peers >= 4 THEN round((q3 + 1.5 * greatest(q3 - q1, 0)) * 100) / 100.0::DOUBLE ELSE round((mean + 2.5 * deviation) * 100) / 100.0::DOUBLE END AS upper_fence FROM {source}),
rated AS (SELECT *, round(least(greatest(0.35 * least(greatest(r_dz / 3.5, 0), 1) + 0.25 * least(greatest((multiple - 1) / 1.5, 0), 1) + 0.20 * least(greatest(coalesce(r_dod, 0) / 0.5, 0), 1)
  + 0.10 * CASE WHEN fare > upper_fence OR (lower_fence > 0 AND fare < lower_fence) THEN 1.0 ELSE 0.0 END + 0.10 * least(greatest((hhi - 0.25) / 0.5, 0), 1), 0), 1) * 10000) / 10000.0::DOUBLE AS score,
  CASE WHEN multiple >= 2.5 THEN 'DGCA_CAR_TARIFF_CEILING_BREACH' WHEN r_dz >= 3 THEN 'DGCA_CAR_SECTION_3_SERIES_M_3SIGMA' WHEN r_dod >= 0.40 THEN 'DGCA_CAR_SERIES_M_EXCESSIVE_DOD'
    WHEN hhi >= 0.40 AND r_dz >= 2.5 THEN 'DGCA_ANTI_COMPETITIVE_SURGE' END AS violation FROM figures),
judged AS (SELECT *, CASE WHEN violation IS NOT NULL OR score >= 0.65 THEN 'CRITICAL' WHEN r_dz >= 2 OR r_dod >= 0.25 OR score >= 0.35 THEN 'WARNING' ELSE 'NORMAL' END AS level,
  CASE WHEN r_dz >= 4 OR multiple > 3.5 OR r_dod >= 0.75 THEN 'SEVERE' WHEN r_dz >= 3 OR multiple >= 2.5 OR r_dod >= 0.40 THEN 'CRITICAL' WHEN r_dz >= 2 THEN 'WARNING' ELSE 'NONE' END AS tier FROM rated)"""


RATED_SQL = SCORED_SQL + HHI_SQL + """,
given AS (SELECT s.* EXCLUDE (dz), dz AS raw_dz, round(hhi * 10000) / 10000.0::DOUBLE AS hhi, route_median, n_peers, q1, q3 FROM scored s JOIN hhis USING (route_code) JOIN routes USING (route_code))""" + judgement_sql("given")


def with_routes(rows, e):
    """``rows`` with their route's concentration, median and quartiles, a row a route."""
    p = F.percentile("total_fare", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    routes = e.groupBy("route_code").agg(F.count("*").alias("n_peers"), p.alias("p")).select("route_code", "n_peers", *(F.get("p", F.lit(k)).alias(n) for k, n in enumerate(("q1", "route_median", "q3"))))
    hhis = index.concentration(e, ["route_code"], "carrier").select("route_code", scoring.rounded(F.col("hhi"), 4).alias("hhi"))
    return rows.join(F.broadcast(routes.join(hhis, "route_code")), "route_code")


def judged(spark, sf_dir):
    """Scored days with their route's concentration, median and quartiles, and the rules they break."""
    rows = with_routes(scored(spark, sf_dir).drop("dod", "dz"), eligible(spark, sf_dir))
    c = {k: F.col(k) for k in ("fare", "mean", "deviation", "lead_days", "previous", "n_peers", "q1", "q3", "hhi")}
    s = scoring.surge(c["fare"], c["mean"], c["deviation"], c["lead_days"], c["previous"], F.col("route_median"), c["n_peers"], c["q1"], c["q3"], c["hhi"])
    rows = rows.withColumn("surge", s).select("*", "surge.*")
    return rows.withColumn("tier", scoring.rubric(F.col("dz"), F.col("multiple"), F.col("dod")))


@query(with_quotes(RATED_SQL + """
SELECT route_code, booking_window, strftime(flight_date, '%Y-%m-%d') AS flight_date, score, level, tier, coalesce(violation, 'NONE') AS violation FROM judged"""))
def surge_score(spark, sf_dir):
    return judged(spark, sf_dir).select(*KEYS, F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), "score", "level", "tier", F.coalesce("violation", F.lit("NONE")).alias("violation"))


ALERT_SQL = BASELINE_SQL + f""",
known AS (SELECT *, mean AS route_median, 0 AS n_peers, NULL::DOUBLE AS q1, NULL::DOUBLE AS q3, 0.42::DOUBLE AS hhi, {Z_SQL.format(d='deviation')} AS z, CASE WHEN previous > 0 THEN (fare - previous) / previous END AS dod,
  {Z_SQL.format(d='(deviation * (1 + 0.35 * exp(-greatest(lead_days, 1) / 10.0::DOUBLE)))')} AS raw_dz FROM baseline WHERE mean > 0)""" + judgement_sql("known") + """,
alerts AS (SELECT *, CASE WHEN z >= 2 OR coalesce(dod, 0) >= 0.40 OR level != 'NORMAL' THEN CASE WHEN violation IS NOT NULL OR z >= 3 OR coalesce(dod, 0) >= 0.40 THEN 'CRITICAL' ELSE 'HIGH' END END AS severity,
  CASE WHEN violation IS NOT NULL THEN 'DGCA_STATUTORY_VIOLATION' WHEN dod >= 0.40 THEN 'SURGE_PRICING' ELSE 'SPIKE' END AS kind FROM judged)"""


#: All days judged: those without a positive mean raise an alert by their daily change alone.
RAISED_SQL = ALERT_SQL + """,
raised AS (SELECT route_code, booking_window, flight_date, severity, kind FROM alerts WHERE severity IS NOT NULL
  UNION ALL SELECT route_code, booking_window, flight_date, 'CRITICAL', 'SURGE_PRICING' FROM baseline WHERE NOT coalesce(mean > 0, false) AND previous > 0 AND (fare - previous) / previous >= 0.40)"""


#: The same days judged by their route's own concentration, median and quartiles as well, those without a history too.
GATED_SQL = RAISED_SQL + f""",
measured AS (WITH {RATED_SQL.lstrip(", \n")}
  SELECT route_code, booking_window, flight_date, CASE WHEN z >= 2 OR coalesce(rise, 0) >= 0.40 OR level != 'NORMAL' THEN CASE WHEN violation IS NOT NULL OR z >= 3 OR coalesce(rise, 0) >= 0.40 THEN 'CRITICAL' ELSE 'HIGH' END END AS severity,
    CASE WHEN violation IS NOT NULL THEN 'DGCA_STATUTORY_VIOLATION' WHEN rise >= 0.40 THEN 'SURGE_PRICING' ELSE 'SPIKE' END AS kind FROM (SELECT *, CASE WHEN previous > 0 THEN (fare - previous) / previous END AS rise FROM judged)),
gated AS (SELECT 'published' AS inputs, * FROM raised UNION ALL SELECT 'measured', * FROM measured WHERE severity IS NOT NULL)"""


def alerts_by_inputs(spark, sf_dir):
    """Alerts of each route, window and day against the thirty days before: by the published inputs, and by what is measured of the route."""
    return anomaly.alerts_by_inputs(with_routes(baselines(spark, sf_dir), eligible(spark, sf_dir)), "fare", "lead_days")


@query(with_quotes(GATED_SQL + """
SELECT route_code, booking_window, strftime(flight_date, '%Y-%m-%d') AS flight_date, inputs, severity, kind FROM gated"""))
def alert_gate(spark, sf_dir):
    """Alerts by Z, daily change or surge, as CRITICAL or HIGH: by the published inputs, and by the route's measured concentration, median and quartiles."""
    return alerts_by_inputs(spark, sf_dir).select(*KEYS, F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), "inputs", "severity", "kind")


@query(with_quotes(HHI_SQL + """
, early AS (SELECT route_code, booking_window, avg(total_fare) AS mean, stddev_samp(total_fare) AS deviation, median(total_fare) AS median, arg_max(total_fare, (flight_date, seq1, seq2, seq3, seq4, total_fare)) AS previous
  FROM eligible WHERE flight_date < DATE '1999-01-01' AND origin != 'ASIA' GROUP BY ALL),
known AS (SELECT e.route_code, e.booking_window, total_fare AS fare, coalesce(b.mean, 5000.0) AS mean, coalesce(b.deviation, 500.0) AS deviation, coalesce(b.median, 5000.0) AS median, coalesce(b.previous, 5000.0) AS previous,
  n_peers, q1, q3, round(hhi * 10000) / 10000.0::DOUBLE AS hhi, lead_days
  FROM eligible e LEFT JOIN early b ON e.route_code = b.route_code AND e.booking_window = b.booking_window JOIN hhis h ON e.route_code = h.route_code JOIN routes r ON e.route_code = r.route_code WHERE flight_date >= DATE '2001-01-01'),
late AS (SELECT 'published' AS inputs, route_code, booking_window, fare, mean, deviation, mean AS route_median, previous, 0 AS n_peers, NULL::DOUBLE AS q1, NULL::DOUBLE AS q3, 0.405::DOUBLE AS hhi,
    CASE booking_window WHEN 'T+7' THEN 7 WHEN 'T+1' THEN 1 WHEN 'T+15' THEN 1 WHEN 'T+30' THEN 30 ELSE 7 END AS lead_days FROM known
  UNION ALL SELECT 'measured', route_code, booking_window, fare, mean, deviation, median, previous, n_peers, q1, q3, hhi, lead_days FROM known),
scored AS (SELECT *, """ + Z_SQL.format(d="(deviation * (1 + 0.35 * exp(-greatest(lead_days, 1) / 10.0::DOUBLE)))") + """ AS raw_dz FROM late)""" + judgement_sql("scored") + """
SELECT route_code, booking_window, inputs, level, coalesce(violation, 'NONE') AS violation, count(*) AS n, CAST(sum(round(score * 10000)) AS BIGINT) AS score_points FROM judged GROUP BY ALL"""))
def surge_batch(spark, sf_dir):
    """Late quotes against the mean, deviation and last fare of their route and window in earlier years; without one against the default baseline.

    Each is judged by the published inputs, and by the median of those years, the route's peers and concentration and its own lead days.
    """
    e = eligible(spark, sf_dir)
    last = F.max_by("total_fare", F.struct("flight_date", *SEQUENCE[:4], "total_fare"))
    early = e.where("flight_date < date'1999-01-01' and origin != 'ASIA'").groupBy(*KEYS).agg(F.avg("total_fare").alias("mean"), F.stddev_samp("total_fare").alias("deviation"), F.median("total_fare").alias("median"), last.alias("previous"))
    late = with_routes(e.where("flight_date >= date'2001-01-01'"), e)
    judged_late = anomaly.judged_by_inputs(late, F.broadcast(early), KEYS, "booking_window", "total_fare", "lead_days")
    return judged_late.groupBy(*KEYS, "inputs", F.col("surge.level").alias("level"), F.coalesce("surge.violation", F.lit("NONE")).alias("violation")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("surge.score") * 10000).cast("long")).alias("score_points"))


@query(with_quotes(HHI_SQL + " SELECT route_code, round(hhi, 4) AS hhi, n_carriers FROM hhis"))
def hhi(spark, sf_dir):
    return index.concentration(eligible(spark, sf_dir), ["route_code"], "carrier").select("route_code", F.round("hhi", 4).alias("hhi"), "n_carriers")


@query(with_quotes(RATED_SQL + """
SELECT coalesce(violation, 'ALL') AS violation, coalesce(level, 'ALL') AS level, count(*) AS n, round(avg(multiple), 4) AS mean_multiple FROM judged WHERE violation IS NOT NULL
GROUP BY GROUPING SETS ((violation), (level), ())"""))
def violations_summary(spark, sf_dir):
    """Totals by code and by level and over all, in one pass of grouping sets."""
    broken = judged(spark, sf_dir).where("violation is not null")
    sets = broken.groupingSets([["violation"], ["level"], []], "violation", "level")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("multiple"), 4).alias("mean_multiple")).select(F.coalesce("violation", F.lit("ALL")).alias("violation"), F.coalesce("level", F.lit("ALL")).alias("level"), "n", "mean_multiple")


@query(with_quotes(RATED_SQL + """
SELECT route_code, count(*) AS n, round(max(fare), 4) AS peak_fare, strftime(arg_max(flight_date, (fare, flight_date, booking_window)), '%Y-%m-%d') AS peak_date FROM judged WHERE violation IS NOT NULL GROUP BY 1"""))
def peak_violation(spark, sf_dir):
    order = F.struct("fare", "flight_date", "booking_window")
    return judged(spark, sf_dir).where("violation is not null").groupBy("route_code").agg(F.count("*").alias("n"), F.round(F.max("fare"), 4).alias("peak_fare"), F.date_format(F.max_by("flight_date", order), "yyyy-MM-dd").alias("peak_date"))


@query(with_quotes("""
SELECT carrier, count(*) AS n, round(avg(total_fare), 4) AS mean_fare, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM eligible GROUP BY 1"""))
def carrier_distribution(spark, sf_dir):
    by = eligible(spark, sf_dir).groupBy("carrier").agg(F.count("*").alias("n"), F.round(F.avg("total_fare"), 4).alias("mean_fare"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(total).select("carrier", "n", "mean_fare", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("percent"))


ARB_SQL = """,
venues AS (SELECT *, portal IN ('indigo', 'spicejet', 'airindia') AS direct FROM eligible),
ranked AS (SELECT *, row_number() OVER (PARTITION BY route_code, period, carrier, flight_no, direct ORDER BY total_fare, seq1, seq2, seq3, seq4, flight_date) AS rn FROM venues),
sides AS (SELECT route_code, period, carrier, flight_no, max(total_fare) FILTER (direct) AS direct_fare, max(portal) FILTER (direct) AS direct_portal, max(total_fare) FILTER (NOT direct) AS agency_fare, max(portal) FILTER (NOT direct) AS agency_portal
  FROM ranked WHERE rn = 1 GROUP BY ALL),
chances AS (SELECT *, agency_fare - direct_fare AS gap, (agency_fare - direct_fare) / direct_fare * 100 AS pct FROM sides WHERE direct_fare IS NOT NULL AND agency_fare IS NOT NULL)"""


def chances(spark, sf_dir):
    return arbitrage.venue_spreads(eligible(spark, sf_dir), ["route_code", "period", "carrier", "flight_no"], "portal", "total_fare", SEQUENCE[:5])


@query(with_quotes(ARB_SQL + """
SELECT route_code, strftime(period, '%Y-%m-%d') AS period, carrier, flight_no, CASE WHEN gap > 0 THEN direct_portal ELSE agency_portal END AS buy_at, CASE WHEN gap > 0 THEN agency_portal ELSE direct_portal END AS sell_at,
  round(gap, 2) AS spread, round(pct, 4) AS spread_pct, CASE WHEN gap > 1e-4 THEN 'agency_premium' WHEN gap < -1e-4 THEN 'agency_discount' ELSE 'parity' END AS direction FROM chances WHERE abs(pct) >= 5"""))
def arbitrage_by_flight(spark, sf_dir):
    c = chances(spark, sf_dir).where(F.abs(F.col("percent")) >= 5)
    return c.select("route_code", F.date_format("period", "yyyy-MM-dd").alias("period"), "carrier", "flight_no", "buy_at", "sell_at", F.round("gap", 2).alias("spread"), F.round("percent", 4).alias("spread_pct"), "direction")


@query(with_quotes(ARB_SQL + """
SELECT count(*) AS n, count(DISTINCT route_code) AS n_routes, round(sum(gap) / 1000, 2) AS total_spread_thousands, round(avg(pct), 4) AS mean_pct FROM chances WHERE abs(pct) >= 5"""))
def arbitrage_summary(spark, sf_dir):
    c = chances(spark, sf_dir).where(F.abs(F.col("percent")) >= 5)
    return c.agg(F.count("*").alias("n"), F.countDistinct("route_code").alias("n_routes"), F.round(F.sum("gap") / 1000, 2).alias("total_spread_thousands"), F.round(F.avg("percent"), 4).alias("mean_pct"))


@query(with_quotes(ARB_SQL + """
SELECT route_code, strftime(period, '%Y-%m-%d') AS period, carrier, flight_no, round(pct, 4) AS spread_pct FROM chances ORDER BY abs(pct) DESC, route_code, period, carrier, flight_no LIMIT 20"""))
def arbitrage_top(spark, sf_dir):
    """The twenty widest spreads (a top-k report)."""
    c = chances(spark, sf_dir).orderBy(F.desc(F.abs(F.col("percent"))), "route_code", "period", "carrier", "flight_no").limit(20)
    return c.select("route_code", F.date_format("period", "yyyy-MM-dd").alias("period"), "carrier", "flight_no", F.round("percent", 4).alias("spread_pct"))


@query(with_quotes(""",
curve AS (SELECT route_code, lead_days, count(*) AS n, avg(total_fare) AS mean, median(total_fare) AS p50, quantile_cont(total_fare, 0.1) AS p10, quantile_cont(total_fare, 0.9) AS p90 FROM eligible GROUP BY ALL)
SELECT route_code, CAST(lead_days AS BIGINT) AS lead_days, n, round(mean, 4) AS mean, round(p50, 4) AS p50, round(p10, 4) AS p10, round(p90, 4) AS p90, round(p50 / first_value(p50) OVER (PARTITION BY route_code ORDER BY lead_days DESC), 4) AS factor FROM curve"""))
def lead_time_curve(spark, sf_dir):
    """Fares by days before departure, against the longest lead."""
    q = eligible(spark, sf_dir).groupBy("route_code", F.col("lead_days").cast("long").alias("lead_days"))
    c = q.agg(F.count("*").alias("n"), F.avg("total_fare").alias("mean"), F.percentile("total_fare", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("p"))
    longest = F.first(F.get("p", F.lit(0))).over(Window.partitionBy("route_code").orderBy(F.desc("lead_days")))
    return c.select("route_code", "lead_days", "n", F.round("mean", 4).alias("mean"), *(F.round(F.get("p", F.lit(k)), 4).alias(n) for k, n in enumerate(("p50", "p10", "p90"))), F.round(F.get("p", F.lit(0)) / longest, 4).alias("factor"))


@query(with_quotes(""",
slots AS (SELECT (isodow(event_time + INTERVAL 330 MINUTE) - 1) AS weekday, hour(event_time + INTERVAL 330 MINUTE) AS hour, total_fare FROM eligible)
SELECT CAST(weekday AS BIGINT) AS weekday, CAST(hour AS BIGINT) AS hour, count(*) AS n, round(avg(total_fare), 4) AS mean, round(avg(total_fare) / (SELECT avg(total_fare) FROM slots) * 100, 4) AS relative FROM slots GROUP BY ALL"""))
def weekday_hour_heatmap(spark, sf_dir):
    """Mean fare by weekday (Monday 0) and hour in Indian time, and relative to all observations."""
    local = F.from_utc_timestamp("event_time", "Asia/Kolkata")
    cells = eligible(spark, sf_dir).groupBy(F.weekday(local).cast("long").alias("weekday"), F.hour(local).cast("long").alias("hour")).agg(F.count("*").alias("n"), F.avg("total_fare").alias("mean"), F.sum("total_fare").alias("sum"))
    overall = cells.agg((F.sum("sum") / F.sum("n")).alias("overall"))
    return cells.crossJoin(overall).select("weekday", "hour", "n", F.round("mean", 4).alias("mean"), F.round(F.col("mean") / F.col("overall") * 100, 4).alias("relative"))


@query(with_quotes(""",
cells AS (SELECT route_code, booking_window, avg(total_fare) AS mean, count(*) AS n FROM eligible GROUP BY ALL)
SELECT route_code, CAST(sum(n) AS BIGINT) AS n, round(max(mean) FILTER (booking_window = 'T+1'), 4) AS t1, round(max(mean) FILTER (booking_window = 'T+7'), 4) AS t7, round(max(mean) FILTER (booking_window = 'T+15'), 4) AS t15,
  round(max(mean) FILTER (booking_window = 'T+30'), 4) AS t30, round(max(mean) FILTER (booking_window = 'T+45'), 4) AS t45, round(max(mean) FILTER (booking_window = 'T+1') / max(mean) FILTER (booking_window = 'T+30'), 4) AS surge FROM cells GROUP BY 1"""))
def sector_matrix(spark, sf_dir):
    """Routes by windows; surge is the shortest window over the reference window."""
    e = eligible(spark, sf_dir)
    wide = e.groupBy("route_code").pivot("booking_window", ["T+1", "T+7", "T+15", "T+30", "T+45"]).agg(F.avg("total_fare").alias("mean"), F.count("total_fare").alias("n"))
    mean, n = lambda w: F.col(f"`{w}_mean`"), lambda w: F.coalesce(F.col(f"`{w}_n`"), F.lit(0))
    names = {"T+1": "t1", "T+7": "t7", "T+15": "t15", "T+30": "t30", "T+45": "t45"}
    total = n("T+1") + n("T+7") + n("T+15") + n("T+30") + n("T+45")
    return wide.select("route_code", total.alias("n"), *(F.round(mean(w), 4).alias(c) for w, c in names.items()), F.round(mean("T+1") / mean("T+30"), 4).alias("surge"))
