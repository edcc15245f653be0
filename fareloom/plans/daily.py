"""The daily run with its results stored: windows, routes, the national index, alerts and spreads of a day, and what ran."""

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.functions import scoring
from fareloom.operators import anomaly, arbitrage, index, store
from fareloom.operators.layout import written
from fareloom.sources.stored import Store

WINDOWS = "route_code string, booking_window string, fare double, n long, lead_days int, day date"
ROUTES = "route_code string, composite double, n_windows long, quantity long, day date"
NATIONAL = "index double, n_routes long, day date"
ALERTS = "route_code string, booking_window string, fare double, mean double, z double, dod double, severity string, kind string, status string, day date"
SPREADS = "flight_date date, route_code string, carrier string, flight_no long, direct_fare double, agency_fare double, gap double, percent double, buy_at string, sell_at string, direction string, day date"
RUNS = "run_id string, table string, n_rows long, fallback boolean, finished timestamp, day date"
TABLES = {"windows": WINDOWS, "routes": ROUTES, "national": NATIONAL, "alerts": ALERTS, "spreads": SPREADS}
HISTORY_DAYS = 30


def _columns(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))


def run_day(target: Store, quotes: DataFrame, day: dt.date, order: list[str], base: DataFrame, captured: str = "captured_at", fallback_rows: int = 5000) -> str:
    """Computes ``day`` from its quotes and the stored windows of the thirty days before, stores all tables and notes the run; its id.

    ``quotes``: route_code, booking_window, flight_date, carrier, flight_no, portal, total_fare, flight_status, lead_days, ``captured`` and the
    tie-breakers ``order``; those of the day fly or were captured on it. Without any, the ``fallback_rows`` newest ones stand in, and the
    run says so. ``base``: route_code, base_fare and weight of each route.

    Running a day again gives the same rows and touches no other day. Alerts that are closed stay closed. The manifest (``runs``) is written last: a day counts as done
    when it names the run, and a run that fails earlier is run again.
    """
    run_id, shown = uuid.uuid4().hex, F.lit(day).cast("date")
    taken = written(store.of_day(quotes, day.isoformat(), "flight_date", captured, [F.desc(captured), *order], fallback_rows), "day-quotes")
    fallback = taken.where((F.col("flight_date") == shown) | (F.to_date(captured) == shown)).isEmpty()
    eligible = taken.where(scoring.eligible(F.col("flight_status")))
    keys = ["route_code", "booking_window"]
    cheapest = index.least_by(eligible, [*keys, "flight_date", "carrier", "flight_no"], ["total_fare", *order])
    clean = index.tukey_inside(cheapest, keys, "total_fare")
    leads = clean.groupBy(*keys).agg(F.min("lead_days").alias("lead_days"))
    windows = index.share_weighted_median(clean, keys, "total_fare", "carrier").join(leads, keys).withColumn("day", shown)
    windows = written(_columns(windows, WINDOWS), "day-windows")
    routes = written(_columns(index.composite(windows, ["route_code", "day"], "booking_window", "fare"), ROUTES), "day-routes")
    known = routes.join(base, "route_code").where("base_fare > 0")
    national = known.groupBy("day").agg((F.sum(F.col("weight") * F.col("composite") / F.col("base_fare")) / F.sum("weight") * 100).alias("index"), F.count("*").alias("n_routes"))

    first = day - dt.timedelta(days=HISTORY_DAYS)
    past = target.read("windows", WINDOWS).where((F.col("day") >= F.lit(first)) & (F.col("day") < shown))
    history = anomaly.rolling_days(past.unionByName(windows), keys, "day", "fare", HISTORY_DAYS).where(F.col("day") == shown)
    alerts = anomaly.alerts(history, "fare", "lead_days").withColumn("status", F.lit("OPEN"))
    spreads = arbitrage.venue_spreads(eligible, ["flight_date", "route_code", "carrier", "flight_no"], "portal", "total_fare", order).withColumn("day", shown)

    made = {"windows": windows, "routes": routes, "national": written(_columns(national, NATIONAL), "day-national"), "spreads": written(_columns(spreads, SPREADS), "day-spreads")}
    new_alerts = _columns(alerts, ALERTS)
    closed = target.read("alerts", ALERTS).where((F.col("day") == shown) & (F.col("status") != "OPEN"))
    made["alerts"] = written(store.replace_by_key(new_alerts, closed, [*keys, "day"]), "day-alerts")
    noted = [(run_id, table, target.replace(table, rows, [day]), fallback, dt.datetime.now(), day) for table, rows in made.items()]
    target.replace("runs", target.spark.createDataFrame(noted, RUNS).coalesce(1), [day])
    return run_id


def done(target: Store) -> DataFrame:
    """The last run of each day that finished: day, run_id, rows and whether it fell back."""
    runs = target.read("runs", RUNS)
    return runs.groupBy("day", "run_id").agg(F.sum("n_rows").alias("n_rows"), F.max("fallback").alias("fallback"), F.max("finished").alias("finished"))
