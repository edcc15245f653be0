"""The daily run and the back-test as functions from tables to tables; nothing runs until a result is used."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.functions import scoring
from fareloom.operators import anomaly, arbitrage, index, series


def daily_run(quotes: DataFrame, order: list[str], base: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything that a day's quotes give: clean quotes, window and composite fares, anomalies and spreads.

    ``quotes``: route_code, booking_window, flight_date, carrier, flight_no, portal, total_fare, flight_status and
    the tie-breakers ``order``. With ``base`` (route_code, base_fare, weight) the national index comes along; routes
    without a base don't count in it. An empty day gives empty tables.
    """
    keys = ["route_code", "flight_date", "booking_window"]
    eligible = quotes.where(scoring.eligible(F.col("flight_status")))
    cheapest = index.least_by(eligible, [*keys, "carrier", "flight_no"], ["total_fare", *order])
    clean = index.tukey_inside(cheapest, keys, "total_fare")
    windows = index.share_weighted_median(clean, keys, "total_fare", "carrier")
    routes = index.composite(windows, ["route_code", "flight_date"], "booking_window", "fare")
    history = anomaly.rolling_days(windows, ["route_code", "booking_window"], "flight_date", "fare", 30)
    z = scoring.z_score(F.col("fare"), F.col("mean"), F.col("deviation"))
    scored = history.where("n_base > 0").withColumns({"z": z, "dod": scoring.change(F.col("fare"), F.col("previous"))})
    out = {
        "clean": clean,
        "windows": windows,
        "routes": routes,
        "alerts": scored.withColumn("severity", scoring.severity(F.col("z"), F.col("dod"))).where("severity is not null"),
        "spreads": arbitrage.venue_spreads(eligible, ["route_code", "flight_date", "carrier", "flight_no"], "portal", "total_fare", order),
    }
    if base is not None:
        known = routes.join(base, "route_code").where("base_fare > 0")
        out["national"] = known.groupBy("flight_date").agg((F.sum(F.col("weight") * F.col("composite") / F.col("base_fare")) / F.sum("weight") * 100).alias("index"), F.count("*").alias("n_routes"))
    return out


def backtest(ours: DataFrame, reference: DataFrame, most_lag: int = 2) -> dict[str, DataFrame]:
    """Monthly comparison of two series (month, value each): errors, direction agreement and the best lag."""
    a, b = ours.select("month", F.col("value").alias("ours")), reference.select("month", F.col("value").alias("theirs"))
    pairs = a.join(b, "month")
    moved = series.adjacent_month_change(series.adjacent_month_change(pairs, "month", "ours", "ours_change"), "month", "theirs", "theirs_change")
    agrees = F.avg((F.signum("ours_change") == F.signum("theirs_change")).cast("double")) * 100
    lags = series.lagged_correlation(pairs, "month", "ours", "theirs", most_lag)
    return {
        "errors": pairs.agg(F.count("*").alias("n"), F.corr("ours", "theirs").alias("correlation"), *series.errors(F.col("theirs"), F.col("ours"))),
        "direction": moved.agg(agrees.alias("agreement_pct"), F.count("ours_change").alias("n")),
        "lags": lags,
        "best": series.best_lag(lags),
    }
