"""Seeded sources: flight slots and a modelled monthly traffic series, the same on every run."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distance in km and monthly passengers of each corridor, factors of windows, carriers and months,
#: extra season of single airports, yearly growth, rate a km, fixed fee, factors in and off the peak hours.
CORRIDORS = {
    "DEL-BOM": (1148, 450_000),
    "BOM-DEL": (1148, 450_000),
    "DEL-BLR": (1740, 330_000),
    "BLR-DEL": (1740, 330_000),
    "BOM-BLR": (842, 240_000),
    "BLR-BOM": (842, 240_000),
    "DEL-CCU": (1305, 165_000),
    "CCU-DEL": (1305, 165_000),
    "DEL-HYD": (1253, 120_000),
    "HYD-DEL": (1253, 120_000),
    "DEL-MAA": (1757, 120_000),
    "MAA-DEL": (1757, 120_000),
    "BLR-HYD": (504, 75_000),
    "HYD-BLR": (504, 75_000),
}
WINDOW_FACTORS = {"T+1": 2.15, "T+7": 1.45, "T+15": 1.18, "T+30": 1.00, "T+45": 0.96}
CARRIER_FACTORS = {"6E": 1.00, "AI": 1.18, "IX": 0.98, "QP": 0.96, "SG": 0.95}
SEASON = [1.01, 0.96, 1.02, 1.04, 1.10, 1.07, 0.91, 0.93, 0.96, 1.12, 1.09, 1.14]
AIRPORT_SEASON = [("CCU", (9, 10), 1.08), ("BLR", (2, 3, 11), 1.04)]
GROWTH, RATE, FEE, PEAK, OFF_PEAK = 1.082, 3.50, 950.0, 1.15, 0.92
PEAK_SLOTS, OFF_PEAK_SLOTS = (6, 7, 8, 17, 19), (11, 14, 21)
FARE_RANGE = (2100, 28000)


def _map(values: dict):
    return F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v)))


def _routes(spark: SparkSession) -> DataFrame:
    rows = [(k, km, pax) for k, (km, pax) in CORRIDORS.items()]
    return spark.createDataFrame(rows, "route_code string, distance_km int, pax long")


def slots(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Four to seven flights of each route and window with a fare from distance, window, peak and carrier."""
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_000)) / 1_000_000.0
    grid = _routes(spark).crossJoin(spark.createDataFrame([(w,) for w in WINDOW_FACTORS], "booking_window string"))
    n = 4 + F.floor(draw("route_code", "booking_window") * 4).cast("int")
    rows = grid.select("*", F.posexplode(F.sequence(F.lit(1), n)).alias("_k", "flight_no"))
    shares = [0.60, 0.75, 0.85, 0.95, 1.0]
    u = draw("route_code", "booking_window", "flight_no", F.lit("carrier"))
    carrier = F.coalesce(*(F.when(u < s, c) for s, c in zip(shares, CARRIER_FACTORS, strict=True)))
    schedule = sorted(PEAK_SLOTS + OFF_PEAK_SLOTS)
    hour = F.element_at(F.array(*map(F.lit, schedule)), (1 + F.floor(draw("route_code", "booking_window", "flight_no", F.lit("hour")) * len(schedule))).cast("int"))
    rows = rows.withColumns({"carrier": carrier, "hour": hour})
    peak = F.when(F.col("hour").isin(*PEAK_SLOTS), PEAK).otherwise(OFF_PEAK)
    fare = (F.col("distance_km") * RATE + FEE) * _map(WINDOW_FACTORS)[F.col("booking_window")] * peak * _map(CARRIER_FACTORS)[F.col("carrier")]
    clamped = F.least(F.greatest(F.round(fare / 10) * 10, F.lit(float(FARE_RANGE[0]))), F.lit(float(FARE_RANGE[1])))
    return rows.select("route_code", "booking_window", "flight_no", "carrier", "hour", clamped.alias("total_fare"))


def first_of_slots(spark: SparkSession, seed: int = 42) -> DataFrame:
    """The first flight of each route and window."""
    return slots(spark, seed).where("flight_no = 1")


def traffic_series(spark: SparkSession, months: int = 27, start: str = "2024-01-01") -> DataFrame:
    """Passengers of each corridor and month: base times yearly growth times the season of the month and airport."""
    grid = _routes(spark).select("*", F.posexplode(F.sequence(F.to_date(F.lit(start)), F.add_months(F.to_date(F.lit(start)), months - 1), F.expr("INTERVAL 1 MONTH"))).alias("t", "month"))
    season = F.element_at(F.array(*map(F.lit, SEASON)), F.month("month"))
    extra = F.lit(1.0)
    for airport, of_months, factor in reversed(AIRPORT_SEASON):
        extra = F.when(F.col("route_code").contains(airport) & F.month("month").isin(*of_months), factor).otherwise(extra)
    pax = F.round(F.col("pax") * F.pow(F.lit(GROWTH), F.col("t") / 12) * season * extra).cast("long")
    return grid.select(F.date_format("month", "yyyy-MM").alias("year_month"), "route_code", pax.alias("pax_volume"))
