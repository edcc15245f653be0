"""Queries of the index pipeline, each with its DuckDB twin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.functions import normalize, scoring
from fareloom.operators import index
from fareloom.plans.fixtures import SEQUENCE, quotes, with_quotes

QUERIES: dict = {}
SQL: dict = {}
GROUP = ["route_code", "period", "booking_window"]
FLIGHT = [*GROUP, "carrier", "flight_no"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).where(scoring.eligible(F.col("flight_status")))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.least_by(eligible(spark, sf_dir), FLIGHT, ["total_fare", *SEQUENCE[:5]])


DEDUP_SQL = """,
dedup AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY route_code, period, booking_window, carrier, flight_no
  ORDER BY total_fare, seq1, seq2, seq3, seq4, flight_date) AS rn FROM eligible) WHERE rn = 1)"""
BOUNDS_SQL = """,
bounds AS (SELECT route_code, period, booking_window, count(*) AS n, quantile_cont(total_fare, 0.25) AS q1, quantile_cont(total_fare, 0.75) AS q3,
  min(total_fare) AS least, max(total_fare) AS most FROM dedup GROUP BY ALL),
fences AS (SELECT *, CASE WHEN n < 4 THEN least ELSE q1 - 1.5 * (q3 - q1) END AS lower, CASE WHEN n < 4 THEN most ELSE q3 + 1.5 * (q3 - q1) END AS upper FROM bounds)"""
INSIDE_SQL = """,
inside AS (SELECT d.* FROM dedup d JOIN fences f USING (route_code, period, booking_window) WHERE d.total_fare BETWEEN f.lower AND f.upper)"""
MEDIAN_SQL = """,
shares AS (SELECT * FROM (VALUES ('6E', 0.60), ('AI', 0.15), ('IX', 0.10), ('QP', 0.10), ('SG', 0.05)) t(carrier, share)),
parts AS (SELECT i.*, coalesce(s.share, 0.01)::DOUBLE / count(*) OVER (PARTITION BY route_code, period, booking_window, i.carrier) AS part FROM inside i LEFT JOIN shares s ON i.carrier = s.carrier),
weighted AS (SELECT *, part / sum(part) OVER (PARTITION BY route_code, period, booking_window) AS w FROM parts),
cumulated AS (SELECT *, sum(w) OVER up AS cum, lead(total_fare) OVER up AS nxt, row_number() OVER up AS pos FROM weighted
  WINDOW up AS (PARTITION BY route_code, period, booking_window ORDER BY total_fare, seq1, seq2, seq3, seq4, flight_date ROWS UNBOUNDED PRECEDING)),
medians AS (SELECT route_code, period, booking_window, CASE WHEN abs(cum - 0.5) <= 1e-9 AND nxt IS NOT NULL THEN (total_fare + nxt) / 2 ELSE total_fare END AS fare
  FROM (SELECT *, row_number() OVER (PARTITION BY route_code, period, booking_window ORDER BY pos) AS first FROM cumulated WHERE cum >= 0.5 - 1e-9) WHERE first = 1)"""
COMPOSITE_SQL = """,
wweights AS (SELECT * FROM (VALUES ('T+1', 0.20), ('T+7', 0.32), ('T+15', 0.26), ('T+30', 0.14), ('T+45', 0.08)) t(booking_window, weight)),
composites AS (SELECT route_code, period, sum(weight::DOUBLE * fare) / sum(weight::DOUBLE) AS composite, count(*) AS n_windows FROM medians JOIN wweights USING (booking_window) GROUP BY ALL)"""
UNITS_SQL = """,
counts AS (SELECT route_code, period, count(*) AS quantity FROM inside GROUP BY ALL),
units AS (SELECT *, first_value(composite) OVER b AS base_composite, first_value(quantity) OVER b AS base_quantity FROM composites JOIN counts USING (route_code, period)
  WINDOW b AS (PARTITION BY route_code ORDER BY period)),
numbers AS (SELECT period, count(*) AS n_units, sum(base_quantity * composite / base_composite) / sum(base_quantity) * 100 AS laspeyres,
  sum(composite * base_quantity) / sum(base_composite * base_quantity) * 100 AS laspeyres_true, sum(composite * quantity) / sum(base_composite * quantity) * 100 AS paasche FROM units GROUP BY period)"""
ALL_SQL = DEDUP_SQL + BOUNDS_SQL + INSIDE_SQL + MEDIAN_SQL + COMPOSITE_SQL + UNITS_SQL


def inside(spark, sf_dir):
    return index.tukey_inside(deduplicated(spark, sf_dir), GROUP, "total_fare")


def medians(spark, sf_dir):
    return index.share_weighted_median(inside(spark, sf_dir), GROUP, "total_fare", "carrier")


def composites(spark, sf_dir):
    return index.composite(medians(spark, sf_dir), ["route_code", "period"], "booking_window", "fare")


def units(spark, sf_dir):
    """Composite fare and number of quotes of each route and quarter beside those of its first quarter."""
    return index.with_base(composites(spark, sf_dir), "route_code", "period", "composite", "quantity")


def numbers(spark, sf_dir):
    return index.index_numbers(units(spark, sf_dir), "period", "composite", "quantity", "base_composite", "base_quantity")


@query(with_quotes(ALL_SQL + """
SELECT strftime(period, '%Y-%m-%d') AS period, n_units, round(laspeyres, 4) AS laspeyres, round(paasche, 4) AS paasche, round(sqrt(laspeyres * paasche), 4) AS fisher,
  round(laspeyres - sqrt(laspeyres * paasche), 4) AS bias FROM numbers"""))
def national_index_series(spark, sf_dir):
    r = numbers(spark, sf_dir)
    return r.select(day("period"), "n_units", *(F.round(c, 4).alias(c) for c in ("laspeyres", "paasche", "fisher", "bias")))


@query(with_quotes(ALL_SQL + """
SELECT strftime(period, '%Y-%m-%d') AS period, round(laspeyres_true, 4) AS laspeyres_true, round(laspeyres - laspeyres_true, 4) AS gap FROM numbers"""))
def laspeyres_true(spark, sf_dir):
    r = numbers(spark, sf_dir)
    return r.select(day("period"), F.round("laspeyres_true", 4).alias("laspeyres_true"), F.round(F.col("laspeyres") - F.col("laspeyres_true"), 4).alias("gap"))


@query(with_quotes(""",
ends AS (SELECT route_code, min(flight_date) AS first_date, max(flight_date) AS last_date FROM eligible GROUP BY 1),
prices AS (SELECT e.route_code, median(total_fare) FILTER (flight_date = first_date) AS base_fare, median(total_fare) FILTER (flight_date = last_date) AS current_fare,
  count(*) FILTER (flight_date = first_date) AS base_n, count(*) FILTER (flight_date = last_date) AS current_n FROM eligible e JOIN ends USING (route_code) GROUP BY 1)
SELECT count(*) AS n_routes, round(sum(current_fare * base_n) / sum(base_fare * base_n) * 100, 4) AS laspeyres, round(sum(current_fare * current_n) / sum(base_fare * current_n) * 100, 4) AS paasche FROM prices"""))
def recompute_first_last(spark, sf_dir):
    """Plain medians on each route's first and last day, weighted by the number of rows."""
    q = eligible(spark, sf_dir).select("route_code", "flight_date", "total_fare")
    ends = q.groupBy("route_code").agg(F.min("flight_date").alias("first_date"), F.max("flight_date").alias("last_date"))
    at = lambda c: F.when(F.col("flight_date") == F.col(c), F.col("total_fare"))
    prices = q.join(ends, "route_code").groupBy("route_code").agg(F.median(at("first_date")).alias("p0"), F.median(at("last_date")).alias("p"), F.count(at("first_date")).alias("q0"), F.count(at("last_date")).alias("q"))
    ratio = lambda w: F.round(F.sum(F.col("p") * F.col(w)) / F.sum(F.col("p0") * F.col(w)) * 100, 4)
    return prices.agg(F.count("*").alias("n_routes"), ratio("q0").alias("laspeyres"), ratio("q").alias("paasche"))


@query(with_quotes(DEDUP_SQL + " SELECT route_code, strftime(period, '%Y-%m-%d') AS period, booking_window, carrier, flight_no, portal, total_fare, seq1, seq2, seq4 FROM dedup"))
def dedup_min_fare(spark, sf_dir):
    return deduplicated(spark, sf_dir).select("route_code", day("period"), "booking_window", "carrier", "flight_no", "portal", "total_fare", "seq1", "seq2", "seq4")


@query(with_quotes(DEDUP_SQL + BOUNDS_SQL + """
SELECT route_code, strftime(period, '%Y-%m-%d') AS period, booking_window, n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper FROM fences"""))
def tukey_bounds(spark, sf_dir):
    b = index.tukey_bounds(deduplicated(spark, sf_dir), GROUP, "total_fare")
    return b.select("route_code", day("period"), "booking_window", "n", *(F.round(c, 4).alias(c) for c in ("q1", "q3", "lower", "upper")))


@query(with_quotes(DEDUP_SQL + BOUNDS_SQL + INSIDE_SQL + """
SELECT booking_window, count(*) AS n_kept, round(avg(total_fare), 4) AS mean_kept, max(total_fare) AS most_kept FROM inside GROUP BY 1"""))
def tukey_filter(spark, sf_dir):
    return inside(spark, sf_dir).groupBy("booking_window").agg(F.count("*").alias("n_kept"), F.round(F.avg("total_fare"), 4).alias("mean_kept"), F.max("total_fare").alias("most_kept"))


@query(with_quotes(""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY route_code, period, booking_window ORDER BY total_fare, seq1, seq2, seq3, seq4, flight_date) - 1 AS r,
  count(*) OVER (PARTITION BY route_code, period, booking_window) AS n FROM eligible),
lists AS (SELECT route_code, period, booking_window, list(total_fare ORDER BY total_fare) AS a FROM eligible GROUP BY ALL),
spots AS (SELECT *, 0.25 * (n - 2) AS p1, 0.75 * (n - 2) AS p3 FROM ranked JOIN lists USING (route_code, period, booking_window)),
others AS (SELECT *, CASE WHEN n > 1 THEN list_concat(a[1:r], a[r + 2:n]) END AS o FROM spots),
quartiles AS (SELECT *, o[CAST(floor(p1) AS INT) + 1] + (p1 - floor(p1)) * (o[CAST(least(floor(p1) + 1, n - 2) AS INT) + 1] - o[CAST(floor(p1) AS INT) + 1]) AS q1,
  o[CAST(floor(p3) AS INT) + 1] + (p3 - floor(p3)) * (o[CAST(least(floor(p3) + 1, n - 2) AS INT) + 1] - o[CAST(floor(p3) AS INT) + 1]) AS q3 FROM others),
flags AS (SELECT *, CASE WHEN n - 1 >= 4 THEN total_fare < q1 - 1.5 * (q3 - q1) OR total_fare > q3 + 1.5 * (q3 - q1) ELSE false END AS outlier FROM quartiles)
SELECT route_code, booking_window, count(*) AS n, count(*) FILTER (outlier) AS n_outliers, coalesce(max(total_fare) FILTER (outlier), 0) AS most FROM flags GROUP BY ALL"""))
def tukey_leave_one_out(spark, sf_dir):
    flagged = index.leave_one_out_outliers(eligible(spark, sf_dir), GROUP, "total_fare", SEQUENCE[:5])
    return flagged.groupBy("route_code", "booking_window").agg(F.count("*").alias("n"), F.count_if("outlier").alias("n_outliers"), F.coalesce(F.max(F.when(F.col("outlier"), F.col("total_fare"))), F.lit(0.0)).alias("most"))


@query(with_quotes("""
SELECT route_code, count(*) AS n, round(greatest(0, quantile_cont(total_fare, 0.25) - 1.5 * (quantile_cont(total_fare, 0.75) - quantile_cont(total_fare, 0.25))), 2) AS lower,
  round(quantile_cont(total_fare, 0.75) + 1.5 * (quantile_cont(total_fare, 0.75) - quantile_cont(total_fare, 0.25)), 2) AS upper FROM eligible WHERE total_fare > 0 GROUP BY 1"""))
def surveillance_fences(spark, sf_dir):
    """Fences over positive fares whose lower one is zero at least."""
    q = eligible(spark, sf_dir).where("total_fare > 0").groupBy("route_code").agg(F.count("*").alias("n"), F.percentile("total_fare", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return q.select("route_code", "n", F.round(F.greatest(F.lit(0.0), low - 1.5 * (high - low)), 2).alias("lower"), F.round(high + 1.5 * (high - low), 2).alias("upper"))


@query(with_quotes(DEDUP_SQL + BOUNDS_SQL + INSIDE_SQL + MEDIAN_SQL + " SELECT route_code, strftime(period, '%Y-%m-%d') AS period, booking_window, round(fare, 4) AS fare FROM medians"))
def weighted_median_window(spark, sf_dir):
    return medians(spark, sf_dir).select("route_code", day("period"), "booking_window", F.round("fare", 4).alias("fare"))


@query(with_quotes(DEDUP_SQL + BOUNDS_SQL + INSIDE_SQL + MEDIAN_SQL + COMPOSITE_SQL + " SELECT route_code, strftime(period, '%Y-%m-%d') AS period, n_windows, round(composite, 4) AS composite FROM composites"))
def composite_fare(spark, sf_dir):
    return composites(spark, sf_dir).select("route_code", day("period"), "n_windows", F.round("composite", 4).alias("composite"))


@query(with_quotes("""
SELECT route_code, strftime(period, '%Y-%m-%d') AS period, count(*) AS n, round(avg(total_fare), 4) AS mean, min(total_fare) AS least, max(total_fare) AS most,
  round(quantile_cont(total_fare, 0.25), 4) AS p25, round(quantile_cont(total_fare, 0.75), 4) AS p75, round(coalesce(stddev_samp(total_fare), 0), 4) AS deviation FROM eligible GROUP BY ALL"""))
def route_distribution(spark, sf_dir):
    return (
        eligible(spark, sf_dir)
        .groupBy("route_code", "period")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("total_fare"), 4).alias("mean"),
            F.min("total_fare").alias("least"),
            F.max("total_fare").alias("most"),
            F.round(F.percentile("total_fare", F.lit(0.25)), 4).alias("p25"),
            F.round(F.percentile("total_fare", F.lit(0.75)), 4).alias("p75"),
            F.round(F.coalesce(F.stddev_samp("total_fare"), F.lit(0.0)), 4).alias("deviation"),
        )
        .withColumn("period", F.date_format("period", "yyyy-MM-dd"))
    )


AIRPORTS = {"AFRICA": "DEL", "AMERICA": "BOM", "ASIA": "BLR", "EUROPE": "HYD", "MIDDLE EAST": "XXX"}
AIRPORT_SQL = "CASE {c} WHEN 'AFRICA' THEN 'DEL' WHEN 'AMERICA' THEN 'BOM' WHEN 'ASIA' THEN 'BLR' WHEN 'EUROPE' THEN 'HYD' ELSE 'XXX' END"
RATIO_SQL = """CASE WHEN route_ratio IS NOT NULL THEN round((route_ratio + CASE carrier WHEN 'AI' THEN 0.03 WHEN 'IX' THEN -0.02 WHEN 'QP' THEN -0.02 ELSE 0.0 END::DOUBLE) * 10000) / 10000.0::DOUBLE
  ELSE CASE carrier WHEN '6E' THEN 0.78 WHEN 'AI' THEN 0.81 WHEN 'IX' THEN 0.76 WHEN 'QP' THEN 0.76 END::DOUBLE END"""


def airports(df: DataFrame) -> DataFrame:
    """Quotes with ``airports``, an airport pair in place of the regions, and one carrier that is not listed."""
    known = F.create_map(*(F.lit(x) for pair in AIRPORTS.items() for x in pair))
    return df.withColumns({"airports": F.concat_ws("-", known[F.col("origin")], known[F.col("destination")]), "carrier": F.when(F.col("carrier") == "SG", "ZZ").otherwise(F.col("carrier"))})


@query(with_quotes(f""",
placed AS (SELECT * REPLACE (CASE carrier WHEN 'SG' THEN 'ZZ' ELSE carrier END AS carrier), {AIRPORT_SQL.format(c='origin')} || '-' || {AIRPORT_SQL.format(c='destination')} AS airports FROM quotes),
routed AS (SELECT *, CASE airports WHEN 'DEL-BOM' THEN 0.78 WHEN 'BOM-DEL' THEN 0.78 WHEN 'DEL-BLR' THEN 0.81 WHEN 'BLR-DEL' THEN 0.81 WHEN 'BOM-BLR' THEN 0.74 WHEN 'BLR-BOM' THEN 0.74
  WHEN 'DEL-HYD' THEN 0.77 WHEN 'HYD-DEL' THEN 0.77 WHEN 'BLR-HYD' THEN 0.72 WHEN 'HYD-BLR' THEN 0.72 END::DOUBLE AS route_ratio FROM placed),
rated AS (SELECT *, {RATIO_SQL} AS ratio FROM routed),
priced AS (SELECT *, round(total_fare * coalesce(ratio, 0.78) * 100) / 100.0::DOUBLE AS computed FROM rated),
split AS (SELECT *, CASE WHEN base_fare IS NOT NULL AND taxes IS NOT NULL THEN 'measured' WHEN base_fare IS NOT NULL OR taxes IS NOT NULL THEN 'residual' WHEN ratio IS NULL THEN 'estimated' ELSE 'calibrated' END AS basis,
  CASE WHEN base_fare IS NOT NULL THEN base_fare WHEN taxes IS NOT NULL THEN round((total_fare - taxes) * 100) / 100.0::DOUBLE ELSE computed END AS base,
  CASE WHEN taxes IS NOT NULL THEN taxes WHEN base_fare IS NOT NULL THEN round((total_fare - base_fare) * 100) / 100.0::DOUBLE ELSE round((total_fare - computed) * 100) / 100.0::DOUBLE END AS tax FROM priced)
SELECT airports, carrier, basis, count(*) AS n, CAST(sum(round(base * 100)) AS BIGINT) AS base_cents, CAST(sum(round(tax * 100)) AS BIGINT) AS tax_cents FROM split GROUP BY ALL"""))
def fare_split(spark, sf_dir):
    """Base and taxes by what is known: both, one, the ratio of route and carrier, or the default."""
    q = airports(quotes(spark, sf_dir))
    parts = q.select("airports", "carrier", scoring.fare_split(F.col("total_fare"), F.col("base_fare"), F.col("taxes"), F.col("carrier"), F.col("airports")).alias("s"))
    return parts.groupBy("airports", "carrier", F.col("s.basis").alias("basis")).agg(F.count("*").alias("n"), *(F.sum(F.round(F.col(f"s.{c}") * 100).cast("long")).alias(n) for c, n in (("base", "base_cents"), ("taxes", "tax_cents"))))


RECOMPOSED_SQL = "((base_fare IS NULL AND taxes IS NULL) OR abs(total_fare - coalesce(base_fare, 0) - coalesce(taxes, 0)) <= greatest(1.0, 0.005 * total_fare))"


@query(with_quotes(f"""
SELECT portal, count(*) AS n, count(*) FILTER ({RECOMPOSED_SQL}) AS n_pass, count(*) FILTER (NOT {RECOMPOSED_SQL}) AS n_mismatch FROM quotes GROUP BY 1"""))
def recomposition_check(spark, sf_dir):
    ok = scoring.recomposes(F.col("total_fare"), F.col("base_fare"), F.col("taxes"))
    return quotes(spark, sf_dir).groupBy("portal").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_pass"), F.count_if(~ok).alias("n_mismatch"))


@query(with_quotes(f""",
b AS (SELECT route_code, booking_window, quantile_cont(total_fare, 0.25) AS q1, quantile_cont(total_fare, 0.75) AS q3 FROM quotes GROUP BY ALL)
SELECT coalesce(CASE WHEN flight_status = 'cancelled' THEN 'cancelled' WHEN flight_status = 'sold_out' THEN 'sold_out' WHEN NOT {RECOMPOSED_SQL} THEN 'split_recomposition_mismatch'
  WHEN total_fare < q1 - 1.5 * (q3 - q1) OR total_fare > q3 + 1.5 * (q3 - q1) THEN 'outlier' END, 'none') AS reason, count(*) AS n FROM quotes JOIN b USING (route_code, booking_window) GROUP BY 1"""))
def exclusion_reason(spark, sf_dir):
    q = quotes(spark, sf_dir)
    bounds = index.tukey_bounds(q, ["route_code", "booking_window"], "total_fare").drop("n", "q1", "q3")
    outlier = ~F.col("total_fare").between(F.col("lower"), F.col("upper"))
    reason = scoring.exclusion(F.col("flight_status"), scoring.recomposes(F.col("total_fare"), F.col("base_fare"), F.col("taxes")), outlier)
    return q.join(bounds, ["route_code", "booking_window"]).groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query(with_quotes(""",
raw AS (SELECT CASE seq2 % 6 WHEN 0 THEN ' Canceled ' WHEN 1 THEN 'SOLD-OUT' WHEN 2 THEN 'On Time' WHEN 3 THEN 'diverted' WHEN 4 THEN '' END AS given FROM quotes)
SELECT coalesce(CASE lower(trim(given)) WHEN 'canceled' THEN 'cancelled' WHEN 'sold-out' THEN 'sold_out' WHEN 'on time' THEN 'on_time' WHEN '' THEN NULL ELSE lower(trim(given)) END, 'unknown') AS status, count(*) AS n FROM raw GROUP BY 1"""))
def flight_status_canonical(spark, sf_dir):
    k = F.col("seq2") % 6
    given = F.when(k == 0, " Canceled ").when(k == 1, "SOLD-OUT").when(k == 2, "On Time").when(k == 3, "diverted").when(k == 4, "")
    return quotes(spark, sf_dir).groupBy(F.coalesce(normalize.status(given), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


@query(with_quotes("""
SELECT seq1, seq2, seq4, sha256(carrier || ':' || carrier || flight_no || ':' || origin || ':' || destination || ':' || strftime(flight_date, '%Y-%m-%d') || ':' || booking_window || ':' || coalesce(flight_status, '')) AS fingerprint FROM quotes"""))
def fingerprint(spark, sf_dir):
    number = normalize.flight_number(F.col("flight_no").cast("string"), F.col("carrier"))
    key = normalize.fingerprint(F.col("carrier"), number, F.col("origin"), F.col("destination"), F.date_format("flight_date", "yyyy-MM-dd"), F.col("booking_window"), F.col("flight_status"))
    return quotes(spark, sf_dir).select("seq1", "seq2", "seq4", key.alias("fingerprint"))


@query("""
WITH given AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'T' || (o_orderkey % 46) WHEN 1 THEN (o_orderkey % 46) || 'd' WHEN 2 THEN 't+0' || (o_orderkey % 10) WHEN 3 THEN 'later' END AS w FROM orders)
SELECT CASE WHEN w IS NULL THEN 'T+1' WHEN regexp_matches(w, '[0-9]') THEN 'T+' || CAST(regexp_extract(w, '([0-9]+)', 1) AS INT) ELSE upper(trim(w)) END AS booking_window,
  CAST(min(CASE WHEN regexp_matches(w, '[0-9]') THEN CAST(regexp_extract(w, '([0-9]+)', 1) AS INT) END) AS BIGINT) AS days, count(*) AS n FROM given GROUP BY 1""")
def booking_window_normalized(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 5 == 0, F.concat(F.lit("T"), (key % 46).cast("string"))).when(key % 5 == 1, F.concat((key % 46).cast("string"), F.lit("d"))).when(key % 5 == 2, F.concat(F.lit("t+0"), (key % 10).cast("string"))).when(key % 5 == 3, "later")
    given = spark.read.parquet(f"{sf_dir}/orders.parquet").select(text.alias("w"))
    return given.groupBy(normalize.booking_window(F.col("w")).alias("booking_window")).agg(F.min(normalize.window_days(F.col("w"))).cast("long").alias("days"), F.count("*").alias("n"))
