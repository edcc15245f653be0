"""Queries on index series, elasticities and back-tests, each with its DuckDB twin."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fareloom.operators import series
from fareloom.operators.layout import written
from fareloom.plans.anomaly_queries import eligible
from fareloom.plans.fixtures import BENCHMARK_SQL, benchmark_months, with_quotes

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def days(spark, sf_dir):
    """The national daily series: mean fare and sample."""
    return eligible(spark, sf_dir).groupBy("flight_date").agg(F.avg("total_fare").alias("fare"), F.count("*").alias("n"), F.countDistinct("route_code").alias("routes"))


DAYS_SQL = """,
days AS (SELECT flight_date, avg(total_fare) AS fare, count(*) AS n, count(DISTINCT route_code) AS routes FROM eligible GROUP BY 1)"""


def months(spark, sf_dir):
    """Monthly means of days that cover enough routes: at least five and 60 % of the best-covered day.

    Days come from files, a row each: they are read twice, the quotes behind them once.
    """
    d = written(days(spark, sf_dir), "days")
    gate = d.agg(F.greatest(F.lit(5), F.floor(F.max("routes") * 0.6)).alias("gate"))
    return d.crossJoin(gate).where("routes >= gate").groupBy(F.to_date(F.date_trunc("month", "flight_date")).alias("month")).agg(F.avg("fare").alias("fare"), F.count("*").alias("n_days"))


MONTHS_SQL = DAYS_SQL + """,
months AS (SELECT CAST(date_trunc('month', flight_date) AS DATE) AS month, avg(fare) AS fare, count(*) AS n_days FROM days
  WHERE routes >= greatest(5, (SELECT CAST(floor(max(routes) * 0.6) AS BIGINT) FROM days)) GROUP BY 1),
""" + BENCHMARK_SQL.strip() + """,
pairs AS (SELECT month, fare / (SELECT arg_min(fare, month) FROM months JOIN bench USING (month)) * 100 AS ours, cpi FROM months JOIN bench USING (month))"""


def pairs(spark, sf_dir):
    """Months that both series have, ours rebased to 100 in the first of them."""
    joined = written(months(spark, sf_dir).join(benchmark_months(spark, sf_dir), "month"), "month-pairs")
    first = joined.agg(F.min_by("fare", "month").alias("base"))
    return joined.crossJoin(first).select("month", (F.col("fare") / F.col("base") * 100).alias("ours"), "cpi")


@query(with_quotes(DAYS_SQL + """,
weeks AS (SELECT isoyear(flight_date) || '-W' || lpad(CAST(weekofyear(flight_date) AS VARCHAR), 2, '0') AS week, avg(fare) AS mean, CAST(sum(n) AS BIGINT) AS samples FROM days GROUP BY 1)
SELECT week, round(mean, 4) AS mean, samples, round((mean - lag(mean) OVER (ORDER BY week)) / lag(mean) OVER (ORDER BY week) * 100, 4) AS change_pct FROM weeks"""))
def index_history_weekly(spark, sf_dir):
    w = days(spark, sf_dir).groupBy(series.iso_week(F.col("flight_date")).alias("week")).agg(F.avg("fare").alias("mean"), F.sum("n").alias("samples"))
    return series.with_change(w, [], "week", "mean").select("week", F.round("mean", 4).alias("mean"), "samples", F.round("change_pct", 4).alias("change_pct"))


@query(with_quotes(MONTHS_SQL + """
SELECT strftime(month, '%Y-%m') AS month, n_days, round(fare, 4) AS mean, round((fare - lag(fare) OVER (ORDER BY month)) / lag(fare) OVER (ORDER BY month) * 100, 4) AS change_pct FROM months"""))
def index_history_monthly(spark, sf_dir):
    m = series.with_change(months(spark, sf_dir), [], "month", "fare")
    return m.select(F.date_format("month", "yyyy-MM").alias("month"), "n_days", F.round("fare", 4).alias("mean"), F.round("change_pct", 4).alias("change_pct"))


@query(with_quotes(""",
byday AS (SELECT route_code, flight_date, avg(total_fare) AS fare FROM eligible GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS rn, lead(fare) OVER w AS previous, stddev_samp(fare) OVER (PARTITION BY route_code) / avg(fare) OVER (PARTITION BY route_code) AS cv FROM byday WINDOW w AS (PARTITION BY route_code ORDER BY flight_date DESC))
SELECT route_code, strftime(flight_date, '%Y-%m-%d') AS latest, round(fare, 4) AS fare, round((fare - previous) / previous * 100, 4) AS change_pct, round(cv, 4) AS cv FROM ranked WHERE rn = 1"""))
def latest_per_route(spark, sf_dir):
    """Each route's last day against the last one before it, and the variation over all days."""
    by = eligible(spark, sf_dir).groupBy("route_code", "flight_date").agg(F.avg("total_fare").alias("fare"))
    late, whole = Window.partitionBy("route_code").orderBy(F.desc("flight_date")), Window.partitionBy("route_code")
    r = by.select("*", F.row_number().over(late).alias("rn"), F.lead("fare").over(late).alias("previous"), (F.stddev_samp("fare").over(whole) / F.avg("fare").over(whole)).alias("cv")).where("rn = 1")
    return r.select("route_code", F.date_format("flight_date", "yyyy-MM-dd").alias("latest"), F.round("fare", 4).alias("fare"), F.round((F.col("fare") - F.col("previous")) / F.col("previous") * 100, 4).alias("change_pct"), F.round("cv", 4).alias("cv"))


@query(with_quotes(""",
byday AS (SELECT route_code, flight_date, avg(total_fare) AS fare FROM eligible GROUP BY ALL)
SELECT a.route_code, strftime(a.flight_date, '%Y-%m-%d') AS flight_date, round((a.fare - b.fare) / b.fare * 100, 4) AS week_change_pct FROM byday a JOIN byday b ON a.route_code = b.route_code AND b.flight_date = a.flight_date - INTERVAL 7 DAY"""))
def week_change(spark, sf_dir):
    by = eligible(spark, sf_dir).groupBy("route_code", "flight_date").agg(F.avg("total_fare").alias("fare"))
    c = series.calendar_change(by, ["route_code"], "flight_date", "fare", 7, "c").where("c is not null")
    return c.select("route_code", F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), F.round("c", 4).alias("week_change_pct"))


@query(with_quotes("""
SELECT round(avg(total_fare), 4) AS overall, round(avg(total_fare) FILTER (booking_window = 'T+1') / avg(total_fare) * 100, 4) AS short_index, round(avg(total_fare) FILTER (booking_window = 'T+30') / avg(total_fare) * 100, 4) AS long_index FROM eligible"""))
def horizon_context(spark, sf_dir):
    at = lambda w: F.avg(F.when(F.col("booking_window") == w, F.col("total_fare")))
    overall = F.avg("total_fare")
    return eligible(spark, sf_dir).agg(F.round(overall, 4).alias("overall"), F.round(at("T+1") / overall * 100, 4).alias("short_index"), F.round(at("T+30") / overall * 100, 4).alias("long_index"))


LEADS_SQL = """,
leads AS (SELECT route_code, lead_days, avg(total_fare) AS price, count(*) AS quantity FROM eligible GROUP BY ALL)"""


def leads(spark, sf_dir):
    return eligible(spark, sf_dir).groupBy("route_code", "lead_days").agg(F.avg("total_fare").alias("price"), F.count("*").alias("quantity"))


@query(with_quotes(LEADS_SQL + """,
steps AS (SELECT *, lag(price) OVER w AS p1, lag(quantity) OVER w AS q1 FROM leads WINDOW w AS (PARTITION BY route_code ORDER BY lead_days DESC)),
moves AS (SELECT *, (price - p1) / ((price + p1) / 2) AS dp, (quantity - q1) / ((quantity + q1) / 2.0::DOUBLE) AS dq FROM steps WHERE p1 IS NOT NULL)
SELECT route_code, CAST(lead_days AS BIGINT) AS lead_days, round(CASE WHEN abs(dp) <= 1e-6 THEN 0 ELSE dq / dp END, 4) + 0.0 AS arc FROM moves"""))
def arc_elasticity(spark, sf_dir):
    a = series.arc_elasticity(leads(spark, sf_dir), ["route_code"], "lead_days", "price", "quantity").where("arc is not null")
    return a.select("route_code", F.col("lead_days").cast("long").alias("lead_days"), (F.round("arc", 4) + 0.0).alias("arc"))


@query(with_quotes(LEADS_SQL + " SELECT route_code, count(*) AS n, round(regr_slope(ln(quantity), ln(price)), 4) AS elasticity FROM leads GROUP BY 1"))
def loglog_slope(spark, sf_dir):
    return leads(spark, sf_dir).groupBy("route_code").agg(F.count("*").alias("n"), F.round(F.regr_slope(F.log("quantity"), F.log("price")), 4).alias("elasticity"))


@query(with_quotes(LEADS_SQL + """
SELECT route_code, round((arg_min(price, lead_days) / arg_max(price, lead_days) - 1) * 100, 4) AS premium_pct, round(arg_min(price, lead_days) / arg_max(price, lead_days), 4) AS urgency FROM leads GROUP BY 1"""))
def lead_time_premium(spark, sf_dir):
    ratio = F.min_by("price", "lead_days") / F.max_by("price", "lead_days")
    return leads(spark, sf_dir).groupBy("route_code").agg(F.round((ratio - 1) * 100, 4).alias("premium_pct"), F.round(ratio, 4).alias("urgency"))


@query(with_quotes(LEADS_SQL + """,
steps AS (SELECT *, lag(price) OVER w AS p1, lag(quantity) OVER w AS q1 FROM leads WINDOW w AS (PARTITION BY route_code ORDER BY lead_days DESC)),
moves AS (SELECT route_code, CASE WHEN abs((price - p1) / ((price + p1) / 2)) <= 1e-6 THEN 0 ELSE ((quantity - q1) / ((quantity + q1) / 2.0::DOUBLE)) / ((price - p1) / ((price + p1) / 2)) END AS arc FROM steps WHERE p1 IS NOT NULL)
SELECT count(DISTINCT route_code) AS n_routes, round(median(arc), 4) AS median_arc, count(*) FILTER (arc < 0) AS n_negative FROM moves"""))
def network_elasticity(spark, sf_dir):
    a = series.arc_elasticity(leads(spark, sf_dir), ["route_code"], "lead_days", "price", "quantity").where("arc is not null")
    return a.agg(F.countDistinct("route_code").alias("n_routes"), F.round(F.median("arc"), 4).alias("median_arc"), F.count_if(F.col("arc") < 0).alias("n_negative"))


@query(with_quotes(MONTHS_SQL + """
SELECT count(*) AS n_months, round(corr(ours, cpi), 4) AS correlation, round(sqrt(avg((ours - cpi) * (ours - cpi))), 4) AS rmse, round(avg(abs(ours - cpi)), 4) AS mae, round(avg(abs((ours - cpi) / cpi)) * 100, 4) AS mape, round(stddev_samp(ours - cpi), 4) AS tracking_error FROM pairs"""))
def monthly_divergence(spark, sf_dir):
    rmse, mae, mape = series.errors(F.col("cpi"), F.col("ours"))
    r = pairs(spark, sf_dir).agg(F.count("*").alias("n_months"), F.corr("ours", "cpi").alias("correlation"), rmse, mae, mape, F.stddev_samp(F.col("ours") - F.col("cpi")).alias("tracking_error"))
    return r.select("n_months", *(F.round(c, 4).alias(c) for c in ("correlation", "rmse", "mae", "mape", "tracking_error")))


LAGS_SQL = MONTHS_SQL + """,
numbered AS (SELECT row_number() OVER (ORDER BY month) AS i, ours, cpi FROM pairs),
lags AS (SELECT lag, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(a.ours, b.cpi) END AS correlation FROM (SELECT unnest(range(-6, 7)) AS lag) l JOIN numbered a ON true JOIN numbered b ON b.i = a.i + lag GROUP BY 1)"""


@query(with_quotes(LAGS_SQL + " SELECT CAST(lag AS BIGINT) AS lag, n, round(correlation, 4) AS correlation FROM lags"))
def lead_lag_corr(spark, sf_dir):
    lags = series.lagged_correlation(pairs(spark, sf_dir), "month", "ours", "cpi", 6)
    return lags.select(F.col("lag").cast("long").alias("lag"), "n", F.round("correlation", 4).alias("correlation"))


@query(with_quotes(LAGS_SQL + " SELECT CAST(lag AS BIGINT) AS lag, n, round(correlation, 4) AS correlation FROM lags ORDER BY lags.correlation DESC, abs(lag), lag LIMIT 1"))
def optimal_lead(spark, sf_dir):
    best = series.best_lag(series.lagged_correlation(pairs(spark, sf_dir), "month", "ours", "cpi", 6))
    return best.select(F.col("lag").cast("long").alias("lag"), "n", F.round("correlation", 4).alias("correlation"))


@query(with_quotes(MONTHS_SQL + """,
changes AS (SELECT a.month, (a.ours - b.ours) / b.ours * 100 AS ours_change, (a.cpi - b.cpi) / b.cpi * 100 AS cpi_change FROM pairs a LEFT JOIN pairs b ON b.month = a.month - INTERVAL 1 MONTH)
SELECT strftime(month, '%Y-%m') AS month, round(ours_change, 4) AS ours_change, round(cpi_change, 4) AS cpi_change, CAST(sign(ours_change) = sign(cpi_change) AS INT) AS agrees FROM changes"""))
def mom_change(spark, sf_dir):
    """Changes between adjacent calendar months, and whether both series moved the same way."""
    p = series.adjacent_month_change(pairs(spark, sf_dir), "month", "ours", "ours_change")
    p = series.adjacent_month_change(p, "month", "cpi", "cpi_change")
    agrees = (F.signum("ours_change") == F.signum("cpi_change")).cast("int")
    return p.select(F.date_format("month", "yyyy-MM").alias("month"), F.round("ours_change", 4).alias("ours_change"), F.round("cpi_change", 4).alias("cpi_change"), agrees.alias("agrees"))


INTERPOLATED_SQL = MONTHS_SQL + """,
anchors AS (SELECT month AS x, cpi FROM bench WHERE month(month) % 3 = 1),
around AS (SELECT flight_date, fare, (SELECT max(x) FROM anchors WHERE x <= flight_date) AS px, (SELECT min(x) FROM anchors WHERE x >= flight_date) AS nx FROM days),
filled AS (SELECT flight_date, fare, CASE WHEN px IS NULL THEN n.cpi WHEN nx IS NULL OR px = nx THEN p.cpi ELSE p.cpi + (n.cpi - p.cpi) * date_diff('day', px, flight_date) / date_diff('day', px, nx)::DOUBLE END AS cpi
  FROM around LEFT JOIN anchors p ON p.x = px LEFT JOIN anchors n ON n.x = nx)"""


def filled(spark, sf_dir):
    anchors = benchmark_months(spark, sf_dir).where(F.month("month") % 3 == 1)
    return series.interpolated(days(spark, sf_dir).select("flight_date", "fare"), "flight_date", anchors, "month", "cpi")


@query(with_quotes(INTERPOLATED_SQL + " SELECT strftime(flight_date, '%Y-%m-%d') AS flight_date, round(cpi, 4) AS cpi FROM filled"))
def backtest_interpolated(spark, sf_dir):
    """The benchmark on every day, between quarterly anchors."""
    return filled(spark, sf_dir).select(F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"), F.round("cpi", 4).alias("cpi"))


@query(with_quotes(INTERPOLATED_SQL + """,
split AS (SELECT *, row_number() OVER (ORDER BY flight_date DESC) <= 7 AS held FROM filled),
fit AS (SELECT regr_slope(cpi, fare) AS slope, regr_intercept(cpi, fare) AS intercept, count(*) AS n_train FROM split WHERE NOT held)
SELECT min(n_train) AS n_train, count(*) AS n_held, round(avg(abs(slope * fare + intercept - cpi)), 4) AS mae, round(avg(abs((slope * fare + intercept - cpi) / cpi)) * 100, 4) AS mape FROM split, fit WHERE held"""))
def holdout_fit(spark, sf_dir):
    """A line fitted on all but the last seven days, judged on those."""
    at = Window.orderBy(F.desc("flight_date"))
    rows = filled(spark, sf_dir).withColumn("held", F.row_number().over(at) <= 7)
    fit = rows.where("not held").agg(F.regr_slope("cpi", "fare").alias("slope"), F.regr_intercept("cpi", "fare").alias("intercept"), F.count("*").alias("n_train"))
    _, mae, mape = series.errors(F.col("cpi"), F.col("slope") * F.col("fare") + F.col("intercept"))
    r = rows.where("held").crossJoin(fit).agg(F.min("n_train").alias("n_train"), F.count("*").alias("n_held"), mae, mape)
    return r.select("n_train", "n_held", F.round("mae", 4).alias("mae"), F.round("mape", 4).alias("mape"))


@query(with_quotes(INTERPOLATED_SQL + """,
placed AS (SELECT *, least((row_number() OVER (ORDER BY flight_date) - 1) // greatest((SELECT count(*) FROM filled) // 3, 1), 2) AS part FROM filled)
SELECT CAST(part AS BIGINT) AS part, count(*) AS n, round(corr(fare, cpi), 4) AS correlation FROM placed GROUP BY 1"""))
def subwindow_correlation(spark, sf_dir):
    """Three equal runs of days, the last of which takes the remainder."""
    rows = filled(spark, sf_dir).select("fare", "cpi", (F.row_number().over(Window.orderBy("flight_date")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("all"))
    part = F.least(F.floor(F.col("i") / F.greatest(F.floor(F.col("all") / 3), F.lit(1))), F.lit(2))
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.corr("fare", "cpi"), 4).alias("correlation"))


@query(with_quotes(DAYS_SQL + " SELECT date_diff('day', min(flight_date), max(flight_date)) AS span_days, count(*) AS n_days FROM days"))
def history_span(spark, sf_dir):
    return days(spark, sf_dir).agg(F.datediff(F.max("flight_date"), F.min("flight_date")).cast("long").alias("span_days"), F.count("*").alias("n_days"))


@query(with_quotes(MONTHS_SQL + """
SELECT count(*) AS n_months, round(avg(ours), 4) AS mean, round(max(ours), 4) AS most, round(min(ours), 4) AS least FROM pairs"""))
def index_comparison_summary(spark, sf_dir):
    return pairs(spark, sf_dir).agg(F.count("*").alias("n_months"), F.round(F.avg("ours"), 4).alias("mean"), F.round(F.max("ours"), 4).alias("most"), F.round(F.min("ours"), 4).alias("least"))


@query(with_quotes(LEADS_SQL + """,
base AS (SELECT route_code, max(price) FILTER (lead_days = 30) AS p30 FROM leads GROUP BY 1)
SELECT route_code, CAST(lead_days AS BIGINT) AS lead_days, round((price - p30) / p30 * 100, 4) AS gradient_pct, round(-0.25 + (-1.65 + 0.25) / (1 + exp(-0.18::DOUBLE * (lead_days - 14.5))), 4) AS horizon_elasticity FROM leads JOIN base USING (route_code)"""))
def surge_gradient(spark, sf_dir):
    """Each lead's price against the thirty-day price, null without one, and the logistic elasticity there."""
    from fareloom.functions.scoring import horizon_elasticity

    rows = leads(spark, sf_dir)
    base = rows.groupBy("route_code").agg(F.max(F.when(F.col("lead_days") == 30, F.col("price"))).alias("p30"))
    gradient = F.try_divide(F.col("price") - F.col("p30"), F.col("p30")) * 100
    return rows.join(base, "route_code").select("route_code", F.col("lead_days").cast("long").alias("lead_days"), F.round(gradient, 4).alias("gradient_pct"), F.round(horizon_elasticity(F.col("lead_days")), 4).alias("horizon_elasticity"))


@query(with_quotes(MONTHS_SQL + """
SELECT strftime(month, '%Y-%m') AS month, round(ours - cpi, 4) AS points, round((ours - cpi) / cpi * 100, 4) AS percent FROM pairs"""))
def transport_divergence(spark, sf_dir):
    """Our index against the benchmark of the same month, in points and percent."""
    gap = F.col("ours") - F.col("cpi")
    return pairs(spark, sf_dir).select(F.date_format("month", "yyyy-MM").alias("month"), F.round(gap, 4).alias("points"), F.round(gap / F.col("cpi") * 100, 4).alias("percent"))


@query(with_quotes(LEADS_SQL + """,
steps AS (SELECT *, lag(price) OVER w AS p1, lag(quantity) OVER w AS q1 FROM leads WINDOW w AS (PARTITION BY route_code ORDER BY lead_days DESC)),
moves AS (SELECT route_code, lead_days, ((quantity - q1) / ((quantity + q1) / 2.0::DOUBLE)) / ((price - p1) / ((price + p1) / 2)) AS arc FROM steps WHERE p1 IS NOT NULL)
SELECT route_code, round(least(greatest(max(arc) FILTER (lead_days = 1), -0.45), -0.10), 4) AS short, round(least(greatest(max(arc) FILTER (lead_days = 7), -0.85), -0.50), 4) AS middle, round(least(greatest(max(arc) FILTER (lead_days = 15), -2.50), -1.05), 4) AS long FROM moves GROUP BY 1"""))
def elasticity_clamped(spark, sf_dir):
    """Arc elasticities held inside fixed bands (an option; the raw arcs are in arc_elasticity)."""
    bands = {"short": (1, -0.45, -0.10), "middle": (7, -0.85, -0.50), "long": (15, -2.50, -1.05)}
    arcs = series.arc_elasticity(leads(spark, sf_dir), ["route_code"], "lead_days", "price", "quantity")
    at = lambda day, low, high: F.round(F.least(F.greatest(F.max(F.when(F.col("lead_days") == day, F.col("arc"))), F.lit(low)), F.lit(high)), 4)
    return arcs.groupBy("route_code").agg(*(at(*band).alias(name) for name, band in bands.items()))
