"""Queries on crawler and proxy telemetry, each with its DuckDB twin."""

from pyspark.sql import functions as F

from fareloom.functions.scoring import succeeded
from fareloom.operators import telemetry as T
from fareloom.plans.fixtures import table, telemetry, with_quotes, with_telemetry, quotes

QUERIES: dict = {}
SQL: dict = {}
ORDER = ["created_at", "event_id"]


def _ok():
    return succeeded(F.col("status"))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(with_telemetry("""
SELECT coalesce(crawler, 'ALL') AS crawler, count(*) AS n, count(*) FILTER (NOT ok) AS n_failed, round((count(*) - count(*) FILTER (NOT ok)) * 100.0::DOUBLE / count(*), 4) AS uptime FROM telemetry GROUP BY ROLLUP (crawler)"""))
def crawler_uptime(spark, sf_dir):
    return T.uptime(telemetry(spark, sf_dir), "crawler", _ok()).withColumn("uptime", F.round("uptime", 4))


@query(with_telemetry("""
SELECT crawler, event_type, count(*) AS n, round(avg(response_time_ms), 4) AS mean_ms, CAST(sum(records_extracted) AS BIGINT) AS records FROM telemetry GROUP BY ALL"""))
def error_breakdown(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("crawler", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("response_time_ms"), 4).alias("mean_ms"), F.sum("records_extracted").alias("records"))


@query(with_telemetry("""
SELECT crawler, event_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY crawler ORDER BY created_at DESC, event_id DESC) AS rn FROM telemetry WHERE NOT ok) WHERE rn <= 5"""))
def recent_errors(spark, sf_dir):
    """The five latest errors of each crawler (a top-k report)."""
    from fareloom.operators.topk import top_by

    latest = top_by(telemetry(spark, sf_dir).where(~_ok()), ["crawler"], [F.desc("created_at"), F.desc("event_id")], 5)
    return latest.select("crawler", "event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(with_telemetry(""",
lists AS (SELECT proxy, count(*) AS n, avg(response_time_ms) AS mean, min(response_time_ms) AS least, max(response_time_ms) AS most, list(response_time_ms ORDER BY response_time_ms) AS a FROM telemetry GROUP BY 1)
SELECT proxy, n, round(mean, 4) AS mean, least, most, a[CAST(floor(0.95::DOUBLE * (n - 1)) AS INT) + 1] AS p95, a[CAST(least(floor(0.95::DOUBLE * n), n - 1) AS INT) + 1] AS p95_upper FROM lists"""))
def latency_p95(spark, sf_dir):
    """Latencies of each proxy, with both rank-based 95th percentiles."""
    rows = telemetry(spark, sf_dir)
    by = rows.groupBy("proxy").agg(F.count("*").alias("n"), F.round(F.avg("response_time_ms"), 4).alias("mean"), F.min("response_time_ms").alias("least"), F.max("response_time_ms").alias("most"))
    ranks = T.ranked_percentiles(rows, ["proxy"], "response_time_ms", 0.95)
    return by.join(ranks, "proxy").select("proxy", "n", "mean", "least", "most", F.col("lower").alias("p95"), F.col("upper").alias("p95_upper"))


RUNS_SQL = """,
islands AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY proxy ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM telemetry),
runs AS (SELECT *, sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY proxy, island ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS run FROM islands)"""


@query(with_telemetry(RUNS_SQL + " SELECT proxy, CAST(run AS BIGINT) AS run, count(*) AS n FROM runs WHERE run > 0 GROUP BY ALL"))
def failure_runs(spark, sf_dir):
    return T.failure_runs(telemetry(spark, sf_dir), "proxy", ORDER, _ok()).where("run > 0").groupBy("proxy", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"))


@query(with_telemetry(RUNS_SQL + """
SELECT proxy, count(*) AS n, count(*) FILTER (NOT ok) AS n_failed, CAST(max(run) AS BIGINT) AS longest_run, CAST(arg_max(run, (created_at, event_id)) AS BIGINT) AS run,
  CASE WHEN arg_max(run, (created_at, event_id)) >= 3 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM runs GROUP BY 1"""))
def proxy_state(spark, sf_dir):
    return T.health(telemetry(spark, sf_dir), "proxy", ORDER, _ok())


@query(with_telemetry(""",
lists AS (SELECT proxy, count(*) AS n, list({'v': response_time_ms, 'ok': ok} ORDER BY created_at, event_id) AS e FROM telemetry GROUP BY 1),
folded AS (SELECT proxy, n, list_reduce(list_transform(e, lambda x: x), lambda s, x: {'v': CASE WHEN x.ok THEN 0.3::DOUBLE * x.v + 0.7::DOUBLE * s.v ELSE s.v + 1000 END, 'ok': true}, {'v': e[1].v, 'ok': true}) AS s FROM lists)
SELECT proxy, n, round(s.v, 4) AS score FROM folded"""))
def ewma_score(spark, sf_dir):
    return T.ewma(telemetry(spark, sf_dir), "proxy", ORDER, "response_time_ms", _ok()).withColumn("score", F.round("score", 4))


@query(with_telemetry("""
SELECT count(*) AS n, count(DISTINCT crawler) AS n_crawlers, count(DISTINCT proxy) AS n_proxies, count(DISTINCT CAST(created_at AS DATE)) AS n_days, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest FROM telemetry"""))
def service_health(spark, sf_dir):
    return telemetry(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("crawler").alias("n_crawlers"), F.countDistinct("proxy").alias("n_proxies"), F.countDistinct(F.to_date("created_at")).alias("n_days"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query(with_quotes(""",
live AS (SELECT portal, count(*) AS n, count(DISTINCT event_time) AS n_times FROM quotes GROUP BY 1),
seen AS (SELECT DISTINCT list_extract(['indigo', 'spicejet', 'airindia', 'makemytrip'], CAST(user_id % 4 + 1 AS INT)) AS portal FROM events WHERE event_type != 'error')
SELECT l.portal, n, n_times, CASE WHEN s.portal IS NOT NULL THEN 'confirmed' WHEN n_times > 1 THEN 'unconfirmed' ELSE 'suspect' END AS verdict FROM live l LEFT JOIN seen s ON l.portal = s.portal"""))
def provenance_audit(spark, sf_dir):
    """Sources of quotes against the telemetry that should have produced them."""
    from fareloom.plans.fixtures import pick

    live = quotes(spark, sf_dir).groupBy("portal").agg(F.count("*").alias("n"), F.countDistinct("event_time").alias("n_times"))
    crawled = table(spark, sf_dir, "events").where("event_type != 'error'")
    seen = crawled.select(pick(["indigo", "spicejet", "airindia", "makemytrip"], F.col("user_id") % 4).alias("portal")).distinct().withColumn("seen", F.lit(True))
    verdict = F.when(F.col("seen"), "confirmed").when(F.col("n_times") > 1, "unconfirmed").otherwise("suspect")
    return live.join(seen, "portal", "left").select("portal", "n", "n_times", verdict.alias("verdict"))


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k, round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 4) AS mean_k FROM events GROUP BY 1""")
def json_props_extract(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total_k"), F.round(F.avg(k), 4).alias("mean_k"))


@query("""
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS slot, event_type, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*)) / 100 AS mean FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    """Tumbling windows of six hours over the event stream (an extra)."""
    by = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))
    by = by.withColumn("mean", F.round(F.col("hundredths").cast("double") / F.col("n")) / 100)  # whole numbers are summed: no order of addition can matter
    return by.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("slot"), "event_type", "n", "mean")


@query("""
WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
sessions AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
each AS (SELECT user_id, session, count(*) AS n FROM sessions GROUP BY ALL)
SELECT n AS events, count(*) AS n_sessions FROM each GROUP BY 1""")
def event_sessions(spark, sf_dir):
    """Sessions that end after twelve quiet hours (an extra)."""
    each = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("events"))
    return each.groupBy("events").agg(F.count("*").alias("n_sessions"))
