"""Views of the driver tables as price quotes, crawler telemetry and a monthly benchmark series.

Each view exists twice: as a DataFrame and as the text of a DuckDB common table expression. Rows of the
order tables have no key of their own; ``seq1``..``seq4`` with date and fare break every tie.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.operators.layout import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index) -> "F.Column":
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


#: Carriers, booking windows and portals of the domain.
CARRIERS = ["6E", "AI", "IX", "QP", "SG"]
WINDOWS = ["T+1", "T+7", "T+15", "T+30", "T+45"]
PORTALS = ["indigo", "spicejet", "airindia", "makemytrip", "easemytrip", "yatra", "ixigo"]


def quote_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What quotes are made of, in few and narrow columns; dimension tables are small and Spark broadcasts them by their size.

    Orders meet their customers first, so that line items, the widest rows, are shuffled once; names come last.
    """
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    place = lambda key, name: F.broadcast(places.select(F.col("n_nationkey").alias(key), F.col("r_name").alias(name)))  # noqa: E731 - 25 nations
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(place("c_nationkey", "origin"), "c_nationkey")
        .join(place("s_nationkey", "destination"), "s_nationkey")
        .where("origin != destination")
        .select("origin", "destination", *(f"l_{c}" for c in "orderkey partkey suppkey linenumber extendedprice discount tax returnflag shipdate".split()), "o_orderdate")
    )


def quotes_of(facts: DataFrame) -> DataFrame:
    """The quote of each row of ``quote_facts``, which needs no other row."""
    index = F.col("l_orderkey") % 5
    return facts.select(
        "origin",
        "destination",
        F.concat_ws("-", "origin", "destination").alias("route_code"),
        F.to_date("l_shipdate").alias("flight_date"),
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period"),
        pick(CARRIERS, F.col("l_suppkey") % 5).alias("carrier"),
        (F.col("l_partkey") % 40).cast("long").alias("flight_no"),
        pick(WINDOWS, index).alias("booking_window"),
        F.element_at(F.array(*map(F.lit, [1, 7, 15, 30, 45])), (index + 1).cast("int")).alias("lead_days"),
        pick(PORTALS, (F.col("l_linenumber") - 1) % 7).alias("portal"),
        F.col("l_extendedprice").alias("total_fare"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("base_fare"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_extendedprice") * F.col("l_tax")).alias("taxes"),
        F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_returnflag") == "A", "scheduled").alias("flight_status"),
        F.col("o_orderdate").alias("event_time"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_partkey").alias("seq2"),
        F.col("l_suppkey").alias("seq3"),
        F.col("l_linenumber").cast("long").alias("seq4"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from line items."""
    return quotes_of(quote_facts(spark, sf_dir))


SEQUENCE = ["seq1", "seq2", "seq3", "seq4", "flight_date", "total_fare"]

QUOTES_SQL = """
places AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
quotes AS (
  SELECT o.r_name AS origin, d.r_name AS destination, o.r_name || '-' || d.r_name AS route_code,
    CAST(l_shipdate AS DATE) AS flight_date, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period,
    list_extract(['6E', 'AI', 'IX', 'QP', 'SG'], CAST(l_suppkey % 5 + 1 AS INT)) AS carrier, CAST(l_partkey % 40 AS BIGINT) AS flight_no,
    list_extract(['T+1', 'T+7', 'T+15', 'T+30', 'T+45'], CAST(l_orderkey % 5 + 1 AS INT)) AS booking_window,
    list_extract([1, 7, 15, 30, 45], CAST(l_orderkey % 5 + 1 AS INT)) AS lead_days,
    list_extract(['indigo', 'spicejet', 'airindia', 'makemytrip', 'easemytrip', 'yatra', 'ixigo'], CAST((l_linenumber - 1) % 7 + 1 AS INT)) AS portal,
    l_extendedprice AS total_fare,
    CASE WHEN l_partkey % 3 != 0 THEN l_extendedprice * (1 - l_discount) END AS base_fare,
    CASE WHEN l_partkey % 4 != 0 THEN l_extendedprice * l_tax END AS taxes,
    CASE l_returnflag WHEN 'R' THEN 'cancelled' WHEN 'A' THEN 'scheduled' END AS flight_status,
    o_orderdate AS event_time, l_orderkey AS seq1, l_partkey AS seq2, l_suppkey AS seq3, CAST(l_linenumber AS BIGINT) AS seq4
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN places o ON c_nationkey = o.n_nationkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN places d ON s_nationkey = d.n_nationkey
  WHERE o.r_name != d.r_name),
eligible AS (SELECT * FROM quotes WHERE coalesce(flight_status, '') NOT IN ('cancelled', 'sold_out'))"""


def with_quotes(sql: str) -> str:
    return f"WITH {QUOTES_SQL.strip()}{sql}"


#: Statuses of runs that failed and of runs that count as successes.
BAD_RUNS, GOOD_RUNS = ["FAILED", "TIMEOUT", " blocked ", "RATE_LIMITED"], ["SUCCESS", "SUCCESS", "PARTIAL", "FALLBACK_CACHE", ""]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.concat(F.lit("crawler"), (F.col("user_id") % 4).cast("string")).alias("crawler"),
        F.concat(F.lit("proxy"), (F.col("user_id") % 12).cast("string")).alias("proxy"),
        F.when(F.col("event_type") == "error", pick(BAD_RUNS, F.col("event_id") % 4)).otherwise(pick(GOOD_RUNS, F.col("event_id") % 5)).alias("status"),
        F.col("event_type"),
        F.col("value").alias("response_time_ms"),
        F.col("ts").alias("created_at"),
        props["k"].cast("long").alias("records_extracted"),
    )


TELEMETRY_SQL = """
telemetry AS (
  SELECT event_id, 'crawler' || (user_id % 4) AS crawler, 'proxy' || (user_id % 12) AS proxy,
    CASE WHEN event_type = 'error' THEN list_extract(['FAILED', 'TIMEOUT', ' blocked ', 'RATE_LIMITED'], CAST(event_id % 4 + 1 AS INT)) ELSE list_extract(['SUCCESS', 'SUCCESS', 'PARTIAL', 'FALLBACK_CACHE', ''], CAST(event_id % 5 + 1 AS INT)) END AS status,
    event_type != 'error' AS ok, event_type, value AS response_time_ms, ts AS created_at,
    CAST(json_extract(props, '$.k') AS BIGINT) AS records_extracted FROM events)"""


def with_telemetry(sql: str) -> str:
    return f"WITH {TELEMETRY_SQL.strip()}{sql}"


def benchmark_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month and cpi: the monthly average order price, 100 in the first month. Orders are read once, for a row a month in files."""
    by = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("level"))
    by = written(by, "benchmark-months")
    first = by.agg(F.min_by("level", "month").alias("base"))
    return by.crossJoin(first).select("month", (F.col("level") / F.col("base") * 100).alias("cpi"))


BENCHMARK_SQL = """
levels AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS level FROM orders GROUP BY 1),
bench AS (SELECT month, level / (SELECT arg_min(level, month) FROM levels) * 100 AS cpi FROM levels)"""
