"""Health of crawlers and proxies from an event log."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def uptime(df: DataFrame, unit: str, ok) -> DataFrame:
    """Attempts, failures and uptime percent of each unit, and of all as unit ALL, in one pass."""
    by = df.rollup(unit).agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_failed"), F.grouping(unit).alias("_all"))
    name = F.when(F.col("_all") == 1, "ALL").otherwise(F.col(unit))
    return by.select(name.alias(unit), "n", "n_failed", F.coalesce(F.try_divide((F.col("n") - F.col("n_failed")) * 100.0, F.col("n")), F.lit(100.0)).alias("uptime"))


def ranked_percentiles(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """lower and upper of each group: the values at places floor(share * (n - 1)) and min(floor(share * n), n - 1)
    of its sorted values, not interpolated. Null values don't count. Only counts of distinct values are ranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    at = Window.partitionBy(*keys)
    rows = counts.select(*keys, value, F.sum("_c").over(at.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_c").over(at).alias("_n"))
    n = F.col("_n")
    pick = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    return rows.groupBy(*keys).agg(pick(F.floor((n - 1) * share)).alias("lower"), pick(F.least(F.floor(n * share), n - 1)).alias("upper"))


def failure_runs(df: DataFrame, unit: str, order: list[str], ok) -> DataFrame:
    """``df`` with ``run``: failures in a row up to and with this event, 0 after a success.

    Two levels: runs inside a unit's day (the day of the first column of ``order``), and what each day takes over
    from the days before, from one row a day. So no task gets all events of a unit.
    """
    day = [unit, "_day"]
    marked = df.withColumns({"_day": F.to_date(order[0]), "_ok": ok.cast("int")})
    # failures behind a day's last success, all of them in a day without one, go on into the next day
    last = F.max(F.when(F.col("_ok") == 1, F.struct(*order)))
    ends = marked.groupBy(*day).agg(last.alias("_last"))
    tails = marked.join(ends, day).groupBy(*day).agg(F.count_if((F.col("_ok") == 0) & (F.col("_last").isNull() | (F.struct(*order) > F.col("_last")))).alias("_tail"), F.max("_ok").alias("_any"))
    along = Window.partitionBy(unit).orderBy("_day")
    tails = tails.withColumn("_island", F.sum("_any").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    upto = F.sum("_tail").over(Window.partitionBy(unit, "_island").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    carried = tails.withColumn("_upto", upto).select(*day, F.coalesce(F.lag("_upto").over(along), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumn("_successes", F.sum("_ok").over(inside)).join(carried, day)
    own = F.sum(1 - F.col("_ok")).over(Window.partitionBy(*day, "_successes").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    run = own + F.when(F.col("_successes") == 0, F.col("_carried")).otherwise(0)
    return rows.select(*df.columns, run.alias("run"))


def ewma(df: DataFrame, unit: str, order: list[str], value: str, ok, alpha: float = 0.3, penalty: float = 1000.0) -> DataFrame:
    """``score`` of each unit: exponential mean of the values in order, plus a penalty for each failure.

    A step is s -> alpha * v + (1 - alpha) * s after a success and s -> s + penalty after a failure, from the first
    value on. Unrolled, each step's own part counts (1 - alpha) to the number of later successes, so the
    score is a sum over events. Later successes are those of later days, from one row a day, and those inside the
    event's day: no unit's history has to meet in one task.
    """
    day = [unit, "_day"]
    rows = df.select(unit, *order, F.col(value).cast("double").alias("_v"), ok.cast("int").alias("_ok"), F.to_date(order[0]).alias("_day"))
    days = rows.groupBy(*day).agg(F.sum("_ok").alias("_s"))
    after = Window.partitionBy(unit).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*day, F.coalesce(F.sum("_s").over(after), F.lit(0)).alias("_days_later"))
    later = Window.partitionBy(*day).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_later", F.coalesce(F.sum("_ok").over(later), F.lit(0))).join(days, day)
    part = F.when(F.col("_ok") == 1, alpha * F.col("_v")).otherwise(penalty) * F.pow(F.lit(1 - alpha), F.col("_later") + F.col("_days_later"))
    start = F.min_by("_v", F.struct(*order)) * F.pow(F.lit(1 - alpha), F.sum("_ok"))
    return rows.withColumn("_part", part).groupBy(unit).agg(F.count("*").alias("n"), (start + F.sum("_part")).alias("score"))


def health(df: DataFrame, unit: str, order: list[str], ok, threshold: int = 3) -> DataFrame:
    """Last state of each unit: DEGRADED while the current run of failures reaches ``threshold``."""
    runs = failure_runs(df, unit, order, ok)
    last = F.max_by("run", F.struct(*order))
    return runs.groupBy(unit).agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_failed"), F.max("run").cast("long").alias("longest_run"), last.cast("long").alias("run")).withColumn("state", F.when(F.col("run") >= threshold, "DEGRADED").otherwise("HEALTHY"))
