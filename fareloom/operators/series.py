"""Time series: calendar buckets, lagged comparison, interpolation between anchors and fits.

Series here are one row a day or a month, so a window over a whole series is small; series of many units
are partitioned by unit.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iso_week(day: Column) -> Column:
    """The ISO year and week, as 2027-W05."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def with_change(df: DataFrame, unit: list[str], order: str, value: str, name: str = "change_pct") -> DataFrame:
    """``df`` with the percent change from the row before; null for the first."""
    before = F.lag(value).over(Window.partitionBy(*unit).orderBy(order))
    return df.withColumn(name, F.try_divide(F.col(value) - before, before) * 100)


def calendar_change(df: DataFrame, unit: list[str], day: str, value: str, days: int, name: str) -> DataFrame:
    """``df`` with the percent change from exactly ``days`` days earlier; null where that day is missing."""
    at = Window.partitionBy(*unit).orderBy(F.unix_date(day)).rangeBetween(-days, -days)
    before = F.avg(value).over(at)
    return df.withColumn(name, F.try_divide(F.col(value) - before, before) * 100)


def adjacent_month_change(df: DataFrame, month: str, value: str, name: str, skipped: list[tuple[str, str]] = ()) -> DataFrame:
    """``df`` with the percent change from the calendar month before; null across a gap or a skipped pair."""
    before = df.select(F.add_months(month, 1).alias(month), F.col(value).alias("_before"))
    joined = df.join(before, month, "left")
    refused = F.lit(False)
    for a, b in skipped:
        refused = refused | ((F.date_format(F.add_months(month, -1), "yyyy-MM") == a) & (F.date_format(month, "yyyy-MM") == b))
    return joined.withColumn(name, F.when(~refused, F.try_divide(F.col(value) - F.col("_before"), F.col("_before")) * 100)).drop("_before")


def lagged_correlation(df: DataFrame, order: str, ours: str, theirs: str, most: int, least_pairs: int = 3) -> DataFrame:
    """lag, n and correlation for lags of -most..most rows; a positive lag means that ours leads.

    Rows are numbered once and joined on the number: a lag costs no pass of its own.
    """
    numbered = df.select(F.row_number().over(Window.orderBy(order)).alias("i"), ours, theirs)
    left = numbered.select(F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "i", ours).withColumn("j", F.col("i") + F.col("lag"))
    joined = left.join(numbered.select(F.col("i").alias("j"), theirs), "j")
    found = joined.groupBy("lag").agg(F.count("*").alias("n"), F.corr(ours, theirs).alias("correlation"))
    return found.withColumn("correlation", F.when(F.col("n") >= least_pairs, F.col("correlation")))


def cross_correlation(df: DataFrame, order: str, ours: str, theirs: str, most: int) -> DataFrame:
    """lag and correlation normalised by the whole series' means and deviations; 0 where one of them doesn't vary."""
    numbered = df.select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(ours).alias("x"), F.col(theirs).alias("y"))
    whole = numbered.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.sqrt(F.count("*") * F.var_pop("x") * F.count("*") * F.var_pop("y")).alias("scale"))
    left = numbered.select(F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "i", "x").withColumn("j", F.col("i") + F.col("lag"))
    joined = left.join(numbered.select(F.col("i").alias("j"), "y"), "j").crossJoin(whole)  # one row
    total = F.sum((F.col("x") - F.col("mx")) * (F.col("y") - F.col("my")))
    return joined.groupBy("lag").agg(F.when(F.max("scale") <= 1e-12, 0.0).otherwise(total / F.max("scale")).alias("correlation"))


def pearson(ours: Column, theirs: Column, least_pairs: int = 2, degenerate: float | None = None) -> Column:
    """Aggregate: correlation of at least ``least_pairs`` pairs; ``degenerate`` (null) where it has no value."""
    n = F.count_if(ours.isNotNull() & theirs.isNotNull())
    scale = F.stddev_pop(ours) * F.stddev_pop(theirs)
    return F.coalesce(F.when(n >= least_pairs, F.try_divide(F.covar_pop(ours, theirs), scale)), F.lit(degenerate).cast("double"))


def best_lag(lags: DataFrame) -> DataFrame:
    """The row of the greatest correlation; ties go to the lag nearest to 0, then to the smaller one."""
    order = F.struct(F.col("correlation"), -F.abs("lag"), -F.col("lag"))
    return lags.where("correlation is not null").agg(F.max_by(F.struct("lag", "n", "correlation"), order).alias("r")).where("r is not null").select("r.*")


def interpolated(days: DataFrame, day: str, anchors: DataFrame, anchor_day: str, value: str) -> DataFrame:
    """``days`` with ``value`` interpolated between the anchors around each day, level beyond both ends.

    Anchors and days are one ordered stream: the last anchor before and the first one after are windows.
    """
    marked = days.withColumns({"_x": F.unix_date(day), "_a": F.lit(None).cast("struct<x:int,v:double>")})
    points = anchors.select(F.unix_date(anchor_day).alias("_x"), F.struct(F.unix_date(anchor_day).alias("x"), F.col(value).cast("double").alias("v")).alias("_a"))
    both = marked.unionByName(points, allowMissingColumns=True)
    order = [F.col("_x"), F.col("_a").isNull()]
    at = Window.orderBy(*order)
    stream = both.select("*", F.last("_a", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0)).alias("_p"), F.first("_a", ignorenulls=True).over(at.rowsBetween(0, Window.unboundedFollowing)).alias("_n"))
    p, n = F.col("_p"), F.col("_n")
    inner = p["v"] + (n["v"] - p["v"]) * (F.col("_x") - p["x"]) / F.nullif((n["x"] - p["x"]).cast("double"), F.lit(0.0))
    out = F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(F.coalesce(inner, p["v"]))
    return stream.where(F.col("_a").isNull()).select(*days.columns, out.alias(value))


def errors(actual: Column, fitted: Column) -> list[Column]:
    """rmse, mae and mape of a fit."""
    gap = fitted - actual
    return [F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), (F.avg(F.abs(F.try_divide(gap, actual))) * 100).alias("mape")]


def arc_elasticity(df: DataFrame, unit: list[str], lead: str, price: str, quantity: str) -> DataFrame:
    """``df`` with the midpoint elasticity towards the next shorter lead; 0 where the price hardly moves."""
    longer = Window.partitionBy(*unit).orderBy(F.desc(lead))
    p1, q1 = F.lag(price).over(longer), F.lag(quantity).over(longer)
    dp = (F.col(price) - p1) / ((F.col(price) + p1) / 2)
    dq = (F.col(quantity) - q1) / ((F.col(quantity) + q1) / 2)
    return df.withColumn("arc", F.when(p1.isNotNull(), F.when(F.abs(dp) <= 1e-6, 0.0).otherwise(F.try_divide(dq, dp))))
