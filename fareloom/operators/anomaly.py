"""Baselines over calendar days and over observations, and bounded histories."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions import scoring
from fareloom.operators.layout import fresh


def rolling_days(df: DataFrame, keys: list[str], day: str, value: str, days: int) -> DataFrame:
    """``df`` with n_base, mean, deviation and previous of the last ``days`` calendar days, today left out.

    With one day in the window the deviation is 0; without any mean, deviation and previous are null.
    """
    at = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-days, -1)
    n = F.count(value).over(at)
    return df.select("*", n.alias("n_base"), F.avg(value).over(at).alias("mean"), F.when(n > 0, F.coalesce(F.stddev_samp(value).over(at), F.lit(0.0))).alias("deviation"), F.last(value).over(at).alias("previous"))


def rolling_rows(df: DataFrame, keys: list[str], order: str, value: str, rows: int) -> DataFrame:
    """``df`` with n_base and mean of the last ``rows`` observations, this one left out."""
    at = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    return df.select("*", F.count(value).over(at).alias("n_base"), F.avg(value).over(at).alias("mean"))


def running_max_before(df: DataFrame, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` of all rows before, by ``bucket`` and ``order`` inside it.

    Two levels: the maxima of whole buckets (one row each) run over all buckets, a window inside each bucket does
    the rest. So no task gets all rows.
    """
    inside, earlier, most = (fresh(c, df) for c in ("_inside", "_earlier", "_most"))
    of_bucket = df.groupBy(bucket).agg(F.max(value).alias(most))
    before = of_bucket.select(bucket, F.max(most).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)).alias(earlier))
    here = F.max(value).over(Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(inside, here).join(before, bucket).withColumn(name, F.greatest(inside, earlier)).drop(inside, earlier)


def batch_lead_days(window: Column) -> Column:
    """Lead days as the batch evaluation takes them from a window's digits: any 1 gives 1 (T+15 too), then 7, 15 and 30; 7 for all others."""
    found = F.lit(7)
    for digits in ("30", "15", "7", "1"):
        found = F.when(F.contains(window, F.lit(digits)), int(digits)).otherwise(found)
    return F.coalesce(found, F.lit(7))


def _surge_alone(fare: Column, mean: Column, deviation: Column, lead_days: Column, previous: Column, hhi: float) -> Column:
    """``scoring.surge`` without peers: fences from mean and deviation, the mean as the route's median."""
    none = F.lit(None).cast("double")
    return scoring.surge(fare, mean, deviation, lead_days, previous, mean, F.lit(0), none, none, F.lit(hhi))


def judged_quotes(quotes: DataFrame, baselines: DataFrame, keys: list[str], window: str, fare: str, hhi: float = C.SHARES_HHI) -> DataFrame:
    """``quotes`` with ``surge``, the struct of ``scoring.surge``, against mean, deviation and previous of their key in ``baselines`` (one row a key).

    A key without a baseline has the default one, previous fare included.
    """
    known, names = _with_baselines(quotes, baselines, keys, dict(zip(("mean", "deviation", "previous"), C.DEFAULT_BASELINE, strict=True)))
    mean, deviation, previous = map(F.col, names)
    return known.withColumn("surge", _surge_alone(F.col(fare).cast("double"), mean, deviation, batch_lead_days(F.col(window)), previous, hhi)).drop(*names)


def _with_baselines(quotes: DataFrame, baselines: DataFrame, keys: list[str], default: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """``quotes`` with the columns ``default`` of their key in ``baselines``, or their defaults, and the names that these columns have there."""
    names = {c: fresh(f"_{c}", quotes) for c in default}
    known = quotes.join(baselines.select(*keys, *(F.col(c).alias(n) for c, n in names.items())), keys, "left")
    return known.withColumns({n: F.coalesce(F.col(n), F.lit(default[c])) for c, n in names.items()}), list(names.values())


def judged_by_inputs(quotes: DataFrame, baselines: DataFrame, keys: list[str], window: str, fare: str, lead_days: str) -> DataFrame:
    """``quotes`` judged twice, a row each, with inputs and surge: ``published`` as in ``judged_quotes``; ``measured`` by the column median of
    ``baselines`` and the columns n_peers, q1, q3, hhi and ``lead_days`` of ``quotes``."""
    default = dict(zip(("mean", "deviation", "previous", "median"), (*C.DEFAULT_BASELINE, C.DEFAULT_BASELINE[0]), strict=True))
    known, names = _with_baselines(quotes, baselines, keys, default)
    mean, deviation, previous, median = map(F.col, names)
    none, taken = F.lit(None).cast("double"), "inputs lead median n q1 q3 hhi".split()
    published = (F.lit("published"), batch_lead_days(F.col(window)), mean, F.lit(0).cast("long"), none, none, F.lit(C.SHARES_HHI))
    measured = (F.lit("measured"), F.col(lead_days).cast("int"), median, F.col("n_peers").cast("long"), F.col("q1"), F.col("q3"), F.col("hhi"))
    made = {c: c if c == "inputs" else fresh(f"_own_{c}", known) for c in taken}
    each = F.array(*(F.struct(*(v.alias(made[c]) for c, v in zip(taken, values, strict=True))) for values in (published, measured)))
    v = {c: F.col(n) for c, n in made.items()}
    surge = scoring.surge(F.col(fare).cast("double"), mean, deviation, v["lead"], previous, v["median"], v["n"], v["q1"], v["q3"], v["hhi"])
    return known.select("*", F.inline(each)).withColumn("surge", surge).select(*quotes.columns, "inputs", "surge")


def alerts(baselined: DataFrame, fare: str, lead_days: str, hhi: float = C.DAILY_HHI) -> DataFrame:
    """The rows of ``gated`` that raise an alert."""
    return gated(baselined, fare, lead_days, hhi).where("severity is not null")


def gated(baselined: DataFrame, fare: str, lead_days: str, hhi: float = C.DAILY_HHI) -> DataFrame:
    """``baselined`` (mean, deviation and previous beside each fare) with z, dod, surge, severity and kind; the last two are null without an alert.

    Without a positive mean only a daily change of 40 % and more from a positive previous fare does (CRITICAL, SURGE_PRICING). The daily
    change is unknown where the previous fare is not positive. Peers are not looked at.
    """
    f, mean, deviation, previous = F.col(fare), F.col("mean"), F.coalesce("deviation", F.lit(0.0)), F.col("previous")
    based = F.coalesce(mean > 0, F.lit(False))
    dod = F.when(previous > 0, (f - previous) / previous)
    rows = baselined.withColumns({"z": F.when(based, scoring.z_score(f, mean, deviation)), "dod": dod, "surge": F.when(based, _surge_alone(f, mean, deviation, F.col(lead_days), previous, hhi))})
    severity, kind = scoring.alert(F.col("z"), F.col("dod"), F.col("surge"))
    jump = ~based & (F.col("dod") >= C.DOD_CRITICAL)
    raised = {"severity": F.when(based, severity).when(jump, "CRITICAL"), "kind": F.when(based, kind).when(jump, "SURGE_PRICING")}
    return rows.withColumns(raised)


def alerts_by_inputs(known: DataFrame, fare: str, lead_days: str) -> DataFrame:
    """The alerts of ``known``, a row each, with inputs, severity and kind: ``published`` are those of ``alerts``; ``measured`` ones are judged by
    the columns route_median, n_peers, q1, q3 and hhi of ``known``, and a day without a history is its own baseline there."""
    rows = gated(known, fare, lead_days)
    f, own = F.col(fare), fresh("_surge", rows)
    mean, deviation = F.coalesce("mean", f), F.coalesce("deviation", F.lit(0.0))
    rows = rows.withColumn(own, scoring.surge(f, mean, deviation, F.col(lead_days), F.col("previous"), *map(F.col, ("route_median", "n_peers", "q1", "q3", "hhi"))))
    severity, kind = scoring.alert(scoring.z_score(f, mean, deviation), F.col("dod"), F.col(own))
    judged = {"published": (F.col("severity"), F.col("kind")), "measured": (severity, kind)}
    each = F.array(*(F.struct(F.lit(name).alias("inputs"), s.alias("severity"), k.alias("kind")) for name, (s, k) in judged.items()))
    return rows.select(*known.columns, F.inline(each)).where("severity is not null")
