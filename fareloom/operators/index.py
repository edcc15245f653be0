"""From quotes to price indices: dedup, outlier bounds, weighted medians, composites and index numbers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fareloom import constants as C
from fareloom.functions.scoring import fisher
from fareloom.operators.layout import fresh, in_blocks, written


def least_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``, with all its columns; give an order without ties.

    For a filter on the first row number Spark keeps one row a key and task before it shuffles (WindowGroupLimit).
    """
    rank = fresh("_rank", df)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def tukey_bounds(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """n, q1, q3, lower and upper of each group; below four values the bounds are their extremes."""
    valid = df.where(~F.isnan(value) & F.col(value).isNotNull())
    stats = valid.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"), F.min(value).alias("least"), F.max(value).alias("most"))
    spread = F.col("q3") - F.col("q1")
    return stats.select(
        *keys,
        "n",
        "q1",
        "q3",
        F.when(F.col("n") < 4, F.col("least")).otherwise(F.col("q1") - k * spread).alias("lower"),
        F.when(F.col("n") < 4, F.col("most")).otherwise(F.col("q3") + k * spread).alias("upper"),
    )


def tukey_inside(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """The rows inside their group's bounds.

    The percentiles come from counts of distinct values, which are added up before the shuffle; rows only meet a row
    a group, so a group may have any number of them.
    """
    lower, upper = fresh("_lower", df), fresh("_upper", df)
    bounds = tukey_bounds(df, keys, value, k).select(*keys, F.col("lower").alias(lower), F.col("upper").alias(upper))
    return df.join(bounds, keys).where(F.col(value).between(F.col(lower), F.col(upper))).drop(lower, upper)


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, size: str, rows: int | None = None) -> DataFrame:
    """``df`` from files with two more columns: ``rank``, the place of a row in its group from 0, and ``size``, the rows of its group.

    Rows are laid out by key and ``order`` in blocks of ``rows``. A row's rank is its place in its block and the group's rows in the
    blocks before, which a window over one row a block adds up: a group of any size stays spread over tasks. Null keys are a group.
    """
    laid, place, block = in_blocks(df, [*keys, *order], "ranked", rows)
    first, here = fresh("_first", laid), fresh("_here", laid)
    counts = laid.groupBy(*keys, block).agg(F.min(place).alias(first), F.count("*").alias(here))
    of_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(here).over(of_key.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, block, (before - F.col(first)).alias(first), F.sum(here).over(of_key).alias(size))
    both = with_group(laid, written(starts, "ranked-starts"), [*keys, block])
    return both.withColumn(rank, F.col(place) + F.col(first)).drop(place, block, first)


def with_group(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``groups`` (one row a key, from files, so that Spark can split a hot key of ``df``); null keys meet."""
    names = {k: fresh(f"_of_{k}", df, groups) for k in keys}
    renamed = groups.select(*(F.col(k).alias(n) if (n := names.get(k)) else F.col(k) for k in groups.columns))
    meets = F.lit(True)
    for k, n in names.items():
        meets = meets & F.col(k).eqNullSafe(F.col(n))
    return df.join(renamed, meets).drop(*names.values())


def leave_one_out_outliers(df: DataFrame, keys: list[str], value: str, order: list[str], k: float = 1.5, least_peers: int = 4, rows: int | None = None) -> DataFrame:
    """``df`` with ``outlier``: outside the bounds of the other rows of its group, which must be four at least.

    The element at 0-based place p of the others is the group's element p, or p + 1 from the left-out one on,
    so a quartile of the others needs three neighbouring order statistics of the whole group: six values a group, found by
    rank (``ranked``). No task holds a whole group.
    """
    rank, size, flag = (fresh(c, df) for c in ("_rank", "_size", "outlier"))
    placed = ranked(df, keys, [value, *order], rank, size, rows)
    others = F.col(size) - 1
    low = {p: F.floor(p * (others - 1)) for p in (0.25, 0.75)}
    names = {(p, j): fresh(f"_at{int(p * 100)}_{j}", df) for p in low for j in range(3)}
    wanted = [F.max(F.when(F.col(rank) == low[p] + j, F.col(value))).alias(name) for (p, j), name in names.items()]
    picked = with_group(placed, written(placed.groupBy(*keys).agg(*wanted), "quartile-values"), keys)

    def quantile(p: float):
        at, r = p * (others - 1), F.col(rank)
        first = F.when(low[p] < r, F.col(names[p, 0])).otherwise(F.col(names[p, 1]))
        second = F.when(low[p] + 1 < r, F.col(names[p, 1])).otherwise(F.col(names[p, 2]))
        return first + (at - low[p]) * F.when(at > low[p], second - first).otherwise(0.0)

    q1, q3 = quantile(0.25), quantile(0.75)
    outside = (F.col(value) < q1 - k * (q3 - q1)) | (F.col(value) > q3 + k * (q3 - q1))
    return picked.select(*(F.col(f"`{c}`") for c in df.columns), F.when(others >= least_peers, outside).otherwise(F.lit(False)).alias(flag))


def share_weighted_median(df: DataFrame, keys: list[str], value: str, carrier: str) -> DataFrame:
    """``fare`` and n of each group: the median under carrier shares, renormalised over the carriers present and
    split evenly over a carrier's rows. A cumulative weight of one half takes the middle to the next value.

    Rows are counted by carrier and value first, on both sides of the shuffle: what is ranked is distinct values.
    """
    known = F.create_map(*(F.lit(x) for pair in C.CARRIER_SHARES.items() for x in pair))
    share = F.coalesce(F.try_element_at(known, F.col(carrier)), F.lit(C.UNKNOWN_SHARE))
    counts = df.groupBy(*keys, carrier, value).agg(F.count("*").alias("n"))
    rows = counts.withColumn("_own", F.sum("n").over(Window.partitionBy(*keys, carrier))).withColumn("_weight", share * F.col("n") / F.col("_own"))
    return _weighted_median(rows, keys, value, F.col("_weight"), F.col("n"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``fare`` and n of each group: the weighted median of ``value``, the plain one where the weights add up to nothing."""
    return _weighted_median(df, keys, value, F.col(weight), F.lit(1))


def _weighted_median(df: DataFrame, keys: list[str], value: str, weight, n) -> DataFrame:
    values = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.sum(n).alias("_n"))
    at = Window.partitionBy(*keys)
    up = at.orderBy(value)
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_w").over(at)
    cumulative = F.when(total > 0, F.sum("_w").over(so_far) / F.nullif(total, F.lit(0.0))).otherwise(F.sum("_n").over(so_far) / F.sum("_n").over(at))
    rows = values.select(*keys, value, "_n", cumulative.alias("_cum"), F.lead(value).over(up).alias("_next"))
    reached = rows.groupBy(*keys).agg(F.min(F.when(F.col("_cum") >= 0.5 - C.EPSILON, F.struct(value, "_cum", "_next"))).alias("m"), F.sum("_n").alias("n"))
    middle = F.when((F.abs(F.col("m._cum") - 0.5) <= C.EPSILON) & F.col("m._next").isNotNull(), (F.col(f"m.{value}") + F.col("m._next")) / 2)
    return reached.select(*keys, F.coalesce(middle, F.col(f"m.{value}")).alias("fare"), "n")


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, default: float) -> DataFrame:
    """``mean`` under weights of which missing ones count as ``default``; null where they add up to nothing."""
    w = F.coalesce(F.col(weight), F.lit(default))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * w), F.nullif(F.sum(w), F.lit(0.0))).alias("mean"))


def composite(df: DataFrame, keys: list[str], window: str, value: str, n: str = "n") -> DataFrame:
    """``composite``: mean over the windows present, weighted by their fixed weights, an even mix without any; and the
    number of windows and of the rows behind them."""
    known = F.create_map(*(F.lit(x) for pair in C.WINDOW_WEIGHTS.items() for x in pair))
    weight = F.coalesce(F.try_element_at(known, F.col(window)), F.lit(0.0))
    sums = df.groupBy(*keys).agg(F.sum(weight * F.col(value)).alias("_wp"), F.sum(weight).alias("_w"), F.avg(value).alias("_even"), F.count("*").alias("n_windows"), F.sum(n).alias("quantity"))
    return sums.select(*keys, F.when(F.col("_w") > 0, F.try_divide("_wp", "_w")).otherwise(F.col("_even")).alias("composite"), "n_windows", "quantity")


def with_base(df: DataFrame, unit: str, period: str, *columns: str) -> DataFrame:
    """The unit's values in its first period beside each row, as ``base_<column>``."""
    first = Window.partitionBy(unit).orderBy(period)
    return df.select("*", *(F.first(c).over(first).alias(f"base_{c}") for c in columns))


def index_numbers(df: DataFrame, period: str, price: str, quantity: str, base_price: str, base_quantity: str) -> DataFrame:
    """Modified and true Laspeyres, Paasche, Fisher and the substitution bias of each period, base 100.

    Rows with a base price of zero or less don't count.
    """
    p, q, p0, q0 = (F.col(c) for c in (price, quantity, base_price, base_quantity))
    sums = df.where(p0 > 0).groupBy(period).agg(
        F.count("*").alias("n_units"),
        (F.sum(q0 * p / p0) / F.nullif(F.sum(q0), F.lit(0)) * 100).alias("laspeyres"),
        (F.sum(p * q0) / F.nullif(F.sum(p0 * q0), F.lit(0.0)) * 100).alias("laspeyres_true"),
        (F.sum(p * q) / F.nullif(F.sum(p0 * q), F.lit(0.0)) * 100).alias("paasche"),
    )
    ideal = sums.withColumn("fisher", fisher(F.col("laspeyres"), F.col("paasche")))
    bias = F.col("laspeyres") - F.col("fisher")
    return ideal.withColumns({"bias": bias, "bias_pct": F.try_divide(bias, F.col("fisher")) * 100})


def concentration(df: DataFrame, keys: list[str], carrier: str) -> DataFrame:
    """``hhi``: sum of the squared shares of carriers in each group's rows."""
    counts = df.groupBy(*keys, carrier).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"), F.count("*").alias("n_carriers"))
