"""As-of joins: each row with the latest row of another table at or before its time, hot keys included."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareloom.operators.layout import fresh, in_blocks


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str], ties: tuple[str, ...] = (), before: bool = False, rows: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the row of ``right`` that has its ``keys`` and the greatest ``right_at`` at or before ``at``.

    Of several such rows the one with the greatest ``ties`` counts. With ``before`` the time must be strictly earlier.
    Rows without a match have null values, as have those with a null key or time; rows of ``right`` with a null key or time match nothing. A
    matched row's null value stays null. Names of ``values`` that ``left`` has get an underscore in front.

    Both sides are laid out as one table in order of key and time. Inside a block of ``rows`` rows the last value is
    carried forward by a window; each block gets the last value of the blocks before it from a window over one
    row a block. So a key may have any number of rows on either side.
    """
    time, side, tie, mine, theirs = (fresh(c, left, right) for c in ("_at", "_side", "_tie", "_left", "_right"))
    names = {c: fresh(c, left) for c in values}
    mine_type = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias(mine)).schema[0].dataType
    tie_value = F.struct(*(F.col(f"`{c}`") for c in ties)) if ties else F.lit(0)
    valid = right.where(F.col(right_at).isNotNull())
    for key in keys:
        valid = valid.where(F.col(key).isNotNull())
    first, second = (1, 0) if before else (0, 1)
    given = valid.select(*keys, F.col(right_at).alias(time), F.lit(first).alias(side), tie_value.alias(tie), F.lit(None).cast(mine_type).alias(mine), F.struct(*(F.col(f"`{c}`") for c in values)).alias(theirs))
    kinds = {c: given.schema[c].dataType for c in (tie, theirs)}
    asking = left.select(*keys, F.col(at).alias(time), F.lit(second).alias(side), F.lit(None).cast(kinds[tie]).alias(tie), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias(mine), F.lit(None).cast(kinds[theirs]).alias(theirs))
    laid, place, block = in_blocks(given.union(asking), [*keys, time, side, tie], "as-of", rows)

    of_block = laid.groupBy(*keys, block).agg(F.max_by(theirs, F.when(F.col(theirs).isNotNull(), F.col(place))).alias(theirs))
    earlier, carried = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1), fresh("_carried", laid)
    carry = of_block.select(*keys, block, F.last(theirs, ignorenulls=True).over(earlier).alias(carried)).where(F.col(carried).isNotNull())
    inside = Window.partitionBy(*keys, block).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    seen = laid.withColumn(theirs, F.last(theirs, ignorenulls=True).over(inside)).where(F.col(mine).isNotNull()).join(carry, [*keys, block], "left")
    found = F.coalesce(F.col(theirs), F.col(carried))
    return seen.select(*(F.col(mine).getField(c).alias(c) for c in left.columns), *(found.getField(c).alias(names[c]) for c in values))


def period_or_latest(asked: DataFrame, periods: DataFrame, period: str, found: str = "found_period") -> DataFrame:
    """``asked`` with the period to read: its own where ``periods`` has it, else the latest that ``periods`` has.

    One row a distinct period decides; null where ``periods`` is empty. A null period counts as absent.
    """
    there = periods.select(F.col(period).alias("_there")).where("_there is not null").distinct()
    latest = there.agg(F.max("_there").alias("_latest"))  # one row
    known = asked.join(there, F.col(period) == F.col("_there"), "left").crossJoin(latest)
    return known.withColumn(found, F.coalesce("_there", "_latest")).drop("_there", "_latest")
