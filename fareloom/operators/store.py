"""Upserts, retention and membership between tables; every function returns the new table.

Plain Parquet has no row updates: write the result to a new place and switch to it, never over what is read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.operators.index import least_by


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Replayed rows: the first one of each key in ``order`` stays."""
    return least_by(df, keys, order)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], updates: list[str] | None = None, when: Column | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` (one a key): new keys are added; of known ones the columns
    ``updates`` (all, if not given) are taken over where ``when``, on the target's columns, holds."""
    updates = [c for c in target.columns if c not in keys] if updates is None else updates
    t = target.select(*keys, F.struct(*(c for c in target.columns if c not in keys)).alias("_t"), *([] if when is None else [when.alias("_when")]))
    s = source.select(*keys, F.struct(*(F.col(c) for c in target.columns if c not in keys)).alias("_s"))
    both = t.join(s, keys, "full_outer")
    taken = F.col("_s").isNotNull() & (F.lit(True) if when is None else F.coalesce(F.col("_when"), F.lit(False)))

    def value(c: str) -> Column:
        new, old = F.col(f"_s.{c}"), F.col(f"_t.{c}")
        if c not in updates:
            return F.when(F.col("_t").isNull(), new).otherwise(old)
        return F.when(F.col("_t").isNull() | taken, new).otherwise(old)

    return both.select(*(F.col(c) if c in keys else value(c).alias(c) for c in target.columns))


def upsert_where(target: DataFrame, source: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """``upsert`` among the rows of ``target`` for which ``condition`` holds; the others stay and match nothing."""
    holds = F.coalesce(condition, F.lit(False))
    return upsert(target.where(holds), source, keys).unionByName(target.where(~holds))


def of_day(df: DataFrame, day: str, flight_date: str, captured: str, newest: list, most: int = 5000) -> DataFrame:
    """Rows whose flight or capture is on ``day``; where there are none, the ``most`` newest ones in the order ``newest``."""
    on = F.to_date(F.lit(day))
    rows = df.where((F.col(flight_date) == on) | (F.to_date(captured) == on))
    return df.orderBy(*newest).limit(most) if rows.isEmpty() else rows


def replace_by_key(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` whose key is not in ``source``, and all rows of ``source``."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def retained(df: DataFrame, *expired: Column) -> DataFrame:
    """The rows for which no condition of expiry holds; unknown counts as not expired."""
    gone = F.lit(False)
    for condition in expired:
        gone = gone | F.coalesce(condition, F.lit(False))
    return df.where(~gone)


def normalized_weights(df: DataFrame, group: str, unit: str, volume: str, places: int = 6) -> DataFrame:
    """``weight`` of each unit in its group and ``rank`` by volume; rounding differences go to rank 1."""
    from pyspark.sql import Window

    at = Window.partitionBy(group)
    rows = df.select(group, unit, volume, F.round(F.col(volume) / F.sum(volume).over(at), places).alias("_w"), F.row_number().over(at.orderBy(F.desc(volume), unit)).alias("rank"))
    rows = rows.withColumn("_rest", 1 - F.sum("_w").over(at))
    return rows.select(group, unit, volume, "rank", F.round(F.when(F.col("rank") == 1, F.col("_w") + F.col("_rest")).otherwise(F.col("_w")), places).alias("weight"))


def directed_flows(df: DataFrame, a: str, b: str, outward: str, inward: str) -> DataFrame:
    """Rows with a volume each way become a row for each direction: origin, destination, volume."""
    both = df.select(F.explode(F.array(F.struct(F.col(a).alias("origin"), F.col(b).alias("destination"), F.col(outward).alias("volume")), F.struct(F.col(b).alias("origin"), F.col(a).alias("destination"), F.col(inward).alias("volume")))).alias("f"))
    return both.select("f.*").groupBy("origin", "destination").agg(F.sum("volume").alias("volume"))
