"""Price differences between a carrier's own portals and agencies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.constants import CARRIER_SITES, DIRECT_PORTALS, DIRECT_SITES

#: What ``compared`` adds.
VENUES = ["gap", "percent", "buy_at", "sell_at", "direction"]


def is_direct(portal: Column, carrier: Column) -> Column:
    """Whether a portal is a carrier's own: by its name, else where it has the brand or the code of the quote's carrier in it.

    Portal and carrier go without case and outer blanks. A carrier's two letters match anywhere (those of IX in "ixigo" too, as
    published); a null portal or one that is neither is an agency's.
    """
    name, code = F.lower(F.trim(F.coalesce(portal, F.lit("")))), F.upper(F.trim(F.coalesce(carrier, F.lit(""))))
    found = name.isin(*DIRECT_SITES) | ((code != "") & name.contains(F.lower(code)))
    for known, brand in CARRIER_SITES.items():
        found = found | ((code == known) & name.contains(brand))
    return found


def compared(df: DataFrame) -> DataFrame:
    """``df`` (direct_fare, direct_portal, agency_fare, agency_portal) with ``VENUES``; null where a side is missing."""
    gap = F.col("agency_fare") - F.col("direct_fare")
    known = df.withColumn("gap", gap).withColumn("percent", F.try_divide(gap, F.col("direct_fare")) * 100)
    cheaper = F.col("gap") > 0
    return known.select(
        "*",
        F.when(cheaper, F.col("direct_portal")).when(~cheaper, F.col("agency_portal")).alias("buy_at"),
        F.when(cheaper, F.col("agency_portal")).when(~cheaper, F.col("direct_portal")).alias("sell_at"),
        F.when(F.col("gap") > 1e-4, "agency_premium").when(F.col("gap") < -1e-4, "agency_discount").when(F.col("gap").isNotNull(), "parity").alias("direction"),
    )


def venue_spreads(df: DataFrame, flight: list[str], portal: str, fare: str, order: list[str]) -> DataFrame:
    """The cheapest direct and agency offer of each flight that has both, their gap and where to buy and sell.

    One aggregation: the least struct of fare, tie-breakers and portal on either side.
    """
    direct = F.col(portal).isin(*DIRECT_PORTALS)
    offer = F.struct(fare, *order, portal)
    best = df.groupBy(*flight).agg(F.min(F.when(direct, offer)).alias("d"), F.min(F.when(~direct, offer)).alias("a")).where("d is not null and a is not null")
    gap = F.col("a")[fare] - F.col("d")[fare]
    return best.select(
        *flight,
        F.col("d")[fare].alias("direct_fare"),
        F.col("a")[fare].alias("agency_fare"),
        gap.alias("gap"),
        (F.try_divide(gap, F.col("d")[fare]) * 100).alias("percent"),
        F.when(gap > 0, F.col("d")[portal]).otherwise(F.col("a")[portal]).alias("buy_at"),
        F.when(gap > 0, F.col("a")[portal]).otherwise(F.col("d")[portal]).alias("sell_at"),
        F.when(gap > 1e-4, "agency_premium").when(gap < -1e-4, "agency_discount").otherwise("parity").alias("direction"),
    )
