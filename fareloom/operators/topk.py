"""The first rows of each group."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_by(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark keeps ``k`` rows a key and task before it shuffles."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered listing; ``order`` should end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)
