"""Assertions on tables as queries: each returns the rows that are wrong, none if all is well."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.normalize import cites_source


def weights_off(df: DataFrame, group: str, weight: str, tolerance: float = 1e-6) -> DataFrame:
    """Groups whose weights don't add up to one."""
    return df.groupBy(group).agg(F.sum(weight).alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def missing_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of known values of two small dimensions that have no row. Both are the distinct values of one column,
    such as months and corridors."""
    grid = df.select(a).distinct().crossJoin(df.select(b).distinct())
    return grid.join(df.select(a, b).distinct(), [a, b], "left_anti")


def unsound_references(df: DataFrame, month: str, source: str, withdrawn: dict[str, dict[str, float]] = C.WITHDRAWN) -> DataFrame:
    """Reference rows that make a table unfit: a bare official label as source, or a withdrawn value in its month.

    ``withdrawn``: for each column the refused value of some months; columns that ``df`` lacks are left out. A source in other words
    needs no link here, and the same value in another month is sound. ``reason`` names the label first, as the table's own order does.
    """
    label = F.lower(F.trim(F.col(source).cast("string"))).isin(*C.BARE_SOURCES) if source in df.columns else F.lit(False)
    reason = F.when(label, "bare label")
    for column, values in withdrawn.items():
        if column in df.columns:
            for when, value in values.items():
                reason = reason.when((F.col(month) == when) & (F.col(column) == value), F.lit(f"withdrawn {column} of {when}"))
    return df.withColumn("reason", reason).where("reason is not null")


def unsupported_references(df: DataFrame, source: str, value: str, placeholders: list[float] = ()) -> DataFrame:
    """Reference rows, whatever their month, without a citation, without a value, or with one of ``placeholders`` as value; ``reason`` names the first.

    Stricter than ``unsound_references``, which alone makes a table unfit.
    """
    known = F.col(value).isin(*placeholders) if placeholders else F.lit(False)
    reason = F.when(~cites_source(F.col(source)), "no citation").when(F.col(value).isNull(), "no value").when(known, "placeholder")
    return df.withColumn("reason", reason).where("reason is not null")


def latest_cited(df: DataFrame, month: str, source: str) -> DataFrame:
    """The latest row, if it has a citation; otherwise none, rather than an older one."""
    latest = df.agg(F.max(month).alias(month))
    return df.join(latest, month).where(cites_source(F.col(source)))
