"""Stored quotes laid out for look-ups: by corridor and day, and by a key.

Files lie in a folder a month and are sorted by corridor and day. A look-up of a corridor opens the footers of its months' files and reads the
row groups whose corridors and days hold it, one or two files of a month, and in them the pages of its days. A look-up by key asks
the Bloom filter of each row group: groups without the key are not read. Nothing is kept beside the table: rows of a new month are a
new folder.
"""

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a file, and so the most keys that its Bloom filter has to hold.
FILE_ROWS = 2_000_000
MONTH = "stored_month"


@dataclass(frozen=True)
class Lookup:
    """A table below ``path`` with the columns ``schema``: ``corridor`` and ``day`` (a date) order it, ``key`` has the Bloom filter."""

    spark: SparkSession
    path: str
    schema: StructType
    corridor: tuple[str, ...]
    day: str
    key: str

    def laid(self, rows: DataFrame, made: Callable[[DataFrame], DataFrame] | None = None, dealt: tuple[Column, ...] | None = None) -> DataFrame:
        """``rows`` with their month, in the order of the files. See ``write``."""
        if MONTH in rows.columns:
            raise ValueError(f"{MONTH} is the table's own column")
        names = [f"`{c}`" for c in self.schema.names]
        *corridor, day, rest = dealt or (F.col(f"`{c}`") for c in (*self.corridor, self.day, self.key))
        ranges = (rows if made else rows.select(*names)).repartitionByRange(F.trunc(day, "month"), *corridor, day, rest)  # values that aren't shuffled
        month = F.coalesce(F.date_format(self.day, "yyyy-MM"), F.lit("none"))
        return (made(ranges) if made else ranges).select(*names).withColumn(MONTH, month).sortWithinPartitions(MONTH, *self.corridor, self.day, self.key)

    def write(self, rows: DataFrame, file_rows: int = FILE_ROWS, made: Callable[[DataFrame], DataFrame] | None = None, dealt: tuple[Column, ...] | None = None) -> None:
        """Makes ``rows`` the months that they are of; other months stay as they are. Rows without a day are a month of their own.

        Ranges of month and corridor are dealt to tasks by a sample, so that a month or corridor of any size is spread; a file has ``file_rows`` rows at
        most. ``rows`` must not come from the table itself. Where stored rows follow from narrower ``rows``, one from each, ``made`` makes
        them behind the shuffle; ``dealt`` is then the corridor, the day and what tells a day's rows apart, in terms of ``rows``.
        """
        writer = self.laid(rows, made, dealt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows)
        bloom = {f"parquet.bloom.filter.enabled#{self.key}": "true", f"parquet.bloom.filter.expected.ndv#{self.key}": str(file_rows)}
        writer.options(**bloom).partitionBy(MONTH).parquet(self.path)

    def read(self) -> DataFrame:
        """All rows, with the month that they are stored under."""
        return self.spark.read.schema(StructType([*self.schema.fields]).add(MONTH, "string")).parquet(self.path)

    def _months(self, first: dt.date, last: dt.date) -> Column:
        return F.col(MONTH).between(f"{first:%Y-%m}", f"{last:%Y-%m}")

    def in_corridor(self, corridor: tuple, first: dt.date, last: dt.date) -> DataFrame:
        """The rows of a corridor from the day ``first`` to ``last``; a null in ``corridor`` stands for rows without that value."""
        found = self.read().where(self._months(first, last)).where(F.col(self.day).between(F.lit(first), F.lit(last)))
        for column, value in zip(self.corridor, corridor, strict=True):
            found = found.where(F.col(column).isNull() if value is None else F.col(column) == value)
        return found.drop(MONTH)

    def by_key(self, *keys, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """The rows of some keys, of all months or those of ``first`` to ``last``. Many keys are better joined with ``read()``."""
        found = self.read() if first is None or last is None else self.read().where(self._months(first, last)).where(F.col(self.day).between(F.lit(first), F.lit(last)))
        is_one = F.lit(False)
        for key in keys:  # equalities, not a list: each asks the Bloom filter
            is_one = is_one | (F.col(self.key) == key)
        return found.where(is_one).drop(MONTH)
