"""Stored Parquet tables that runs write back to, a partition at a time.

Writes replace whole partitions (dynamic partition overwrite): Spark writes new files beside the table and moves them in
when all tasks are done, so a write that fails leaves what was there, and partitions that the new rows don't touch keep their
files. Rows that come from the table itself are written to scratch first.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fareloom.operators.layout import written
from fareloom.operators.store import upsert


@dataclass
class Store:
    """Tables below ``path``, each partitioned by ``partition``."""

    spark: SparkSession
    path: str
    partition: str = "day"

    def _location(self, table: str) -> str:
        return f"{self.path.rstrip('/')}/{table}"

    def _folder(self, table: str, *below: str):
        """The Hadoop file system and path of the table's folder."""
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path("/".join([self._location(table), *below]))
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target

    def exists(self, table: str) -> bool:
        files, folder = self._folder(table)
        return files.exists(folder)

    def read(self, table: str, schema: StructType | str) -> DataFrame:
        """The table with the columns of ``schema``; no rows where nothing was written."""
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._location(table))

    def replace(self, table: str, rows: DataFrame, days: list) -> int:
        """Makes ``rows``, all of ``days``, the partitions of those days, and returns their number; a day without rows becomes empty.

        Rows must not come from the table itself.
        """
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self._location(table))
        counts = dict(rows.groupBy(self.partition).count().collect())  # one row a day named
        self.drop(table, [d for d in days if d not in counts])
        return sum(counts.values())

    def drop(self, table: str, days: list) -> None:
        """Deletes whole partitions."""
        for day in days:
            files, folder = self._folder(table, f"{self.partition}={day}")
            files.delete(folder, True)

    def upsert(self, table: str, source: DataFrame, keys: list[str], when: Column | None = None) -> None:
        """Adds the rows of ``source`` (one a key, the partition column among ``keys``) or takes them over where ``when``, on the stored row, holds.

        Only the partitions that ``source`` has rows of are read and written.
        """
        source = written(source, f"{table}-source")
        days = [r[0] for r in source.select(self.partition).distinct().collect()]  # one value a partition that is written
        stored = self.read(table, source.schema).where(F.col(self.partition).isin(days))
        self.replace(table, written(upsert(stored, source, keys, when=when), f"{table}-merged"), days)

    def expire(self, table: str, schema: StructType | str, before, *expired: Column) -> None:
        """Deletes partitions before the day ``before``, and in the others the rows for which any condition holds.

        A partition without such rows keeps its files.
        """
        if not self.exists(table):
            return
        stored = self.read(table, schema)
        days = [r[0] for r in stored.select(self.partition).distinct().collect()]  # one value a partition
        self.drop(table, [d for d in days if d < before])
        if not expired:
            return
        gone = F.lit(False)
        for condition in expired:
            gone = gone | F.coalesce(condition, F.lit(False))
        stored = self.read(table, schema)
        touched = [r[0] for r in stored.where(gone).select(self.partition).distinct().collect()]
        if touched:
            kept = written(stored.where(F.col(self.partition).isin(touched) & ~gone), f"{table}-kept")
            self.replace(table, kept, touched)
