"""Many delivered files of volumes, a month each, taken in with what is wrong with them: bad lines, missing rows, changed files.

Lines are read as text with their file and parsed by CSV rules in the same pass, so that a bad line costs neither its file nor
the run. The manifest has a row a file: its lines, rows and a checksum of its lines in any order, which tells a changed file from one delivered again.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a line that doesn't fit the schema is kept whole.
CORRUPT = "corrupt_line"
MANIFEST = "file string, n_lines long, n_rows long, n_bad long, checksum decimal(38,0)"


def delivered(spark: SparkSession, path: str, schema: str, header: str | None = None, comment: str = "#", name: Column | None = None) -> DataFrame:
    """A row a line of all files below ``path``: file, line, the columns of ``schema`` and ``CORRUPT``.

    ``name``: what file is, an expression of the column ``path``, such as the month in a folder's name; the whole path otherwise.

    A line with too few or too many fields or a value that isn't of its column's type is corrupt: its columns are null and ``CORRUPT`` has it whole. An
    empty field is null, which is no fault here. Blank lines, comments and lines that equal ``header`` are no rows. Quoted
    fields may not hold line breaks: a file of any size is split over tasks.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.rtrim("value", F.lit("\r")).alias("line"))
    lines = lines.select((F.col("path") if name is None else name).alias("file"), "line")
    said = F.trim("line")
    wanted = (said != "") & ~said.startswith(comment)
    if header is not None:
        wanted = wanted & (F.lower(said) != header.lower())
    parsed = F.from_csv("line", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.where(wanted).withColumn("parsed", parsed)
    names = [c.split()[0] for c in schema.split(", ")]
    good = F.col(f"parsed.{CORRUPT}").isNull()
    return rows.select("file", "line", *(F.when(good, F.col(f"parsed.{c}")).alias(c) for c in names), F.col(f"parsed.{CORRUPT}").alias(CORRUPT))


def bad_lines(rows: DataFrame) -> DataFrame:
    """file and ``CORRUPT`` of each line of ``delivered`` that doesn't fit."""
    return rows.where(F.col(CORRUPT).isNotNull()).select("file", CORRUPT)


def manifest(rows: DataFrame) -> DataFrame:
    """``MANIFEST`` of ``delivered`` rows. Counts and sums are made where the lines are read: a row a file and task is shuffled."""
    number = F.xxhash64("line").cast("decimal(38,0)")
    return rows.groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if(F.col(CORRUPT).isNull()).alias("n_rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("n_bad"), F.sum(number).cast("decimal(38,0)").alias("checksum"))


def changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """file and change (added, removed, changed) of each file that two manifests differ in; files with the same lines in any order don't."""
    same = F.col("a.checksum").eqNullSafe(F.col("b.checksum")) & F.col("a.n_lines").eqNullSafe(F.col("b.n_lines"))
    change = F.when(F.col("b.file").isNull(), "added").when(F.col("a.file").isNull(), "removed").when(~same, "changed")
    both = new.alias("a").join(old.alias("b"), F.col("a.file") == F.col("b.file"), "full")
    return both.select(F.coalesce("a.file", "b.file").alias("file"), change.alias("change")).where("change is not null")


def faults(rows: DataFrame, month: str, corridor: str, volume: str, expected: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """problem, file and what of everything that makes the ``delivered`` rows unfit; no rows if all is well.

    bad line: doesn't fit the schema. no volume: null, zero or less. repeated: a month and corridor in several rows (once each, of the least file).
    missing: a pair of ``expected`` (month, corridor) without a row that has a volume. pinned: a published value of ``pinned`` (month, corridor, volume)
    that no row has, with what was found in its place. ``expected`` and ``pinned`` are joined, not collected.
    """
    pair = F.concat_ws(" ", F.col(month).cast("string"), corridor)
    good = rows.where(F.col(CORRUPT).isNull())
    bad = bad_lines(rows).select(F.lit("bad line").alias("problem"), "file", F.col(CORRUPT).alias("what"))
    none = good.where(~F.coalesce(F.col(volume) > 0, F.lit(False))).select(F.lit("no volume").alias("problem"), "file", pair.alias("what"))
    # one pass: a row a month and corridor
    pairs = good.groupBy(month, corridor).agg(F.count("*").alias("n"), F.min("file").alias("file"), F.max(volume).alias("most"), F.min(volume).alias("least"))
    again = pairs.where("n > 1").select(F.lit("repeated").alias("problem"), "file", pair.alias("what"))
    filled = pairs.where("most > 0")
    missing = expected.select(month, corridor).distinct().join(filled, [month, corridor], "left_anti").select(F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("file"), pair.alias("what"))
    found = bad.unionByName(none).unionByName(again).unionByName(missing)
    if pinned is None:
        return found
    wanted = pinned.select(month, corridor, F.col(volume).cast("long").alias("wanted"))
    off = wanted.join(pairs, [month, corridor], "left").where(~(F.col("most").eqNullSafe(F.col("wanted")) & F.col("least").eqNullSafe(F.col("wanted"))))
    told = F.concat(pair, F.lit(": "), F.coalesce(F.col("most").cast("string"), F.lit("nothing")), F.lit(" for "), F.col("wanted").cast("string"))
    return found.unionByName(off.select(F.lit("pinned").alias("problem"), "file", told.alias("what")))
