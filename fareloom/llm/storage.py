"""Intermediate tables in the shared folder that the cluster names.

Everything that must outlive a stage is written as Parquet below ``spark.checkpoint.dir``; every
executor and the driver see that folder, so losing an executor loses no intermediate result.
"""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fareloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/fareloom-{uuid.uuid4().hex}-{name}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


#: With it Spark deletes the shuffle files of a query when that query ends, and not when the driver next collects garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: later plans start from the files, and what was shuffled for them is deleted."""
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(FREES_SHUFFLES, None)
    conf.set(FREES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREES_SHUFFLES) if before is None else conf.set(FREES_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores in front as it takes to be no column of ``frames``."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def task_count(spark: SparkSession, size: int, each: int, most_each: int, most_tasks: int = 20_000) -> int:
    """Tasks for ``size`` units at ``each`` a task; more a task, up to ``most_each``, where they would be too many."""
    return max(1, min(spark.sparkContext.defaultParallelism, size), min(most_tasks, -(-size // each)), -(-size // most_each))
