"""Tables written in order of a key, so that a group of any size is spread over blocks of a bounded number of rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.sources.scratch import new_path

#: Rows of a block, a power of two.
BLOCK_ROWS = 4096


def fresh(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores in front as it takes to be no column of ``frames``."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from files in the shared folder: later plans start there, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, order: list, name: str, rows: int | None = None, keep: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """``df`` from files, with the names of two added columns: the place of a row in ``order`` and its block.

    ``order``: columns or their names. Ranges of ``order`` are dealt to tasks, so that neither a key's rows nor any others meet in one task;
    places ascend with the order, and a block has ``rows`` neighbouring rows at most. Equal rows are placed in any order. ``keep``: the
    columns that are written (all by default).
    """
    place, block = fresh("_place", df), fresh("_block", df)
    shift = (rows or BLOCK_ROWS).bit_length() - 1
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    kept = ["*"] if keep is None else [f"`{c}`" for c in (*keep, place)]
    return written(laid.select(*kept, F.shiftright(place, shift).alias(block)), name), place, block
