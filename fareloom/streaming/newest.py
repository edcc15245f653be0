"""The newest rows of each key of a stream, kept as bounded state."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROW = "event_time timestamp, seq long, row string"


class _Newest(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = {(at, seq): row for at, seq, row in (self.rows.get() if self.rows.exists() else ())}
        for frame in rows:  # a chunk of the key's rows at a time: never more than the bound and one chunk are held
            kept.update({(at.to_pydatetime(), int(seq)): row for at, seq, row in frame[["event_time", "seq", "row"]].itertuples(index=False)})
            kept = dict(sorted(kept.items(), reverse=True)[: self.most])
        self.rows.put([(at, seq, row) for (at, seq), row in kept.items()])
        found = [(key[0], rank, at, seq, row) for rank, ((at, seq), row) in enumerate(kept.items(), 1)]
        yield pd.DataFrame(found, columns=["key", "rank", "event_time", "seq", "row"])

    def close(self) -> None:
        pass


def newest(stream: DataFrame, key: str, event_time: str, seq: str, most: int = 100) -> DataFrame:
    """key, rank, event_time, seq and row (the other columns as JSON) of the ``most`` newest rows of each key that a micro-batch has rows of.

    For update mode: each time a key comes up, all its newest rows are given again, by event time and ``seq``, from rank 1. A row that comes again
    (same event time and seq) replaces itself; rows without an event time or seq are left out. The session needs the state store of ``streaming.dedup``.
    State is bounded by ``most`` rows a key, and rows that arrive late take their place.
    """
    rest = [F.col(f"`{c}`") for c in stream.columns if c not in (key, event_time, seq)]
    row = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    keyed = stream.select(F.col(key).cast("string").alias("key"), F.col(event_time).alias("event_time"), F.col(seq).cast("long").alias("seq"), row.alias("row")).where("event_time is not null and seq is not null")
    return keyed.groupBy("key").transformWithStateInPandas(_Newest(most), f"key string, rank int, {ROW}", "Update", "None")
