"""Counters of a quote stream, observed while it runs and added up over its micro-batches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = ("processed", "duplicates", "minima", "out_of_order")


def counts(flags: tuple[str, str, str] = ("duplicate_price", "new_minimum", "out_of_order")) -> list:
    """The aggregates of ``COUNTS`` over resolved quotes."""
    return [F.count("*").alias(COUNTS[0]), *(F.count_if(F.col(flag)).alias(name) for flag, name in zip(flags, COUNTS[1:], strict=True))]


def observed(resolved: DataFrame, name: str = "quotes") -> DataFrame:
    """``resolved`` (stream or batch), which reports its counts under ``name`` with every micro-batch."""
    return resolved.observe(name, *counts())


class Counters(StreamingQueryListener):
    """Totals of the counts observed under ``name``; add it to the session's streams before the query starts.

    A micro-batch that runs again after a failure replaces its first report, so that each counts once. ``rows`` has the last progress
    of each query: rows of input and state.
    """

    def __init__(self, name: str = "quotes"):
        self.name, self._batches, self.rows = name, {}, {}

    @property
    def totals(self) -> dict[str, int]:
        return {c: sum(batch[c] for batch in self._batches.values()) for c in COUNTS}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is not None:
            self._batches[str(progress.id), progress.batchId] = seen.asDict()
        state = [s.numRowsTotal for s in progress.stateOperators]
        self.rows[str(progress.id)] = {"input": progress.numInputRows, "state": sum(state)}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
