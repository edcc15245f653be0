"""Anomaly scores on a stream: each fare is scored against the last ones of its key and then joins them."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fareloom.constants import EPSILON

OUTPUT = "key string, event_time timestamp, seq long, fare double, n_base int, mean double, z double"


def evaluate_stream(stream: DataFrame, history: int = 30, window: str = "300 seconds", retention_ms: int = 86_400_000) -> DataFrame:
    """n_base, mean and z of each fare of ``stream`` (key, event_time, seq, fare) over the last ``history`` fares of its key.

    Without a history mean and z are null; with no deviation z is 0 at the mean and 999 with its sign elsewhere.
    State is a bounded list a key and goes once the watermark is the retention time past its last fare.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = json.loads(state.get[0]) if state.exists else []
        rows = []
        for q in pd.concat(list(frames)).sort_values(["event_time", "seq"], kind="stable").itertuples(index=False):
            n, mean, z = len(past), None, None
            if n:
                mean = sum(past) / n
                deviation = (sum((x - mean) ** 2 for x in past) / (n - 1)) ** 0.5 if n > 1 else 0.0
                gap = q.fare - mean
                z = gap / deviation if deviation > EPSILON else 0.0 if abs(gap) <= EPSILON else 999.0 if gap > 0 else -999.0
            rows.append((key[0], q.event_time, q.seq, float(q.fare), n, mean, z))
            past = [*past, float(q.fare)][-history:]
        state.update((json.dumps(past),))
        state.setTimeoutTimestamp(max(int(q.event_time.timestamp() * 1000), state.getCurrentWatermarkMs() + 1) + retention_ms)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return stream.withWatermark("event_time", window).groupBy("key").applyInPandasWithState(step, OUTPUT, "past string", "append", GroupStateTimeout.EventTimeTimeout)


def append_alerts(scored: DataFrame, path: str, checkpoint: str, least_z: float = 2.0):
    """Starts a query that appends scores of ``least_z`` and more to Parquet, a batch at a time and once each."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.where(f"abs(z) >= {least_z}").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
