"""The newest rows of a key equal a row number over all rows so far, at every micro-batch."""

import datetime as dt
import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from fareloom.streaming.dedup import STATE_STORE
from fareloom.streaming.newest import newest

SCHEMA = "route string, at timestamp, id long, fare double"


def test_newest_rows_at_every_batch(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "A", "B", None]), start + dt.timedelta(minutes=rng.randrange(400)), k, float(k)) for k in range(240)] + [("A", None, 900, 1.0)]
    for part in range(3):
        spark.createDataFrame([*rows[80 * part : 80 * (part + 1)], *(rows[240:] if part == 2 else rows[:1])], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    seen = {}

    def keep(batch, number):
        seen[number] = batch.collect()

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = newest(stream, "route", "at", "id", most=7).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    current = {}
    assert len(seen) == 3
    for number in sorted(seen):
        for key in {r.key for r in seen[number]}:
            current[key] = [(r.rank, r.event_time, r.seq, r.row) for r in sorted((r for r in seen[number] if r.key == key), key=lambda r: r.rank)]
        df = spark.createDataFrame(rows[: 80 * (number + 1)], SCHEMA)
        rank = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("at"), F.desc("id")))
        twin = df.withColumn("rank", rank).where("rank <= 7").withColumn("row", F.to_json(F.struct("fare"))).orderBy("route", "rank").collect()
        assert {k: [(r["rank"], r["at"], r["id"], r["row"]) for r in twin if r["route"] == k] for k in current} == current
    assert set(current) == {"hot", "A", "B", None} and len(current["hot"]) == 7
