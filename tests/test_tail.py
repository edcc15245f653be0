"""The tail of a table by id: each row once, restarts included, in several tasks."""

import time

import pytest
from pyspark.sql import functions as F

from fareloom.sources import tail
from fareloom.sources.tail import Heartbeat, TailById

SCHEMA = "id long, fare double, note string"


@pytest.fixture
def table(spark, tmp_path):
    spark.dataSource.register(TailById)

    def add(ids, parts=1):
        rows = [(i, float(i), None if i % 3 else f"n{i}") for i in ids]
        spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("append").parquet(str(tmp_path / "table"))

    return add, str(tmp_path / "table")


def stream(spark, path, **options):
    reader = spark.readStream.format("tail_by_id").schema("fare double, id long, note string, more int").option("path", path)
    return reader.options(**options).load()


def run(df, tmp_path, name):
    query = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return [r.id for r in df.sparkSession.read.parquet(str(tmp_path / name)).orderBy("id").collect()]


def test_restarts_read_each_id_once(spark, table, tmp_path):
    add, path = table
    add(range(1, 50), 3)
    assert run(stream(spark, path), tmp_path, "out") == list(range(1, 50))
    assert run(stream(spark, path), tmp_path, "out") == list(range(1, 50))
    add(range(50, 80), 2)
    add([7, 80])  # an old id that comes late is not new
    assert run(stream(spark, path), tmp_path, "out") == list(range(1, 81))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert all(r.fare == r.id and r.more is None and r.note == (None if r.id % 3 else f"n{r.id}") for r in rows)
    assert run(stream(spark, path, after="75"), tmp_path, "tail") == [76, 77, 78, 79, 80]


def test_row_groups_are_dealt_to_tasks(spark, table, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "table").mkdir()
    pq.write_table(pa.table({"id": list(range(1, 101)), "fare": [0.5] * 100}), tmp_path / "table" / "a.parquet", row_group_size=10)
    pq.write_table(pa.table({"id": pa.array([None, None], pa.int64()), "fare": [0.5] * 2}), tmp_path / "table" / "nulls.parquet")
    monkeypatch.setattr(tail, "GROUPS_A_TASK", 2)
    reader = tail.TailReader(stream(spark, str(tmp_path / "table")).schema, {"path": str(tmp_path / "table")})
    spans = reader.partitions({"id": 35}, reader.latestOffset())
    assert [s.groups for s in spans] == [(3, 4), (5, 6), (7, 8), (9,)]
    assert [i for s in spans for b in reader.read(s) for i in b.column("id").to_pylist()] == list(range(36, 101))
    assert reader.partitions({"id": 100}, {"id": 100}) == []


def test_an_empty_folder_has_nothing(spark, table, tmp_path):
    _, path = table
    reader = tail.TailReader(stream(spark, path).schema, {"path": path})
    assert reader.latestOffset() == reader.initialOffset() == {"id": 0} and reader.partitions({"id": 0}, {"id": 0}) == []


def test_heartbeats_between_batches(spark, table, tmp_path):
    add, path = table
    add([1, 2, 3])
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "200ms")
    sent = []
    listener = Heartbeat(sent.append)
    spark.streams.addListener(listener)
    query = stream(spark, path).writeStream.format("memory").queryName("tail_beats").option("checkpointLocation", str(tmp_path / "beats")).trigger(processingTime="200 milliseconds").start()
    try:
        wait = time.time() + 60
        while time.time() < wait and {m["type"] for m in sent} != {"update", "no_update"}:
            time.sleep(0.2)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    assert sum(m["rows"] for m in sent) == 3 and {m["type"] for m in sent} == {"update", "no_update"}
    assert spark.table("tail_beats").agg(F.sum("id")).first()[0] == 6
