"""Look-ups read the files and row groups that they must, and find what a full scan finds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructType

from fareloom.sources.lookup import MONTH, Lookup

SCHEMA = StructType()
for name, kind in {"origin": StringType(), "destination": StringType(), "day": DateType(), "key": StringType(), "fare": DoubleType(), "odd": StringType()}.items():
    SCHEMA.add(name, kind)
PLACES = ["BLR", "BOM", "CCU", "DEL", "HYD", "MAA"]


def quotes(n, seed=1):
    rng = random.Random(seed)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(120))
    return [(rng.choice(PLACES), rng.choice(PLACES), day(), f"{rng.getrandbits(64):016x}", float(rng.randrange(100)), None) for _ in range(n)]


def metrics(df):
    """Rows found and what the scan of ``df`` read."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    read = leaves.apply(0).metrics()
    return rows, {name: read.apply(name).value() for name in ("numFiles", "numOutputRows", "numPartitions")}


@pytest.fixture
def table(spark, tmp_path):
    made = Lookup(spark, str(tmp_path / "quotes"), SCHEMA, ("origin", "destination"), "day", "key")
    given = quotes(12_000) + [("DEL", None, dt.date(2024, 2, 3), "hot", 1.0, "x")] * 3 + [(None, "DEL", None, None, None, None), ("DEL", "BOM", None, "hot", 2.0, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made.write(spark.createDataFrame(given, SCHEMA), file_rows=500)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return made, given


def same(found, expected):
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_a_corridor_reads_one_month_and_few_rows(spark, table):
    made, given = table
    first, last = dt.date(2024, 2, 10), dt.date(2024, 2, 12)
    found, read = metrics(made.in_corridor(("DEL", "BOM"), first, last))
    same(found, [r for r in given if r[:2] == ("DEL", "BOM") and r[2] and first <= r[2] <= last])
    assert found and read["numPartitions"] == 1 and read["numOutputRows"] <= 1000, read
    found, _ = metrics(made.in_corridor(("DEL", None), first.replace(day=1), last))
    same(found, [r for r in given if r[1] is None and r[0] == "DEL"])
    assert len(found) == 3
    same(made.in_corridor(("X", "Y"), first, last).collect(), [])


def test_a_key_reads_one_row_group(spark, table):
    made, given = table
    for wanted in (given[17][3], given[11_000][3]):
        found, read = metrics(made.by_key(wanted))
        same(found, [r for r in given if r[3] == wanted])
        assert read["numOutputRows"] <= 500, read
    found, read = metrics(made.by_key("nowhere"))
    assert found == [] and read["numOutputRows"] <= 500, read
    same(made.by_key("hot", given[5][3]).collect(), [r for r in given if r[3] in ("hot", given[5][3])])
    day = given[5][2]
    found, read = metrics(made.by_key(given[5][3], first=day, last=day))
    same(found, [given[5]])
    assert read["numPartitions"] == 1
    assert made.by_key().collect() == []


def test_months_are_replaced_one_by_one(spark, table):
    made, given = table
    same(made.read().drop(MONTH).collect(), given)
    kept = {f for f in made.read().inputFiles() if f"{MONTH}=2024-03" not in f}
    new = [("DEL", "BOM", dt.date(2024, 3, 5), "new", 5.0, "y")]
    made.write(spark.createDataFrame(new, SCHEMA).withColumn("more", F.lit(1)))
    now = set(made.read().inputFiles())
    assert kept < now and len(now - kept) == 1
    same(made.read().drop(MONTH).collect(), [r for r in given if r[2] is None or r[2].month != 3] + new)
    with pytest.raises(ValueError, match=MONTH):
        made.write(spark.createDataFrame(new, SCHEMA).withColumn(MONTH, F.lit("")))


def test_rows_are_made_behind_the_shuffle(spark, table, tmp_path):
    made, given = table
    narrow = made.read().select("origin", "destination", F.col("day").cast("string").alias("d"), "key")
    wide = lambda rows: rows.select("origin", "destination", F.to_date("d").alias("day"), "key", F.length("key").cast("double").alias("fare"), F.sha2("key", 256).alias("odd"))
    other = Lookup(spark, str(tmp_path / "others"), SCHEMA, ("origin", "destination"), "day", "key")
    how = {"made": wide, "dealt": (F.col("origin"), F.col("destination"), F.to_date("d"), F.col("key"))}
    plan = other.laid(narrow, **how)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "sha2" in above and "sha2" not in below
    other.write(narrow, **how)
    same(other.read().select(SCHEMA.names[:4]).collect(), [r[:4] for r in given])
    first, last = dt.date(2024, 2, 10), dt.date(2024, 2, 12)
    found, read = metrics(other.in_corridor(("DEL", "BOM"), first, last))
    assert len(found) == sum(r[:2] == ("DEL", "BOM") and r[2] is not None and first <= r[2] <= last for r in given) and read["numPartitions"] == 1


@pytest.mark.parametrize("name", ["corridor_lookup", "hash_lookup"])
def test_stored_quotes_shuffle_line_items(spark, tables, name, monkeypatch):
    plans = []
    laid = Lookup.laid
    monkeypatch.setattr(Lookup, "laid", lambda self, *a: plans.append(df := laid(self, *a)) or df)
    from fareloom.plans import registry

    registry.queries()[name](spark, tables)
    above, below = plans[0]._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "sha2" in above and "sha2" not in below and "route_code" not in below
