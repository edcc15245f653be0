"""As-of joins against plain search, with ties, gaps and a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from fareloom.operators.asof import as_of, period_or_latest
from fareloom.operators.layout import in_blocks

LEFT, RIGHT = "id long, k string, j long, t long, weight string", "k string, j long, at long, release long, weight double, note string"


def tables(spark, n=400, hot=0.4, seed=1):
    rng = random.Random(seed)
    key = lambda: ("hot", 0) if rng.random() < hot else (rng.choice("abc"), rng.randrange(2))
    left = [(i, *key(), rng.randrange(100), "own") for i in range(n)] + [(n, None, 0, 5, "x"), (n + 1, "a", None, 5, "x"), (n + 2, "hot", 0, None, "x"), (n + 3, "nobody", 0, 5, "x"), (0, "hot", 0, 50, "twice"), (0, "hot", 0, 50, "twice")]
    right = [(*key(), rng.randrange(10, 100), rng.randrange(3), float(k) if k % 5 else None, f"n{k}") for k in range(n // 4)]
    # of one key, time and release there is one row only
    right = list({r[:4]: r for r in right}.values()) + [(None, 0, 1, 0, 9.0, "null key"), ("a", 0, None, 0, 9.0, "null time")]
    return left, right, spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2)


def plain(left, right, before):
    out = []
    for i, k, j, t, own in left:
        fit = [r for r in right if None not in (k, j, t, r[0], r[2]) and r[:2] == (k, j) and (r[2] < t if before else r[2] <= t)]
        best = max(fit, key=lambda r: (r[2], r[3]), default=None)
        out.append((i, k, j, t, own, best and best[4], best and best[5]))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [1, 16, 4096])
@pytest.mark.parametrize("before", [False, True])
def test_as_of_against_plain_search(spark, rows, before):
    left, right, a, b = tables(spark)
    found = as_of(a, b, ["k", "j"], "t", "at", ["weight", "note"], ("release",), before, rows)
    assert found.columns == ["id", "k", "j", "t", "weight", "_weight", "note"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(left, right, before)


def test_as_of_with_empty_sides(spark):
    left, right, a, b = tables(spark, 20)
    assert as_of(a.limit(0), b, ["k", "j"], "t", "at", ["note"]).collect() == []
    assert {r.note for r in as_of(a, b.limit(0), ["k", "j"], "t", "at", ["note"]).collect()} == {None}


def test_a_hot_key_is_joined_by_several_tasks(spark):
    left, right, a, b = tables(spark, 4000, hot=0.9)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = as_of(a, b, ["k", "j"], "t", "at", ["note"], ("release",), rows=64).where("k = 'hot'")
        shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len(shares) > 1 and max(shares) < 0.6 * sum(shares)


def test_blocks_follow_the_order(spark):
    df = spark.createDataFrame([(k * 7919 % 500, "x") for k in range(500)], "v long, _place string")
    laid, place, block = in_blocks(df, ["v"], "test", 8)
    rows = laid.orderBy(place).collect()
    assert place == "__place" and [r.v for r in rows] == list(range(500))
    sizes = {}
    for r in rows:
        sizes[r[block]] = sizes.get(r[block], 0) + 1
    assert max(sizes.values()) <= 8


def test_period_or_latest(spark):
    asked = spark.createDataFrame([("2024-01",), ("2024-02",), (None,)], "p string")
    there = spark.createDataFrame([("2024-01", 1), ("2023-12", 2), ("2024-01", 3), (None, 4)], "p string, w int")
    assert {tuple(r) for r in period_or_latest(asked, there, "p").collect()} == {("2024-01", "2024-01"), ("2024-02", "2024-01"), (None, "2024-01")}
    assert {tuple(r) for r in period_or_latest(asked, there.limit(0), "p").collect()} == {("2024-01", None), ("2024-02", None), (None, None)}
