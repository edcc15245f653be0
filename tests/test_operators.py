"""Invariants of the operators on frames made by hand."""

import math

import pytest
from pyspark.sql import functions as F

from fareloom.functions import normalize, scoring
from fareloom.operators import anomaly, index, series, store, telemetry


def basket(spark, rows):
    df = spark.createDataFrame(rows, "period string, unit string, p double, q long, p0 double, q0 long")
    return {r.period: r for r in index.index_numbers(df, "period", "p", "q", "p0", "q0").collect()}


ROWS = [("A-B", 5000.0, 40, 4800.0, 50), ("B-C", 3600.0, 70, 3500.0, 60), ("C-D", 7200.0, 20, 6100.0, 30)]


def test_base_identity_and_scaling(spark):
    same = basket(spark, [("x", u, p0, q0, p0, q0) for u, _, _, p0, q0 in ROWS])["x"]
    assert all(math.isclose(v, 100) for v in (same.laspeyres, same.laspeyres_true, same.paasche, same.fisher))
    scaled = basket(spark, [(str(a), u, a * p0, q, p0, q0) for a in (0.85, 1.1, 1.2, 1.5) for u, _, q, p0, q0 in ROWS])
    assert all(math.isclose(r.fisher, 100 * float(k)) for k, r in scaled.items())


def test_fisher_bounds_and_factor_reversal(spark):
    r = basket(spark, [("x", u, p, q, p0, q0) for u, p, q, p0, q0 in ROWS])["x"]
    assert min(r.laspeyres, r.paasche) <= r.fisher <= max(r.laspeyres, r.paasche)
    price = math.sqrt(r.laspeyres_true * r.paasche) / 100
    swapped = basket(spark, [("x", u, float(q), int(p), float(q0), int(p0)) for u, p, q, p0, q0 in ROWS])["x"]
    quantity = math.sqrt(swapped.laspeyres_true * swapped.paasche) / 100
    value = sum(p * q for _, p, q, _, _ in ROWS) / sum(p0 * q0 for _, _, _, p0, q0 in ROWS)
    assert math.isclose(price * quantity, value, rel_tol=1e-12)


@pytest.mark.parametrize("weights, expected", [((0.5, 0.5), 5000.0), ((0.51, 0.49), 4000.0), ((0.49, 0.51), 6000.0)])
def test_weighted_median_halves(spark, weights, expected):
    for rows in ([(4000.0, weights[0]), (6000.0, weights[1])], [(6000.0, weights[1]), (4000.0, weights[0])]):
        df = spark.createDataFrame([("g", v, w, k) for k, (v, w) in enumerate(rows)], "g string, v double, w double, k int")
        assert index.weighted_median(df, ["g"], "v", "w").first().fare == expected


def test_tukey_needs_four_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 900.0)] + [("b", float(x)) for x in (10, 11, 12, 13, 14, 500)], "g string, v double")
    kept = sorted(r.v for r in index.tukey_inside(df, ["g"], "v").collect())
    assert kept == [1.0, 2.0, 10.0, 11.0, 12.0, 13.0, 14.0, 900.0]
    bounds = {r.g: r for r in index.tukey_bounds(df, ["g"], "v").collect()}
    assert (bounds["a"].lower, bounds["a"].upper) == (1.0, 900.0)


def test_leave_one_out_flags_what_the_others_exclude(spark):
    values = [100.0, 101.0, 102.0, 103.0, 104.0, 400.0]
    df = spark.createDataFrame([("g", v, k) for k, v in enumerate(values)] + [("small", 1.0, 7), ("small", 9e9, 8)], "g string, v double, k int")
    flagged = {(r.g, r.v) for r in index.leave_one_out_outliers(df, ["g"], "v", ["k"]).where("outlier").collect()}
    assert flagged == {("g", 400.0)}


def test_leave_one_out_of_a_hot_group_runs_in_several_tasks(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), float(rng.randrange(60)) if rng.random() < 0.98 else 900.0, k, "x") for k in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double, k int, _rank string").repartition(5)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "0"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        flagged = index.leave_one_out_outliers(df, ["g"], "v", ["k"], rows=64)
        assert flagged.columns == ["g", "v", "k", "_rank", "outlier"]
        got = {r.k: r.outlier for r in flagged.collect()}
        plan = flagged._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert plan.count("SortMergeJoin(skew=true)") >= 2 and "Window" not in plan, plan  # the hot group's rows were dealt to several tasks

    def quantile(values, p):
        at = p * (len(values) - 1)
        low = int(at)
        return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    for g in ("hot", "b", None):
        own = sorted((v, k) for h, v, k, _ in rows if h == g)
        for n, (v, k) in enumerate(own):
            others = [x for m, (x, _) in enumerate(own) if m != n]
            q1, q3 = quantile(others, 0.25), quantile(others, 0.75)
            assert got[k] == (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))


def test_exclusion_precedence_and_recomposition(spark):
    df = spark.range(1)
    lit = F.lit
    reason = lambda s, ok, out: scoring.exclusion(lit(s).cast("string"), lit(ok), lit(out))
    row = df.select(reason("cancelled", False, True).alias("a"), reason("sold_out", False, True).alias("b"), reason(None, False, True).alias("c"), reason(None, True, True).alias("d"), reason(None, True, False).alias("e")).first()
    assert tuple(row) == ("cancelled", "sold_out", "split_recomposition_mismatch", "outlier", None)
    ok = lambda t, b, x: scoring.recomposes(lit(t), lit(b).cast("double"), lit(x).cast("double"))
    row = df.select(ok(150.0, 100.0, 49.0).alias("a"), ok(150.0, 100.0, 48.9).alias("b"), ok(150.0, None, None).alias("c")).first()
    assert tuple(row) == (True, False, True)


def test_z_score_without_deviation(spark):
    z = lambda v: scoring.z_score(F.lit(v), F.lit(5.0), F.lit(0.0))
    assert tuple(spark.range(1).select(z(5.0).alias("a"), z(6.0).alias("b"), z(4.0).alias("c")).first()) == (0.0, 999.0, -999.0)


def test_rolling_days_window(spark):
    df = spark.createDataFrame([("g", "2024-01-01", 10.0), ("g", "2024-01-31", 20.0), ("g", "2024-02-01", 30.0)], "g string, d string, v double").withColumn("d", F.to_date("d"))
    got = {str(r.d): (r.n_base, r.mean, r.deviation) for r in anomaly.rolling_days(df, ["g"], "d", "v", 30).collect()}
    assert got == {"2024-01-01": (0, None, None), "2024-01-31": (1, 10.0, 0.0), "2024-02-01": (1, 20.0, 0.0)}


def test_iso_weeks_across_a_year_end(spark):
    days = spark.sql("SELECT explode(sequence(date'2026-12-01', date'2027-01-29')) AS d")
    weeks = days.groupBy(series.iso_week(F.col("d")).alias("w")).count().collect()
    assert sum(r["count"] for r in weeks) == 60 and {r.w for r in weeks} >= {"2026-W53", "2027-W01"}


def test_interpolation_is_level_beyond_the_anchors(spark):
    to = lambda df: df.withColumn("d", F.to_date("d"))
    days = to(spark.createDataFrame([("2024-01-01",), ("2024-01-10",), ("2024-01-15",), ("2024-01-20",), ("2024-02-09",)], "d string"))
    anchors = to(spark.createDataFrame([("2024-01-10", 100.0), ("2024-01-20", 200.0)], "d string, v double"))
    got = [r.v for r in series.interpolated(days, "d", anchors, "d", "v").orderBy("d").collect()]
    assert got == [100.0, 100.0, 150.0, 200.0, 200.0]


def test_ranked_percentile_is_not_interpolated(spark):
    df = spark.createDataFrame([("g", float(k)) for k in range(1, 21)] + [("g", None), ("one", 7.0)], "g string, v double")
    got = {r.g: (r.lower, r.upper) for r in telemetry.ranked_percentiles(df, ["g"], "v", 0.95).collect()}
    assert got == {"g": (19.0, 20.0), "one": (7.0, 7.0)}


def test_runs_and_scores_over_many_days(spark):
    """Runs that go over days with and without a success, and the score step by step, against plain loops."""
    import random

    rng = random.Random(4)
    rows = []
    for unit in ("a", "b", "c"):
        for k in range(60):
            day, hour = rng.randrange(1, 10), rng.randrange(24)
            rows.append((unit, f"2024-01-{day:02d} {hour:02d}:00:00", len(rows), float(rng.randrange(100)), rng.random() < (0.15 if unit == "a" else 0.5)))
    df = spark.createDataFrame(rows, "unit string, t string, k int, v double, ok boolean").withColumn("t", F.to_timestamp("t"))
    runs, scores = {}, {}
    for unit, _, k, v, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        runs[k] = 0 if ok else runs.get((unit, "last"), 0) + 1
        runs[unit, "last"] = runs[k]
        s = scores.get(unit, v)
        scores[unit] = 0.3 * v + 0.7 * s if ok else s + 1000
    got = telemetry.failure_runs(df, "unit", ["t", "k"], F.col("ok"))
    assert {r.k: r.run for r in got.collect()} == {k: n for k, n in runs.items() if isinstance(k, int)}
    assert set(got.columns) == {*df.columns, "run"}
    for r in telemetry.ewma(df, "unit", ["t", "k"], "v", F.col("ok")).collect():
        assert math.isclose(r.score, scores[r.unit])


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "k string, v int, s boolean")
    source = spark.createDataFrame([("a", 10, False), ("b", 20, False), ("c", 30, False)], "k string, v int, s boolean")
    once = store.upsert(target, source, ["k"], when=F.col("s"))
    assert sorted(map(tuple, once.collect())) == [("a", 10, False), ("b", 2, False), ("c", 30, False)]
    assert sorted(store.upsert(once, source, ["k"], when=F.col("s")).collect()) == sorted(once.collect())
    assert sorted(r.k for r in store.replace_by_key(target, source.limit(1), ["k"]).collect()) == ["a", "b"]


def test_normalizers(spark):
    df = spark.createDataFrame([(" 6e-123 ", "6e", "T9:05", "Cancelled ", "₹ 4,500.456", "t30", "1700000000")], "n string, c string, t string, s string, f string, w string, ts string")
    row = df.select(
        normalize.flight_number(F.col("n"), F.col("c")).alias("n"),
        normalize.departure_time(F.col("t")).alias("t"),
        normalize.status(F.col("s")).alias("s"),
        normalize.fare(F.col("f")).alias("f"),
        normalize.booking_window(F.col("w")).alias("w"),
        F.unix_timestamp(normalize.timestamp(F.col("ts"))).alias("ts"),
        normalize.route_pair(F.lit("del-bom")).alias("r"),
        normalize.route_pair(F.lit("del")).alias("none"),
    ).first()
    assert tuple(row)[:6] == ("6E123", "09:05", "cancelled", 4500.46, "T+30", 1700000000) and tuple(row.r) == ("DEL", "BOM") and row.none is None


def test_empty_input_gives_empty_output(spark):
    none = spark.createDataFrame([], "g string, v double, w double, k int, d date")
    assert index.tukey_bounds(none, ["g"], "v").count() == 0
    assert index.weighted_median(none, ["g"], "v", "w").count() == 0
    assert index.leave_one_out_outliers(none, ["g"], "v", ["k"]).count() == 0
    assert anomaly.rolling_days(none, ["g"], "d", "v", 30).count() == 0
    assert series.best_lag(series.lagged_correlation(none, "d", "v", "w", 2)).count() == 0
