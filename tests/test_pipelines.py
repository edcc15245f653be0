from pyspark.sql import functions as F

from fareloom.functions import normalize, scoring
from fareloom.operators import checks
from fareloom.plans import pipelines
from fareloom.plans.fixtures import SEQUENCE, quotes


def test_daily_run(spark, tables):
    q = quotes(spark, tables)
    base = q.groupBy("route_code").agg(F.avg("total_fare").alias("base_fare"), F.count("*").alias("weight"))
    out = pipelines.daily_run(q, SEQUENCE[:4], base)
    counts = {k: v.count() for k, v in out.items()}
    assert counts["clean"] >= counts["windows"] >= counts["routes"] >= counts["national"] > 0
    empty = pipelines.daily_run(q.limit(0), SEQUENCE[:4], base)
    assert all(v.count() == 0 for v in empty.values())


def test_backtest(spark):
    months = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-12-01', interval 1 month)) AS month")
    wave = months.withColumn("value", 100 + 10 * F.sin(F.month("month")))
    shifted = months.withColumn("value", 100 + 10 * F.sin(F.month("month") - 1))
    out = pipelines.backtest(wave, shifted)
    best = out["best"].first()
    assert best.lag == 1 and abs(best.correlation - 1) < 1e-9
    assert pipelines.backtest(wave, wave)["direction"].first().agreement_pct == 100 and out["errors"].first().n == 12


def test_checks(spark):
    w = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "x", 0.9)], "m string, r string, w double")
    assert [r.m for r in checks.weights_off(w, "m", "w").collect()] == ["b"]
    assert [tuple(r) for r in checks.missing_pairs(w, "m", "r").collect()] == [("b", "y")]
    refs = [("2024-01", "see https://x", 185.2), ("2024-02", " MoSPI ", 2.0), ("2024-03", "press note", 185.2), ("2024-04", "http://y", None), ("2025-12", None, 195.8), ("2026-01", "official", 196.4), ("2026-02", "press note", 100.0)]
    ref = spark.createDataFrame(refs, "m string, s string, headline_cpi double")
    assert {r.m: r.reason for r in checks.unsound_references(ref, "m", "s").collect()} == {"2024-01": "withdrawn headline_cpi of 2024-01", "2024-02": "bare label", "2025-12": "withdrawn headline_cpi of 2025-12", "2026-01": "bare label"}
    assert checks.unsound_references(ref.where("m in ('2024-03', '2024-04', '2026-02')"), "m", "s").count() == 0
    cited = ref.where("m <= '2024-04'")
    assert checks.latest_cited(cited, "m", "s").count() == 1 and checks.latest_cited(cited.where("m < '2024-03'"), "m", "s").count() == 0


def test_places(spark):
    cities = ["Mumbai (Navi Mumbai)", "Mumbai (Mumbai)", "mumbai", "Navi Mumbai", " Calcutta ", "MADRAS", "New Delhi", "Delhi (T3)", "Atlantis", None]
    rows = spark.createDataFrame([(c,) for c in cities], "city string").select(normalize.city_code(F.col("city"))).collect()
    assert [r[0] for r in rows] == ["NMI", "BOM", "BOM", "NAVI MUMBAI", "CCU", "MAA", "NEW DELHI", "DEL", "ATLANTIS", ""]
    df = spark.createDataFrame([("del", "6e"), ("delhi", "6E1"), (None, None)], "i string, c string")
    assert [tuple(r) for r in df.select(normalize.iata(F.col("i")), normalize.carrier_code(F.col("c"))).collect()] == [("DEL", "6E"), (None, None), (None, None)]


def judge(spark, fare, mean=5000.0, deviation=500.0, lead=7, previous=None, median=None, hhi=0.42, peers=(0, None, None)):
    lit = lambda v, t="double": F.lit(v).cast(t)
    s = scoring.surge(lit(fare), lit(mean), lit(deviation), lit(lead, "int"), lit(previous), lit(median), lit(peers[0], "int"), lit(peers[1]), lit(peers[2]), lit(hhi))
    return spark.range(1).select(s.alias("s")).first().s


def test_surge_rules_by_their_published_definition(spark):
    """Expected values worked out by hand from the rules: five weighted features, four violations, three levels."""
    codes = scoring.C.VIOLATION_CODES
    calm = judge(spark, 5100.0)
    assert (calm.violation, calm.level, calm.outlier) == (None, "NORMAL", False)
    # Z = 2000 / (500 * (1 + 0.35 e^-0.7)) = 3.4077: the sigma rule; multiple 1.4, above 5000 + 2.5 * 500: an outlier
    sigma = judge(spark, 7000.0)
    assert (sigma.dz, sigma.multiple, sigma.violation, sigma.level, sigma.outlier) == (3.4077, 1.4, codes["sigma"], "CRITICAL", True)
    assert abs(sigma.score - round(0.35 * 3.4077 / 3.5 + 0.25 * 0.4 / 1.5 + 0.10 + 0.10 * 0.17 / 0.5, 4)) < 1e-9
    # the multiple overrides the sigma rule, the daily change does not
    assert judge(spark, 12500.0, previous=5000.0).violation == codes["multiple"]
    assert judge(spark, 7000.0, previous=5000.0).violation == codes["sigma"]
    day = judge(spark, 6000.0, deviation=2000.0, previous=4200.0)
    assert (day.dod, day.violation, day.level) == (0.4286, codes["dod"], "CRITICAL")
    market = judge(spark, 6500.0)  # Z 2.5558 in a concentrated market
    assert (market.dz, market.violation) == (2.5558, codes["concentration"]) and judge(spark, 6500.0, hhi=0.39).violation is None
    assert judge(spark, 6500.0, hhi=0.39).level == "WARNING" and judge(spark, 5300.0, deviation=2000.0, previous=4200.0).level == "WARNING"
    # fences of four peers and more; a lower fence of zero excludes nothing
    assert judge(spark, 5100.0, peers=(4, 4900.0, 5000.0)).outlier is False and judge(spark, 5200.0, peers=(4, 4900.0, 5000.0)).outlier is True
    assert judge(spark, 10.0, peers=(9, 1000.0, 5000.0)).outlier is False
    assert judge(spark, 5000.0, deviation=0.0).dz == 0 and judge(spark, 5001.0, deviation=0.0).dz == 999


def test_statuses_and_base_ratios(spark):
    given = ["SUCCESS", " partial ", "fallback_other", "who knows", None, "failed", " Rate_Limited", "CAPTCHA", "BANNED"]
    rows = spark.createDataFrame([(s,) for s in given], "s string").select(scoring.succeeded(F.col("s"))).collect()
    assert [r[0] for r in rows] == [True] * 5 + [False] * 4
    split = lambda c, r: scoring.fare_split(F.lit(1000.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(c), F.lit(r))
    pairs = [("AI", "DEL-BOM"), ("SG", "BLR-HYD"), ("zz", "DEL-BOM"), ("SG", "X-Y"), ("ZZ", "X-Y"), ("AI", "DEL-BLR")]
    row = spark.range(1).select(*(split(c, r).alias(f"c{k}") for k, (c, r) in enumerate(pairs))).first()
    assert [(s.base, s.taxes, s.basis) for s in row] == [(810.0, 190.0, "calibrated"), (680.0, 320.0, "calibrated"), (780.0, 220.0, "calibrated"), (740.0, 260.0, "calibrated"), (780.0, 220.0, "estimated"), (840.0, 160.0, "calibrated")]


def test_batch_evaluation_by_its_published_definition(spark):
    """Worked out by hand: a fare 40 % above the previous one, defaults for a key without a baseline, lead days by digits."""
    from fareloom.operators.anomaly import alerts, batch_lead_days, judged_quotes

    lead = spark.createDataFrame([("T+1",), ("T+7",), ("T+15",), ("T+30",), ("T+45",), (None,)], "w string").select(batch_lead_days(F.col("w")))
    assert [r[0] for r in lead.collect()] == [1, 7, 1, 30, 7, 7]
    base = spark.createDataFrame([("R", "T+7", 6000.0, 2000.0, 5000.0)], "r string, w string, mean double, deviation double, previous double")
    quotes = spark.createDataFrame([("R", "T+7", 7000.0), ("R", "T+7", 6990.0), ("X", "T+7", 7000.0), ("X", "T+7", 5100.0), ("R", "T+1", 12500.0)], "r string, w string, f double")
    codes = scoring.C.VIOLATION_CODES
    got = {(r.r, r.w, r.f): (r.surge.dod, r.surge.violation, r.surge.level) for r in judged_quotes(quotes, base, ["r", "w"], "w", "f").collect()}
    # R: Z = 1000 / (2000 * 1.1738) is small, the change to 7000 is 0.4 exactly, to 6990 0.398; X: default baseline, 0.4 again and Z = 3.4077
    assert got[("R", "T+7", 7000.0)] == (0.4, codes["dod"], "CRITICAL") and got[("R", "T+7", 6990.0)] == (0.398, None, "WARNING")
    assert got[("X", "T+7", 7000.0)] == (0.4, codes["sigma"], "CRITICAL") and got[("X", "T+7", 5100.0)] == (0.02, None, "NORMAL")
    assert got[("R", "T+1", 12500.0)] == (1.5, codes["multiple"], "CRITICAL")
    days = spark.createDataFrame([(1, 100.0, None, None, 50.0), (2, 100.0, None, None, None), (3, 100.0, 100.0, 0.0, 0.0), (4, 100.0, 60.0, 10.0, 90.0), (5, 100.0, 88.0, 5.0, 95.0)], "id int, fare double, mean double, deviation double, previous double")
    raised = {r.id: (r.severity, r.kind) for r in alerts(days.withColumn("lead", F.lit(7)), "fare", "lead").collect()}
    # 5: Z is 2.4, dynamic Z 2.0447
    assert raised == {1: ("CRITICAL", "SURGE_PRICING"), 4: ("CRITICAL", "DGCA_STATUTORY_VIOLATION"), 5: ("HIGH", "SPIKE")}
