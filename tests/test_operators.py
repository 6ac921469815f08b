"""Behaviour of the engine's operators on rows made by hand."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import registry, scalars
from tidemark.operators import clinical, daily, derived, graph, insight, mapping, quality
from tidemark.streaming import incremental

READ = "user_id string, indicator string, source string, time timestamp, num decimal(14,2), timezone string, task_id string, event_id long, update_time timestamp"


def ts(text):
    return dt.datetime.fromisoformat(text)


def readings(spark, rows, zone="UTC"):
    return spark.createDataFrame([("u", i, "apple_health", ts(t), __import__("decimal").Decimal(str(v)), zone, tag, n, ts(t)) for n, (i, t, v, tag) in enumerate(rows)], READ)


def day_values(df, method="total"):
    return {(str(r["day"]), r["indicator"]): r[method] for r in daily.aggregate(df, [method]).collect()}


def test_day_borders(spark):
    df = readings(spark, [("steps", "2025-01-01 23:59:59", 999, None), ("steps", "2025-01-02 00:00:00", 1000, None), ("steps", "2025-01-02 00:00:01", 1001, None), ("steps", "2025-01-02 12:00:00", 5, "filtered_out_of_range")])
    assert day_values(df)["2025-01-02", "steps"] == 2001


def test_sleep_days_run_from_evening(spark):
    df = readings(spark, [("sleepX", f"2025-01-0{d} {t}", 1000, None) for d, t in ((1, "17:59:59"), (1, "18:00:00"), (1, "22:00:00"), (2, "00:00:00"), (2, "06:00:00"))])
    assert day_values(df)["2025-01-01", "sleepX"] == 4000


def test_days_across_a_clock_change(spark):
    df = readings(spark, [("steps", t, 1, None) for t in ("2025-03-30 00:30:00", "2025-03-30 21:59:59", "2025-03-30 22:00:00")], "Europe/Berlin")
    assert {k[0]: v for k, v in day_values(df).items()} == {"2025-03-30": 2, "2025-03-31": 1}


def test_range_shares_add_up(spark):
    df = readings(spark, [("bloodGlucoses", f"2025-01-01 {h:02}:00:00", v, None) for h, v in enumerate([60, 70, 100, 180, 181, 300, 65])])
    r = daily.aggregate(df, ["pct_below_70", "tir_70_180", "pct_above_180"]).first()
    assert abs(r["pct_below_70"] + r["tir_70_180"] + r["pct_above_180"] - 100) < 0.1


def test_hypo_events(spark):
    rows = [("2025-01-01 01:00:00", 100), ("2025-01-01 01:05:00", 65), ("2025-01-01 01:15:00", 60), ("2025-01-01 01:25:00", 62), ("2025-01-01 01:30:00", 90), ("2025-01-01 03:00:00", 60), ("2025-01-01 05:00:00", 60), ("2025-01-01 05:20:00", 10)]
    df = readings(spark, [("bloodGlucoses", t, v, None) for t, v in rows])
    assert [(r["at_time"], r["minutes"]) for r in clinical.hypo_events(df).collect()] == [("01:05", 20)]
    assert [(r["event_count"], r["event_times"]) for r in clinical.hypo_summary(df).collect()] == [(1, "01:05")]


def test_hypo_summary_without_events(spark):
    df = readings(spark, [("bloodGlucoses", "2025-01-01 01:00:00", 100, None)])
    assert [(r["event_count"], r["event_times"]) for r in clinical.hypo_summary(df).collect()] == [(0, "")]


def test_gmi_passes_over_close_readings(spark):
    base = ts("2025-01-01 00:00:00")
    times = [base + dt.timedelta(minutes=5 * i) for i in range(200)] + [base + dt.timedelta(minutes=5 * i, seconds=20) for i in range(200)]
    df = readings(spark, [("bloodGlucoses", str(t), 120, None) for t in times])
    r = clinical.gmi(df, coverage=0.01).first()
    assert (r["kept"], r["interval"], r["gmi"]) == (200, 5, round(3.31 + 0.02392 * 120, 2))
    assert clinical.gmi(df, coverage=0.7).first()["gmi"] is None


def test_names_and_thresholds():
    assert registry.target("time_of_max", "bloodGlucoses") == "dailyTimeOfMaxBloodGlucoses"
    assert registry.target("gmi_14d", "bloodGlucoses") == "dailyGmi14dBloodGlucoses"
    assert registry.threshold("pct_below_3.9") == ("below", 3.9, None) and registry.threshold("avg") is None
    assert registry.output_unit("tir_70_180", "mg/dL") == "%"
    assert len({t for _, _, t, _ in registry.rules()}) == len(registry.rules())


def test_unit_round_trips():
    pairs = {(a, b): f for a, b, f in scalars.unit_pairs()}
    assert all(abs(f * pairs[b, a] - 1) < 1e-9 for (a, b), f in pairs.items() if (b, a) in pairs and {a, b} & {"kg", "m", "mmHg"})
    assert pairs["lb", "g"] == 1000 / 2.20462


def test_temperature_and_times(spark):
    row = spark.range(1).select(scalars.temperature(F.lit(98.6), F.lit("degF"), F.lit("°C")).alias("c"), scalars.vendor_time(F.lit("1700000000")).alias("s"), scalars.vendor_time(F.lit("1700000000000")).alias("ms"), scalars.vendor_time(F.lit("2023-11-14T22:13:20Z")).alias("iso"), scalars.vendor_time(F.lit("what")).alias("bad"), scalars.age(F.lit("2000-03-02").cast("date"), F.lit("2024-03-01").cast("date")).alias("age")).first()
    assert abs(row["c"] - 37) < 1e-9 and row["s"] == row["ms"] == row["iso"] and row["bad"] is None and row["age"] == 23


def test_derived_needs_all_inputs(spark):
    rows = [("u", dt.date(2025, 1, 1), "dailyTotalSteps", "apple_health", 1000.0), ("u", dt.date(2025, 1, 1), "dailyTotalWalkingRunningDistances", "vital.garmin", 812.0), ("u", dt.date(2025, 1, 1), "dailyTotalSteps", "other", 9.0), ("u", dt.date(2025, 1, 2), "dailyTotalSteps", "other", 9.0)]
    got = derived.derive(spark.createDataFrame(rows, "user_id string, day date, target string, source string, value double")).collect()
    assert [(r["indicator"], r["value"]) for r in got] == [("derivedStepEfficiency", 0.81)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "b", 2), (3, "c", 2), (3, "d", 3)], "k int, v string, t int")
    once = mapping.upsert(old, new, ["k"], ["v"], order="t", stamp="t")
    rows = sorted(map(tuple, once.collect()))
    assert rows == [(1, "a", 1), (2, "b", 1), (3, "d", 3)]
    assert sorted(map(tuple, mapping.upsert(once, new, ["k"], ["v"], order="t", stamp="t").collect())) == rows


def test_baseline_freezes_and_thaws(spark):
    base = dt.date(2025, 1, 1)
    series = [10, 12, 10, 12, 10, 12, 10] + [100, 100, 100] + [11] * 6
    def run(values):
        rows = [("u", "c", base + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
        return insight.baselines(spark.createDataFrame(rows, "user_id string, category string, day date, value double")).first()
    assert run(series)["frozen"] and not run(series + [11])["frozen"]


def test_runs(spark):
    rows = [("u", "c", dt.date(2025, 1, d), 1.0, z) for d, z in ((1, 3.0), (2, 2.5), (3, 0.0), (5, 2.0), (6, 9.0), (7, 2.2))]
    dev = spark.createDataFrame(rows, "user_id string, category string, day date, value double, z double")
    assert sorted(r["length"] for r in insight.runs(dev, 2.0).collect()) == [2, 3]


def test_taxonomy_labels(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("d", "c")], "node string, parent string")
    labels = spark.createDataFrame([("b", "near"), ("c", "far")], "node string, label string")
    got = {r["node"]: r["label"] for r in graph.assigned(graph.ancestors(spark, tree), labels).collect()}
    assert got == {"a": "near", "b": "far", "d": "far"}


def test_extreme_value_flags(spark):
    r = spark.range(1).select(quality.flags(F.lit(0.0), F.lit(1000.0), F.lit(10.0), F.lit(1.0)).alias("f"), quality.flags(F.lit(0.0), F.lit(20.0), F.lit(10.0), F.lit(0.0)).alias("g")).first()
    assert r["f"] == ["suspicious_max"] and r["g"] == []


def test_stream_recomputes_late_days(spark, tmp_path):
    kept, made = incremental.tables(spark, str(tmp_path / "tables"))
    landing = str(tmp_path / "in")

    def feed(rows):
        readings(spark, rows).drop("event_id").coalesce(1).write.mode("append").parquet(landing)
        incremental.start(spark.readStream.schema(incremental.READINGS).parquet(landing), kept, made, str(tmp_path / "cp")).awaitTermination(120)
        return {(r["indicator"], str(r["start_time"])): r["value"] for r in made.rows().collect()}

    first = ("dailyTotalSteps.apple_health", "2025-01-01 00:00:00")
    assert feed([("steps", "2025-01-01 10:00:00", 5, None)]) == {first: 5.0}
    assert feed([("steps", "2025-01-02 10:00:00", 7, None), ("steps", "2025-01-01 09:00:00", 2, None)]) == {first: 7.0, (first[0], "2025-01-02 00:00:00"): 7.0}
    # a day whose readings are all filtered afterwards has no summary left
    assert feed([("steps", "2025-01-02 10:00:00", 7, "filtered_out_of_range")]) == {first: 7.0}
    assert kept.rows().count() == 3


def test_taxonomy_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(150)] + [("x", "y"), ("y", "x")]
    found = graph.ancestors(spark, spark.createDataFrame(chain, "node string, parent string"))
    by = {(r["node"], r["ancestor"]): r["depth"] for r in found.collect()}
    assert len(by) == 150 * 151 // 2 + 2 and by["n0", "n150"] == 150 and by["x", "y"] == 1
    assert graph.descendants(found, spark.createDataFrame([("n150",)], "node string")).count() == 150


def test_upsert_fills_nulls(spark):
    old = spark.createDataFrame([(1, 1, 7), (2, 1, None)], "k int, v int, code int")
    new = spark.createDataFrame([(1, 2, None), (2, 2, 9), (3, 2, None)], "k int, v int, code int")
    assert sorted(map(tuple, mapping.upsert(old, new, ["k"], ["v", "code"], filled=["code"]).collect())) == [(1, 2, 7), (2, 2, 9), (3, 2, None)]


def test_older_names_of_inputs_come_first(spark):
    rows = [("u", dt.date(2025, 1, 1), t, "vital.garmin", v) for t, v in (("dailyMaxHeartRates", 150.0), ("daily_stats_heartRatesMax", 140.0), ("dailyMinHeartRates", 50.0))]
    got = derived.derive(spark.createDataFrame(rows, "user_id string, day date, target string, source string, value double")).collect()
    assert {(r["indicator"], r["value"]) for r in got} == {("derivedHrRange", 90.0)}


def test_derived_formulas(spark):
    """Every second-level rule by hand."""
    day = {"dailyTotalSleepAnalysis_Asleep(Total)": 400.0, "dailyTotalSleepAnalysis_InBed": 500.0, "dailyTotalSleepAnalysis_Asleep(Deep)": 100.0, "dailyTotalSleepAnalysis_Asleep(REM)": 80.0, "dailyTotalSleepAnalysis_Asleep(Core)": 220.0, "dailyTotalSleepAnalysis_Awake": 100.0, "dailyMaxHeartRates": 150.0, "dailyMinHeartRates": 50.0, "dailyAvgRestingHeartRates": 60.0, "dailyAvgWalkingHeartRates": 95.0, "dailyTotalWalkingRunningDistances": 5000.0, "dailyTotalSteps": 8000.0, "dailyTotalExerciseMinutes": 72.0, "dailyStddevBloodGlucoses": 20.0, "dailyAvgBloodGlucoses": 100.0}
    rows = [("u", dt.date(2025, 1, 1), t, "vital.garmin", v) for t, v in day.items()]
    got = {r["indicator"]: r["value"] for r in derived.derive(spark.createDataFrame(rows, "user_id string, day date, target string, source string, value double")).collect()}
    assert got == {"derivedSleepEfficiency": 80.0, "derivedDeepSleepRatio": 25.0, "derivedRemSleepRatio": 20.0, "derivedLightSleepRatio": 55.0, "derivedAwakeRatio": 20.0, "derivedHrRange": 100.0, "derivedHrReserve": 90.0, "derivedWalkingHrElevation": 35.0, "derivedStepEfficiency": 0.63, "derivedActivityMinutesRatio": 5.0, "derivedBloodGlucoseCV": 20.0}


def test_hypo_details(spark):
    rows = [("2025-01-01 01:00:00", 65), ("2025-01-01 01:20:00", 60), ("2025-01-01 02:00:00", 90), ("2025-01-02 02:00:00", 90)]
    df = readings(spark, [("bloodGlucoses", t, v, None) for t, v in rows])
    assert [r["details"] for r in clinical.hypo_details(df).orderBy("day").collect()] == ['[{"start":"01:00","minutes":20,"nadir":60.0}]', "[]"]
    named = {(r["indicator"], str(r["day"])): r["value"] for r in clinical.special_summaries(df).collect()}
    assert named["dailyHypoEventCountBloodGlucoses.apple_health", "2025-01-01"] == "1" and named["dailyTimeOfMaxBloodGlucoses.apple_health", "2025-01-01"] == "02:00"
