"""Vendor payloads by hand."""

import json

from pyspark.sql import functions as F

from tidemark.sources import formatters as f


def items(spark, kind, *found):
    return spark.createDataFrame([("u", kind, json.dumps(x)) for x in found], "user_id string, kind string, item string")


def values(df):
    return {r["type"]: r["value"] for r in df.collect()}


def test_garmin_dailies(spark):
    rows = f.split_webhook(spark.createDataFrame([(json.dumps({"dailies": [{"userId": "g", "calendarDate": "2025-01-02", "startTimeInSeconds": 1735776000, "steps": 10, "activeKilocalories": 888, "bmrKilocalories": 1600, "timeOffsetHeartRateSamples": [{"timestampOffsetInSeconds": 60, "heartRateInBeatsPerMinute": 70}]}]}),)], "payload string"))
    out = f.garmin(rows)
    got = values(out)
    assert got == {"dailySteps": 10, "dailyCaloriesActive": 888, "dailyCaloriesBasal": 1600, "dailyTotalCalories": 2488, "heartRates": 70}
    assert {r["time_ms"] for r in out.collect() if r["type"] == "heartRates"} == {1735776060000} and {r["user_id"] for r in out.collect()} == {"g"}


def test_garmin_sleep_and_series(spark):
    got = values(f.garmin(items(spark, "sleeps", {"calendarDate": "2025-01-02", "durationInSeconds": 27000, "awakeDurationInSeconds": 3000})))
    assert got["sleepAnalysis_InBed"] == 30_000_000 and got["sleepEfficiency"] == 90 and got["dailyAwakeTime"] == 3_000_000
    out = f.garmin(items(spark, "respiration", {"startTimeInSeconds": 100, "timeOffsetEpochToBreaths": {"0": 12.5, "60": 13}})).collect()
    assert sorted((r["time_ms"], r["value"]) for r in out) == [(100_000, 12.5), (160_000, 13.0)]


def test_whoop(spark):
    got = values(f.whoop(items(spark, "workout", {"start": "2025-01-02T10:00:00Z", "score_state": "SCORED", "score": {"kilojoule": 418.4, "zone_durations": {"zone_zero_milli": 60000, "zone_one_milli": 60000}}}, {"start": "2025-01-02T10:00:00Z", "score_state": "PENDING", "score": {"strain": 1}})))
    assert abs(got.pop("activeCalories") - 100) < 1e-9 and got == {"workoutDurationLow": 2.0}


def test_oura(spark):
    got = f.oura(items(spark, "daily_stress", {"day": "2025-01-02", "stress_high": 95})).collect()
    assert [(r["type"], r["value"], r["time_ms"]) for r in got] == [("stressHighDuration", 1.6, 1735776000000)]
    assert values(f.oura(items(spark, "daily_spo2", {"day": "2025-01-02", "spo2_percentage": {"average": 97.5}})))["oxygenSaturations"] == 97.5


def test_apple_and_ingestion(spark):
    p = {"healthData": [{"uuid": "1", "type": "SLEEP_DEEP", "dateFrom": 0, "dateTo": 60000, "timezone": "UTC"}, {"type": "HEART_RATE", "dateFrom": 5, "value": {"numericValue": 400}, "unitSymbol": "count/min"}, {"type": "NOT_KNOWN", "dateFrom": 5}]}
    records = f.apple(spark.createDataFrame([("u", json.dumps(p))], "user_id string, payload string"))
    assert values(records) == {"sleepAnalysis_Asleep(Deep)": 60000, "sleepAnalysis_Asleep(Total)": 60000, "heartRates": 400}
    got = {r["indicator"]: r["task_id"] for r in f.to_readings(records, F.current_timestamp()).collect()}
    assert got["heartRates"] == "filtered_out_of_range" and got["sleepAnalysis_Asleep(Deep)"] is None


def test_genotypes(spark):
    lines = ["# comment", "# rsid\tchromosome\tposition\tgenotype", "rs1\t1\t100\tAA", "rs2 1 200 CT", "rs3\t1\tx\tAA", ""]
    got = f.genotypes(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("rs1", "1", 100, "AA"), ("rs2", "1", 200, "CT")]


def test_ingestion_normalises_names_and_units(spark):
    rows = [("u", "Theta.X", "BLOODGLUCOSES", 0, "mmol/L", 5.5, "UTC"), ("u", "apple_health", "oxygenSaturations", 0, "%", 0.97, "UTC"), ("u", "a", "unknown", 0, "zz", 3.0, "UTC"), ("u", "a", "bodyMasss", 0, "lb", 220.462, "UTC")]
    got = {r["indicator"]: (round(r["num"], 4), r["task_id"], r["source"]) for r in f.to_readings(spark.createDataFrame(rows, "user_id string, source string, type string, time_ms long, unit string, value double, timezone string"), F.current_timestamp()).collect()}
    assert got == {"bloodGlucoses": (99.1001, None, "theta.x"), "oxygenSaturations": (97.0, None, "apple_health"), "unknown": (3.0, None, "a"), "bodyMasss": (100.0, None, "a")}


def test_apple_statistics(spark):
    p = {"statistics": [{"type": "STEPS", "grouping": "daily", "dateFrom": 1735693200000, "dateTo": 1735779599000, "timezone": "America/New_York", "sum": 9000, "average": 3.5}, {"type": "NOT_KNOWN", "grouping": "daily", "sum": 1}, {"type": "HEART_RATE", "grouping": "yearly", "average": 60}]}
    got = {r["indicator"]: (r["value"], str(r["start_time"])) for r in f.apple_statistics(spark.createDataFrame([("u", json.dumps(p))], "user_id string, payload string")).collect()}
    assert got == {"dailyTotalSteps": (9000.0, "2024-12-31 20:00:00"), "dailyAvgSteps": (3.5, "2024-12-31 20:00:00")}


def test_times_and_components(spark):
    from tidemark.functions import scalars

    cases = {"2026-03-06": "2026-03-05 16:00:00", "2026-03-06T00:00:00Z": "2026-03-05 16:00:00", "2026-03-06T10:00:00Z": "2026-03-06 10:00:00", "2026-03-06T10:00:00+02:00": "2026-03-06 08:00:00", "2026-03-06T10:00:00": "2026-03-06 10:00:00"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalars.smart_time(F.col("t"), F.lit("Asia/Shanghai")).cast("string").alias("u"))
    assert {r["t"]: r["u"] for r in got.collect()} == cases
    row = spark.range(1).select(scalars.component_base(F.lit("Glucose^2H post 75 g/L")).alias("a"), scalars.component_base(F.lit("Cells.CD3+/100 cells")).alias("b"), scalars.zone_of(F.lit(28800)).alias("z"), scalars.zone_of(F.lit(1)).alias("o")).first()
    assert (row["a"], row["b"], row["z"], row["o"]) == ("glucose", "cells", "Asia/Shanghai", "UTC")
