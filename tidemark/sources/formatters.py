"""Vendor payloads to long records: one JSON string a row in, one reading a row out, all by column expressions.

A mapping row is (path of the value, indicator, unit, factor). Paths that hold nothing give no record. Records
are (user_id, source, type, time_ms, unit, value, timezone), the shape that ingestion goes on from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mapping = tuple[str, str, str, float]
#: The fields of each vendor's payloads.
GARMIN: dict[str, list[Mapping]] = {
    "dailies": [("steps", "dailySteps", "count", 1), ("distanceInMeters", "dailyDistance", "m", 1), ("activeKilocalories", "dailyCaloriesActive", "kcal", 1), ("bmrKilocalories", "dailyCaloriesBasal", "kcal", 1), ("floorsClimbed", "dailyFloorsClimbed", "count", 1), ("activeTimeInSeconds", "activeTime", "min", 1 / 60), ("moderateIntensityDurationInSeconds", "dailyActivityIntensityMedium", "min", 1 / 60), ("vigorousIntensityDurationInSeconds", "dailyActivityIntensityHigh", "min", 1 / 60), ("minHeartRateInBeatsPerMinute", "dailyHeartRateMin", "bpm", 1), ("maxHeartRateInBeatsPerMinute", "dailyHeartRateMax", "bpm", 1), ("averageHeartRateInBeatsPerMinute", "dailyAvgHeartRate", "count/min", 1), ("restingHeartRateInBeatsPerMinute", "dailyHeartRateResting", "count/min", 1)],
    "sleeps": [("awakeDurationInSeconds", "dailyAwakeTime", "ms", 1000), ("deepSleepDurationInSeconds", "dailyDeepSleep", "ms", 1000), ("lightSleepDurationInSeconds", "dailyLightSleep", "ms", 1000), ("remSleepInSeconds", "dailyRemSleep", "ms", 1000)],
    "stress": [("overallStressLevel", "stressLevel", "%", 1)],
    "bodyComps": [("weight", "bodyMasss", "kg", 1), ("bodyMassIndex", "bmis", "count", 1), ("bodyFatPercentage", "bodyFatPercentages", "%", 1), ("bodyWaterPercentage", "bodyWaterPercentage", "%", 1), ("boneMass", "boneMass", "kg", 1), ("muscleMass", "musclePercentage", "%", 1)],
    "userMetrics": [("vo2Max", "vo2Maxs", "L/min/kg", 1)], "pulseOx": [("singleReadingSpO2", "oxygenSaturations", "%", 1)],
    "bloodPressures": [("systolicPressure", "systolicPressures", "mmHg", 1), ("diastolicPressure", "diastolicPressures", "mmHg", 1)], "skinTemp": [("nightlyValue", "skinTemperature", "°C", 1)],
    "activities": [("averageHeartRateInBeatsPerMinute", "heartRates", "count/min", 1), ("maxHeartRateInBeatsPerMinute", "heartRateMax", "count/min", 1), ("calories", "activeCalories", "kcal", 1), ("bmrCalories", "basalCalories", "kcal", 1), ("steps", "steps", "count", 1), ("distanceInMeters", "walkingRunningDistances", "m", 1), ("durationInSeconds", "workoutDuration", "min", 1 / 60), ("elevationGainInMeters", "altitudeGain", "m", 1), ("averageSpeedInMetersPerSecond", "speed", "m/s", 1), ("activityTrainingLoad", "trainingLoad", "score", 1)],
}
#: Kinds of items whose readings are maps of second offsets, with their indicator and unit.
GARMIN_SERIES = {"hrv": ("hrvValues", "hrvDatas", "ms"), "respiration": ("timeOffsetEpochToBreaths", "respiratoryRates", "count/min")}
WHOOP: dict[str, list[Mapping]] = {
    "sleep": [("score.stage_summary.total_in_bed_time_milli", "sleepAnalysis_InBed", "ms", 1), ("score.stage_summary.total_awake_time_milli", "sleepAnalysis_Awake", "ms", 1), ("score.stage_summary.total_light_sleep_time_milli", "sleepAnalysis_Asleep(Core)", "ms", 1), ("score.stage_summary.total_slow_wave_sleep_time_milli", "sleepAnalysis_Asleep(Deep)", "ms", 1), ("score.stage_summary.total_rem_sleep_time_milli", "sleepAnalysis_Asleep(REM)", "ms", 1), ("score.sleep_efficiency_percentage", "sleepEfficiency", "%", 1), ("score.respiratory_rate", "respiratoryRates", "count/min", 1), ("score.sleep_performance_percentage", "sleepPerformance", "%", 1), ("score.sleep_consistency_percentage", "sleepConsistency", "%", 1), ("score.stage_summary.disturbance_count", "sleepDisturbances", "count", 1)],
    "cycle": [("score.average_heart_rate", "heartRates", "count/min", 1), ("score.max_heart_rate", "heartRateMax", "count/min", 1), ("score.kilojoule", "activeCalories", "kcal", 1 / 4.184), ("score.strain", "strain", "score", 1)],
    "recovery": [("score.resting_heart_rate", "restingHeartRates", "count/min", 1), ("score.hrv_rmssd_milli", "hrvRMSSD", "ms", 1), ("score.spo2_percentage", "oxygenSaturations", "%", 1), ("score.recovery_score", "recoveryScore", "score", 1), ("score.skin_temp_celsius", "skinTemperature", "°C", 1)],
    "workout": [("score.average_heart_rate", "heartRates", "count/min", 1), ("score.max_heart_rate", "heartRateMax", "count/min", 1), ("score.distance_meter", "walkingRunningDistances", "m", 1), ("score.kilojoule", "activeCalories", "kcal", 1 / 4.184), ("score.altitude_gain_meter", "altitudeGain", "m", 1), ("score.altitude_change_meter", "altitudeChange", "m", 1)],
    "body": [("height_meter", "height", "m", 1), ("weight_kilogram", "bodyMasss", "kg", 1), ("max_heart_rate", "maxHeartRateProfile", "count/min", 1)],
}
OURA: dict[str, list[Mapping]] = {
    "sleep": [("total_sleep_duration", "dailyTotalSleepTime", "s", 1), ("time_in_bed", "sleepAnalysis_InBed", "s", 1), ("awake_time", "sleepAnalysis_Awake", "s", 1), ("deep_sleep_duration", "sleepAnalysis_Asleep(Deep)", "s", 1), ("light_sleep_duration", "sleepAnalysis_Asleep(Core)", "s", 1), ("rem_sleep_duration", "sleepAnalysis_Asleep(REM)", "s", 1), ("efficiency", "sleepEfficiency", "%", 1), ("latency", "sleepLatency", "s", 1), ("average_heart_rate", "dailyHeartRateAvg", "count/min", 1), ("lowest_heart_rate", "dailyHeartRateMin", "count/min", 1), ("average_hrv", "hrvRMSSD", "ms", 1), ("average_breath", "respiratoryRates", "count/min", 1), ("restless_periods", "sleepDisturbances", "count", 1), ("temperature_delta", "temperatureDelta", "°C", 1)],
    "daily_sleep": [("score", "sleepOverallScore", "score", 1)],
    "daily_activity": [("steps", "dailySteps", "count", 1), ("active_calories", "dailyCaloriesActive", "kcal", 1), ("total_calories", "dailyCaloriesTotal", "kcal", 1), ("equivalent_walking_distance", "dailyDistance", "m", 1), ("high_activity_time", "dailyActivityIntensityHigh", "s", 1), ("medium_activity_time", "dailyActivityIntensityMedium", "s", 1), ("low_activity_time", "dailyActivityIntensityLow", "s", 1), ("sedentary_time", "sedentaryTime", "s", 1), ("resting_time", "restingTime", "s", 1), ("score", "dailyActivityScore", "score", 1)],
    "daily_readiness": [("score", "recoveryScore", "score", 1), ("temperature_deviation", "temperatureDelta", "°C", 1)], "heartrate": [("bpm", "heartRates", "count/min", 1)], "daily_spo2": [("spo2_percentage.average", "oxygenSaturations", "%", 1)],
    "daily_stress": [("stress_high", "stressHighDuration", "min", 1 / 60), ("recovery_high", "recoveryHighDuration", "min", 1 / 60)], "vo2_max": [("vo2_max", "vo2Maxs", "mL/kg/min", 1)], "daily_cardiovascular_age": [("vascular_age", "bodyAge", "year", 1)],
    "workout": [("calories", "activeCalories", "kcal", 1), ("distance", "walkingRunningDistances", "m", 1)], "personal_info": [("weight", "bodyMasss", "kg", 1), ("height", "height", "m", 1)],
}
APPLE = {"HEART_RATE": "heartRates", "RESPIRATORY_RATE": "respiratoryRates", "BODY_TEMPERATURE": "bodyTemperatures", "BLOOD_GLUCOSE": "bloodGlucoses", "BLOOD_OXYGEN": "oxygenSaturations", "BLOOD_PRESSURE_SYSTOLIC": "systolicPressures", "BLOOD_PRESSURE_DIASTOLIC": "diastolicPressures", "WALKING_HEART_RATE": "walkingHeartRates", "RESTING_HEART_RATE": "restingHeartRates", "HEART_RATE_VARIABILITY_SDNN": "hrvDatas", "STEPS": "steps", "WALKING_SPEED": "walkingSpeeds", "FLIGHTS_CLIMBED": "floors", "DISTANCE_WALKING_RUNNING": "walkingRunningDistances", "EXERCISE_TIME": "exerciseMinutes", "DISTANCE_CYCLING": "cyclingDistances", "VO2_MAX": "vo2Maxs", "WEIGHT": "bodyMasss", "BODY_FAT_PERCENTAGE": "bodyFatPercentages", "BODY_MASS_INDEX": "bmis", "DIETARY_WATER": "waters", "ACTIVE_ENERGY_BURNED": "activeCalories", "BASAL_ENERGY_BURNED": "basalCalories", "SLEEP_AWAKE": "sleepAnalysis_Awake", "SLEEP_DEEP": "sleepAnalysis_Asleep(Deep)", "SLEEP_LIGHT": "sleepAnalysis_Asleep(Core)", "SLEEP_REM": "sleepAnalysis_Asleep(REM)", "SLEEP_IN_BED": "sleepAnalysis_InBed", "SLEEP_ASLEEP": "sleepAnalysis_Asleep(Total)"}
APPLE_SLEEP_TOTAL = ["SLEEP_DEEP", "SLEEP_LIGHT", "SLEEP_REM", "SLEEP_ASLEEP"]
APPLE_DURATIONS = ["STEPS", "FLIGHTS_CLIMBED", "DISTANCE_WALKING_RUNNING", "DISTANCE_CYCLING"]


def _number(item: Column, path: str) -> Column:
    return F.get_json_object(item, f"$.{path}").try_cast("double")


def _fields(item: Column, kind: Column, maps: dict[str, list[Mapping]]) -> Column:
    """An array of (type, value, unit) for the mapped fields that hold a number."""
    out = F.array().cast("array<struct<type:string,value:double,unit:string>>")
    for name, rows in maps.items():
        made = F.array(*[F.struct(F.lit(t).alias("type"), (_number(item, p) * F.lit(float(f))).alias("value"), F.lit(u).alias("unit")) for p, t, u, f in rows])
        out = F.when(kind == name, made).otherwise(out)
    return F.filter(out, lambda r: r["value"].isNotNull())


def _records(df: DataFrame, source: str, fields: Column, time_ms: Column, zone: Column) -> DataFrame:
    return df.select("user_id", F.lit(source).alias("source"), time_ms.alias("time_ms"), zone.alias("timezone"), F.explode(fields).alias("r")).select("user_id", "source", "r.type", "time_ms", "r.unit", "r.value", "timezone")


def split_webhook(payloads: DataFrame) -> DataFrame:
    """(payload) of {kind: [items with userId]} to rows (user_id, kind, item)."""
    kinds = F.explode(F.from_json("payload", "map<string,array<string>>"))
    items = payloads.select(kinds.alias("kind", "items")).select("kind", F.explode("items").alias("item"))
    return items.select(F.get_json_object("item", "$.userId").alias("user_id"), "kind", "item")


def day_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def garmin(items: DataFrame) -> DataFrame:
    """(user_id, kind, item) to records: plain fields, lists and maps of offset readings, and derived sums."""
    item, kind = F.col("item"), F.col("kind")
    start = F.get_json_object(item, "$.startTimeInSeconds").try_cast("bigint") * 1000
    at = F.coalesce(F.when(kind.isin("bodyComps", "pulseOx", "bloodPressures", "activities", "respiration"), start), day_ms(F.get_json_object(item, "$.calendarDate")), start)
    one = lambda t, v, u: F.struct(F.lit(t).alias("type"), v.alias("value"), F.lit(u).alias("unit"))
    total = _number(item, "activeKilocalories") + _number(item, "bmrKilocalories")
    slept, awake = _number(item, "durationInSeconds") * 1000, F.coalesce(_number(item, "awakeDurationInSeconds"), F.lit(0.0)) * 1000
    derived = F.when(kind == "dailies", F.array(one("dailyTotalCalories", total, "kcal"))).when(kind == "sleeps", F.array(one("sleepAnalysis_InBed", slept + awake, "ms"), one("dailyTotalSleepTime", slept, "ms"), one("sleepEfficiency", F.round(F.when(slept + awake > 0, slept / (slept + awake) * 100), 4), "%"))).otherwise(F.array().cast("array<struct<type:string,value:double,unit:string>>"))
    plain = _records(items, "theta.theta_garmin", F.concat(_fields(item, kind, GARMIN), F.filter(derived, lambda r: r["value"].isNotNull())), at, F.lit("UTC"))
    listed = items.where(kind == "dailies").select("user_id", start.alias("s"), F.explode(F.from_json(F.get_json_object("item", "$.timeOffsetHeartRateSamples"), "array<struct<timestampOffsetInSeconds:bigint,heartRateInBeatsPerMinute:double>>")).alias("x"))
    listed = listed.select("user_id", F.lit("theta.theta_garmin").alias("source"), F.lit("heartRates").alias("type"), (F.col("s") + F.col("x.timestampOffsetInSeconds") * 1000).alias("time_ms"), F.lit("count/min").alias("unit"), F.col("x.heartRateInBeatsPerMinute").alias("value"), F.lit("UTC").alias("timezone"))
    out = plain.unionByName(listed)
    for name, (field, indicator, unit) in GARMIN_SERIES.items():
        series = items.where(kind == name).select("user_id", start.alias("s"), F.explode(F.from_json(F.get_json_object("item", f"$.{field}"), "map<string,double>")).alias("k", "v"))
        out = out.unionByName(series.select("user_id", F.lit("theta.theta_garmin").alias("source"), F.lit(indicator).alias("type"), (F.col("s") + F.col("k").cast("bigint") * 1000).alias("time_ms"), F.lit(unit).alias("unit"), F.col("v").alias("value"), F.lit("UTC").alias("timezone")))
    return out.where("value is not null and time_ms is not null")


def whoop(items: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """(user_id, kind, item) to records of scored items; zones of workouts two by two, in minutes, where above zero."""
    item, kind = F.col("item"), F.col("kind")
    at = F.coalesce(day_ms(F.get_json_object(item, "$.start")), day_ms(F.get_json_object(item, "$.created_at")), now_ms if now_ms is not None else F.lit(None).cast("bigint"))
    zone = lambda n: F.coalesce(_number(item, f"score.zone_durations.zone_{n}_milli"), F.lit(0.0))
    pairs = [("workoutDurationLow", "zero", "one"), ("workoutDurationMedium", "two", "three"), ("workoutDurationHigh", "four", "five")]
    zones = F.filter(F.array(*[F.struct(F.lit(t).alias("type"), ((zone(a) + zone(b)) / 60000).alias("value"), F.lit("min").alias("unit")) for t, a, b in pairs]), lambda r: r["value"] > 0)
    fields = F.concat(_fields(item, kind, WHOOP), F.when(kind == "workout", zones).otherwise(F.array().cast("array<struct<type:string,value:double,unit:string>>")))
    scored = items.where((kind == "body") | (F.get_json_object(item, "$.score_state") == "SCORED"))
    return _records(scored, "theta.theta_whoop", fields, at, F.coalesce(F.get_json_object(item, "$.timezone_offset"), F.lit("UTC"))).where("time_ms is not null")


def oura(items: DataFrame, sync_ms: Column | None = None) -> DataFrame:
    """(user_id, kind, item) to records at the item's time, else its day, else the day of the sync."""
    item, kind = F.col("item"), F.col("kind")
    at = F.coalesce(day_ms(F.get_json_object(item, "$.bedtime_start")), day_ms(F.get_json_object(item, "$.timestamp")), day_ms(F.get_json_object(item, "$.day")), sync_ms if sync_ms is not None else F.lit(None).cast("bigint"))
    out = _records(items, "theta.theta_oura", _fields(item, kind, OURA), at, F.lit("UTC")).where("time_ms is not null")
    return out.withColumn("value", F.when(F.col("type").isin("stressHighDuration", "recoveryHighDuration"), F.bround("value", 1)).otherwise(F.col("value")))


def apple(payloads: DataFrame) -> DataFrame:
    """(user_id, payload) with healthData items to records; steps and the like with an id are durations, and a stage
    of sleep counts for the total, too."""
    schema = "array<struct<uuid:string,type:string,dateFrom:bigint,dateTo:bigint,timezone:string,value:struct<numericValue:double>,unitSymbol:string>>"
    rows = payloads.select("user_id", F.explode(F.from_json(F.get_json_object("payload", "$.healthData"), schema)).alias("x")).select("user_id", "x.*")
    names = F.create_map(*[F.lit(v) for kv in APPLE.items() for v in kv])
    start, end = F.coalesce("dateFrom", "dateTo"), F.coalesce("dateTo", "dateFrom")
    lasting = F.col("type").isin(APPLE_DURATIONS) & F.col("uuid").isNotNull() | F.col("type").startswith("SLEEP_")
    base = F.struct(names[F.col("type")].alias("type"), F.when(lasting & F.col("type").startswith("SLEEP_"), (end - start).cast("double")).otherwise(F.coalesce("value.numericValue", F.lit(1.0))).alias("value"), F.when(F.col("type").startswith("SLEEP_"), "ms").otherwise(F.col("unitSymbol")).alias("unit"))
    total = F.struct(F.lit("sleepAnalysis_Asleep(Total)").alias("type"), (end - start).cast("double").alias("value"), F.lit("ms").alias("unit"))
    fields = F.when(F.col("type").isin([t for t in APPLE_SLEEP_TOTAL if t != "SLEEP_ASLEEP"]), F.array(base, total)).otherwise(F.array(base))
    zone = F.when(F.length("timezone") > 20, "UTC").otherwise(F.coalesce("timezone", F.lit("UTC")))
    return _records(rows, "apple_health", F.filter(fields, lambda r: r["type"].isNotNull()), start, zone)


#: Fields of Apple's statistics and the methods that they are results of.
STATISTICS = {"sum": "total", "average": "avg", "minimum": "min", "maximum": "max", "mostRecent": "last"}


def apple_statistics(payloads: DataFrame) -> DataFrame:
    """(user_id, payload) with statistics to summary rows (user_id, indicator, start_time, end_time, value), times local."""
    from tidemark.functions.registry import target

    schema = "array<struct<type:string,grouping:string,dateFrom:bigint,dateTo:bigint,timezone:string," + ",".join(f"{k}:double" for k in STATISTICS) + ">>"
    rows = payloads.select("user_id", F.explode(F.from_json(F.get_json_object("payload", "$.statistics"), schema)).alias("x")).select("user_id", "x.*")
    rows = rows.withColumn("source_indicator", F.try_element_at(F.create_map(*[F.lit(v) for kv in APPLE.items() for v in kv]), F.col("type"))).where("source_indicator is not null and grouping in ('hourly', 'daily', 'weekly', 'monthly')")
    made = F.array(*[F.struct(F.lit(target(m, "", "")).alias("method"), F.col(k).alias("value")) for k, m in STATISTICS.items()])
    zone = F.coalesce("timezone", F.lit("UTC"))
    local = lambda c: F.from_utc_timestamp(F.timestamp_millis(c), zone)
    name = F.concat("grouping", "r.method", F.upper(F.substring("source_indicator", 1, 1)), F.substring("source_indicator", 2, 200))
    return rows.withColumn("r", F.explode(F.filter(made, lambda x: x["value"].isNotNull()))).select("user_id", name.alias("indicator"), local(F.col("dateFrom")).alias("start_time"), local(F.col("dateTo")).alias("end_time"), F.col("r.value").alias("value"))


def to_readings(records: DataFrame, now: Column) -> DataFrame:
    """Records to readings: names in the registry's spelling, percent fix, the registry's unit, range tag, naive UTC time,
    source in lower case, value as text."""
    from tidemark.functions.registry import INDICATORS
    from tidemark.functions.scalars import convert, percent_fix, validate
    from tidemark.sources.readings import FILTERED

    known = records.sparkSession.createDataFrame([(i.name.lower(), i.name, i.unit) for i in INDICATORS], "_low string, _name string, to_unit string")
    r = records.withColumn("_low", F.lower("type")).join(F.broadcast(known), "_low", "left").select("user_id", F.coalesce("_name", "type").alias("indicator"), "source", "time_ms", "unit", percent_fix(F.col("value"), F.col("unit"), F.col("source")).alias("value"), F.coalesce("to_unit", "unit").alias("to_unit"), "timezone")
    r = convert(r).select("user_id", "indicator", F.lower("source").alias("source"), F.timestamp_millis("time_ms").alias("time"), F.col("converted").alias("num"), "timezone")
    r = validate(r)
    return r.select("user_id", "indicator", "source", "time", F.col("num").cast("string").alias("value"), "num", "timezone", F.when(F.col("reason").isNotNull(), FILTERED).alias("task_id"), now.alias("update_time"))


def genotypes(lines: DataFrame) -> DataFrame:
    """(value) of a genotype file's lines after its header to (rsid, chromosome, position, genotype).

    Comments and the header begin with #; lines whose position is no number are passed over."""
    p = F.split(F.trim("value"), r"\t|\s+")
    return lines.where(~F.col("value").startswith("#")).select(p[0].alias("rsid"), F.get(p, F.lit(1)).alias("chromosome"), F.get(p, F.lit(2)).try_cast("int").alias("position"), F.get(p, F.lit(3)).alias("genotype")).where("position is not null and genotype is not null")
