"""Schemas of the engine's tables, and the view that reads the test events as health readings.

A reading is (user_id, indicator, source, time, value, num, timezone, task_id, update_time): time is naive UTC,
value is text, num its guarded decimal, task_id marks rows that were kept although out of range."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import dealt

FILTERED = "filtered_out_of_range"
SERIES = T.StructType([T.StructField(n, t) for n, t in (("user_id", T.StringType()), ("indicator", T.StringType()), ("source", T.StringType()), ("time", T.TimestampType()), ("value", T.StringType()), ("timezone", T.StringType()), ("task_id", T.StringType()), ("source_id", T.StringType()), ("update_time", T.TimestampType()))])
SUMMARY = T.StructType([T.StructField(n, t) for n, t in (("user_id", T.StringType()), ("indicator", T.StringType()), ("value", T.StringType()), ("start_time", T.TimestampType()), ("end_time", T.TimestampType()), ("source", T.StringType()), ("source_table", T.StringType()), ("task_id", T.StringType()), ("deleted", T.IntegerType()), ("fhir_id", T.LongType()))])

#: How the test events stand for readings: type, indicator, base and factor of the value.
EVENT_KINDS = [("view", "heartRates", 40, 4), ("click", "bloodGlucoses", 50, 6), ("purchase", "steps", 0, 100), ("signup", "sleepAnalysis_InBed", 0, 3600000), ("error", "oxygenSaturations", 85, 1)]
ZONES = ["UTC", "Asia/Shanghai", "America/Los_Angeles", "Europe/Berlin"]
SOURCES = ["apple_health", "vital.garmin", "theta.theta_oura"]


def numeric(value: Column) -> Column:
    """The number that a text holds, or null: the one guard that every operator uses."""
    return F.when(value.rlike(r"^-?[0-9]+\.?[0-9]*$"), value.try_cast("decimal(38,9)"))


def not_filtered(task_id: Column) -> Column:
    return task_id.isNull() | (task_id != FILTERED)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    amount = F.col("value").cast("decimal(12,2)")
    indicator, num = F.lit(None).cast("string"), F.lit(None).cast("decimal(14,2)")
    for kind, name, base, factor in EVENT_KINDS:
        indicator = F.when(F.col("event_type") == kind, name).otherwise(indicator)
        num = F.when(F.col("event_type") == kind, (amount * factor + base).cast("decimal(14,2)")).otherwise(num)
    pick = lambda of, names: F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))
    return e.select(
        F.col("user_id").cast("string").alias("user_id"), indicator.alias("indicator"), pick(F.col("user_id"), SOURCES).alias("source"), F.col("ts").cast("timestamp").alias("time"), num.alias("num"), num.cast("string").alias("value"),
        pick(F.col("user_id"), ZONES).alias("timezone"), F.when(F.col("value") > 40, FILTERED).alias("task_id"), "event_id", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("update_time"),
    )


def _case(column: int) -> str:
    return " ".join(f"WHEN '{k[0]}' THEN " + (f"'{k[1]}'" if column == 1 else f"CAST(CAST(value AS DECIMAL(12,2)) * {k[3]} + {k[2]} AS DECIMAL(14,2))") for k in EVENT_KINDS)


#: The same view for the SQL that results must agree with.
READINGS_SQL = f"""readings AS (SELECT *, CAST(num AS VARCHAR) AS value FROM (SELECT CAST(user_id AS VARCHAR) AS user_id,
 CASE event_type {_case(1)} END AS indicator,
 CASE user_id % 3 WHEN 0 THEN 'apple_health' WHEN 1 THEN 'vital.garmin' ELSE 'theta.theta_oura' END AS source, ts AS time,
 CASE event_type {_case(2)} END AS num,
 CASE user_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Shanghai' WHEN 2 THEN 'America/Los_Angeles' ELSE 'Europe/Berlin' END AS timezone,
 CASE WHEN value > 40 THEN '{FILTERED}' END AS task_id, event_id, ts + INTERVAL 1 HOUR AS update_time FROM events)),
local AS (SELECT *, (time AT TIME ZONE 'UTC') AT TIME ZONE timezone AS local_time,
 CAST(((time AT TIME ZONE 'UTC') AT TIME ZONE timezone) - CASE WHEN lower(indicator) LIKE '%sleep%' THEN INTERVAL 18 HOUR ELSE INTERVAL 0 HOUR END AS DATE) AS day
 FROM readings),
good AS (SELECT * FROM local WHERE task_id IS NULL OR task_id <> '{FILTERED}')"""

#: Categories of the daily values below: base, and the divisor of the noise.
SIGNALS = [("heartRate", 60, 24.0), ("hrv", 50, 24.0), ("bloodGlucose", 95, 12.0), ("steps", 8000, 0.1), ("weight", 70, 97.0)]
#: The days of the daily values end on this one, a Sunday.
LAST_DAY, DAYS = "2024-03-31", 91
#: Fixed value: a task makes the values of so many users at most (a user has DAYS of each category).
USERS_OF_TASK = 4000
#: What befalls the customers of each kind (key modulo 8) as SQL of both engines: u the key, d the number of the day.
_STORY = """CASE WHEN u % 8 = 1 AND category = 'heartRate' AND d >= 86 THEN 25.0D WHEN u % 8 = 1 AND category = 'hrv' AND d >= 86 THEN -25.0D
 WHEN u % 8 = 2 AND category = 'heartRate' AND d BETWEEN 50 AND 84 THEN (85 - d) * 1.25D WHEN u % 8 = 3 AND category = 'heartRate' AND d >= 62 THEN (d - 62) * 0.5D
 WHEN u % 8 = 4 AND category = 'bloodGlucose' AND d >= 82 THEN 30.0D WHEN u % 8 = 5 AND category = 'steps' AND (d % 7 = 6 OR d % 7 = 5) THEN -4000.0D
 WHEN u % 8 = 6 AND category = 'weight' AND d >= 80 THEN 8.0D ELSE 0.0D END"""
_MISSING = "u % 8 = 7 AND (u * 31 + d * 17) % 3 = 0"


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, category, day, value): the customers as users with a value a day of each category, some of them unwell.

    The users are dealt out before they are multiplied, as a file of customers is small; what groups by user stays there."""
    kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.lit(n).alias("category"), F.lit(float(b)).alias("base"), F.lit(w).alias("wide")) for i, (n, b, w) in enumerate(SIGNALS)])
    users = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("u"), F.col("c_custkey").cast("string").alias("user_id")), USERS_OF_TASK, "user_id")
    rows = users.select("u", "user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DAYS - 1).cast("long"))).alias("d")).withColumn("s", F.explode(kinds)).select("u", "user_id", "d", "s.*")
    value = F.expr("base + ((u * 7919 + d * 104729 + k * 1299709) % 97) / wide + " + _STORY)
    return rows.where(f"not ({_MISSING})").select("user_id", "category", F.date_add(F.date_sub(F.lit(LAST_DAY).cast("date"), DAYS - 1), F.col("d").cast("int")).alias("day"), value.alias("value"))


VALUES_OF_DAYS_SQL = f"""kinds AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', CAST({b} AS DOUBLE), CAST({w} AS DOUBLE))" for i, (n, b, w) in enumerate(SIGNALS))}) AS t(k, category, base, wide)),
v AS (SELECT CAST(u AS VARCHAR) AS user_id, category, CAST(DATE '{LAST_DAY}' - {DAYS - 1} + CAST(d AS INT) AS DATE) AS day, base + ((u * 7919 + d * 104729 + k * 1299709) % 97) / wide + {re.sub(r"([0-9.]+)D", r"CAST(\1 AS DOUBLE)", _STORY)} AS value
 FROM (SELECT CAST(c_custkey AS BIGINT) AS u FROM customer), (SELECT unnest(generate_series(0, {DAYS - 1})) AS d), kinds WHERE NOT ({_MISSING}))"""
