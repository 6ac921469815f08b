"""Queries of the daily engine and what follows from its summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import registry
from tidemark.operators import clinical, daily, derived
from tidemark.sources.readings import READINGS_SQL as R
from tidemark.sources.readings import readings

_N2 = "(2 * {x} + {n}) // (2 * {n})"


def _half_up_avg(x: str) -> str:
    """The mean of a decimal with two places, rounded half up to two places, in whole numbers."""
    return f"((2 * CAST(sum({x} * 100) AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0"


def _share(condition: str) -> str:
    return f"((2 * 10000 * CAST(count(*) FILTER (WHERE {condition}) AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0"


_NUMBER = {"avg": _half_up_avg("num"), "max": "CAST(max(num) AS DOUBLE)", "min": "CAST(min(num) AS DOUBLE)", "total": "CAST(sum(num) AS DOUBLE)", "stddev": "round(stddev_samp(CAST(num AS DOUBLE)), 2)", "last": "CAST(arg_max(num, (time, num)) AS DOUBLE)"}


def _method_sql(method: str) -> str:
    if bound := registry.threshold(method):
        kind, low, high = bound
        return _share(f"num < {low}" if kind == "below" else f"num > {low}" if kind == "above" else f"num BETWEEN {low} AND {high}")
    return _NUMBER[method]


def _summaries_sql() -> str:
    made = {i for i in ("heartRates", "bloodGlucoses", "steps", "sleepAnalysis_InBed", "oxygenSaturations")}
    parts = [
        f"SELECT user_id, '{t}' || '.' || CASE WHEN source LIKE 'vital.%' THEN substr(source, 7) ELSE source END AS indicator, CAST(day AS TIMESTAMP) AS start_time, CAST(day AS TIMESTAMP) + INTERVAL 86399 SECOND AS end_time, {_method_sql(m)} AS value FROM good WHERE indicator = '{i}' GROUP BY user_id, source, timezone, day"
        for i, m, t in daily.plain_rules() if i in made
    ]
    return f"WITH {R} SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


#: The daily values per user and day that second-level indicators start from, for the SQL.
VALUES_SQL = f"""{R}, vals AS (SELECT user_id, day, indicator, source, {_NUMBER['avg']} AS a, CAST(max(num) AS DOUBLE) AS hi, CAST(min(num) AS DOUBLE) AS lo, CAST(sum(num) AS DOUBLE) AS s, round(stddev_samp(CAST(num AS DOUBLE)), 2) AS sd FROM good GROUP BY ALL)"""

GROUP = "user_id, indicator, source, timezone, day"
_day = "CAST(day AS TIMESTAMP) AS day"


def _daily(methods):
    def run(spark, d):
        return daily.aggregate(readings(spark, d), methods).select("user_id", "indicator", "source", F.col("day").cast("timestamp").alias("day"), *methods)

    return run


_HYPO = f"""WITH {R}, g AS (SELECT *, CASE WHEN num >= 90 OR epoch_us(time) - epoch_us(lag(time) OVER w) > 86400000000 THEN 1 ELSE 0 END AS br FROM good WHERE indicator = 'bloodGlucoses' AND num >= 20 WINDOW w AS (PARTITION BY {GROUP} ORDER BY time)),
i AS (SELECT *, sum(br) OVER (PARTITION BY {GROUP} ORDER BY time) AS island FROM g),
e AS (SELECT user_id, source, timezone, day, strftime(min(local_time), '%H:%M') AS at_time, CAST(round((epoch_us(max(time)) - epoch_us(min(time))) / 60000000.0) AS BIGINT) AS minutes, (epoch_us(max(time)) - epoch_us(min(time))) AS us FROM i WHERE num < 90 GROUP BY user_id, source, timezone, day, island)"""

QUERIES = {
    "daily_summaries": (lambda s, d: daily.summaries(readings(s, d)), _summaries_sql()),
    "daily_avg_max_min": (_daily(["avg", "max", "min"]), f"WITH {R} SELECT user_id, indicator, source, {_day}, {_NUMBER['avg']} AS avg, CAST(max(num) AS DOUBLE) AS max, CAST(min(num) AS DOUBLE) AS min FROM good GROUP BY {GROUP}"),
    "daily_total_count": (_daily(["total", "count"]), f"WITH {R} SELECT user_id, indicator, source, {_day}, CAST(sum(num) AS DOUBLE) AS total, count(*) AS count FROM good GROUP BY {GROUP}"),
    "daily_stddev": (_daily(["stddev"]), f"WITH {R} SELECT user_id, indicator, source, {_day}, round(stddev_samp(CAST(num AS DOUBLE)), 2) AS stddev FROM good GROUP BY {GROUP}"),
    "daily_first_last": (_daily(["first", "last"]), f"WITH {R} SELECT user_id, indicator, source, {_day}, CAST(arg_min(num, (time, num)) AS DOUBLE) AS first, CAST(arg_max(num, (time, num)) AS DOUBLE) AS last FROM good GROUP BY {GROUP}"),
    "daily_median_p95": (_daily(["median", "p95"]), f"WITH {R} SELECT user_id, indicator, source, {_day}, round(quantile_cont(CAST(num AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(num AS DOUBLE), 0.95), 6) AS p95 FROM good GROUP BY {GROUP}"),
    "daily_time_of_extremes": (_daily(["time_of_max", "time_of_min"]), f"WITH {R} SELECT user_id, indicator, source, {_day}, strftime(arg_min(local_time, (-num, time)), '%H:%M') AS time_of_max, strftime(arg_min(local_time, (num, time)), '%H:%M') AS time_of_min FROM good GROUP BY {GROUP}"),
    "daily_glucose_ranges": (lambda s, d: daily.aggregate(readings(s, d).where("indicator = 'bloodGlucoses'"), ["pct_below_70", "tir_70_180", "pct_above_180", "tir_70_140"]).select("user_id", "source", F.col("day").cast("timestamp").alias("day"), "pct_below_70", "tir_70_180", "pct_above_180", "tir_70_140"), f"WITH {R} SELECT user_id, source, {_day}, " + ", ".join(f"{_method_sql(m)} AS {m}" for m in ("pct_below_70", "tir_70_180", "pct_above_180", "tir_70_140")) + f" FROM good WHERE indicator = 'bloodGlucoses' GROUP BY {GROUP}"),
    "hypo_events": (lambda s, d: clinical.hypo_events(readings(s, d), low=90, gap_minutes=1440).select("user_id", "source", F.col("day").cast("timestamp").alias("day"), "at_time", "minutes"), f"{_HYPO} SELECT user_id, source, {_day}, at_time, minutes FROM e WHERE us >= 900000000"),
    "hypo_summary": (lambda s, d: clinical.hypo_summary(readings(s, d), low=90, gap_minutes=1440).withColumn("day", F.col("day").cast("timestamp")), f"{_HYPO}, k AS (SELECT user_id, source, timezone, day, count(*) AS n, string_agg(at_time, ',' ORDER BY at_time) AS ats, sum(minutes) AS m FROM e WHERE us >= 900000000 GROUP BY ALL) SELECT u.user_id, u.source, CAST(u.day AS TIMESTAMP) AS day, coalesce(n, 0) AS event_count, coalesce(ats, '') AS event_times, CAST(coalesce(m, 0) AS BIGINT) AS event_minutes FROM (SELECT DISTINCT user_id, source, timezone, day FROM good WHERE indicator = 'bloodGlucoses' AND true) u LEFT JOIN k ON k.user_id = u.user_id AND k.source = u.source AND k.timezone = u.timezone AND k.day = u.day"),
    "hypo_events_clinical": (lambda s, d: clinical.hypo_events(readings(s, d)).select("user_id", "source", F.col("day").cast("timestamp").alias("day"), "at_time", "minutes"), None),
    "hypo_summary_clinical": (lambda s, d: clinical.hypo_summary(readings(s, d)).withColumn("day", F.col("day").cast("timestamp")), None),
    "gmi_14d": (lambda s, d: clinical.gmi(readings(s, d)).withColumn("day", F.col("day").cast("timestamp")), None),
    "morning_hr_jump": (lambda s, d: clinical.morning_jump(readings(s, d)).withColumn("day", F.col("day").cast("timestamp")), f"WITH {R}, h AS (SELECT user_id, day, num, hour(local_time) AS h FROM good WHERE indicator = 'heartRates' AND num BETWEEN 30 AND 220), j AS (SELECT user_id, day, max(num) FILTER (WHERE h BETWEEN 6 AND 8) AS top, CAST(sum(num * 100) FILTER (WHERE h BETWEEN 1 AND 4) AS HUGEINT) AS s, count(*) FILTER (WHERE h BETWEEN 1 AND 4) AS n FROM h GROUP BY ALL) SELECT user_id, CAST(day AS TIMESTAMP) AS day, round((CAST(top * 100 AS HUGEINT) * n - s) / n / 100.0, 2) AS jump FROM j WHERE n > 0 AND CAST(top * 100 AS HUGEINT) * n > s"),
    "nighttime_resting_hr": (lambda s, d: clinical.night_resting(readings(s, d), points=2).withColumn("day", F.col("day").cast("timestamp")), f"WITH {R} SELECT user_id, CAST(day AS TIMESTAMP) AS day, round(quantile_cont(CAST(num AS DOUBLE), 0.1), 4) AS resting, count(*) AS points FROM good WHERE indicator = 'heartRates' AND num BETWEEN 30 AND 220 AND hour(local_time) BETWEEN 1 AND 4 GROUP BY user_id, day HAVING count(*) >= 2"),
    "sleep_onset_latency": (lambda s, d: clinical.sleep_onset(readings(s, d)).withColumn("night", F.col("night").cast("timestamp")), f"WITH {R}, g AS (SELECT *, CAST(local_time - INTERVAL 18 HOUR AS DATE) AS night FROM good WHERE indicator IN ('sleepAnalysis_InBed', 'oxygenSaturations')), b AS (SELECT user_id, night, min(time) FILTER (WHERE indicator = 'sleepAnalysis_InBed') AS bed FROM g GROUP BY ALL), o AS (SELECT g.user_id, g.night, any_value(bed) AS bed, min(time) AS asleep FROM g JOIN b ON g.user_id = b.user_id AND g.night = b.night WHERE indicator = 'oxygenSaturations' AND time > bed GROUP BY ALL) SELECT user_id, CAST(night AS TIMESTAMP) AS night, round((epoch_us(asleep) - epoch_us(bed)) / 60000000.0, 2) AS latency FROM o WHERE (epoch_us(asleep) - epoch_us(bed)) / 60000000.0 <= 120"),
    "derived_indicators": (lambda s, d: derived.from_readings(readings(s, d)).withColumn("day", F.col("day").cast("timestamp")), None),
    "special_summaries": (lambda s, d: clinical.special_summaries(readings(s, d)).withColumn("day", F.col("day").cast("timestamp")), None),
    "latest_per_indicator": (lambda s, d: derived.latest(readings(s, d)), f"WITH {R} SELECT user_id, indicator, time, CAST(num AS DOUBLE) AS num FROM (SELECT *, row_number() OVER (PARTITION BY user_id, indicator ORDER BY time DESC, event_id DESC) AS r FROM readings) WHERE r = 1"),
}
_VAL = f"WITH {VALUES_SQL}, pick AS (SELECT user_id, day, indicator, a, hi, lo, s, sd FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, indicator ORDER BY CASE source WHEN 'vital.garmin' THEN 8 WHEN 'apple_health' THEN 99 ELSE 999 END, hi DESC) AS r FROM vals) WHERE r = 1)"
QUERIES["derived_indicators"] = (QUERIES["derived_indicators"][0], f"{_VAL} SELECT user_id, CAST(day AS TIMESTAMP) AS day, 'derivedHrRange' AS indicator, round(hi - lo, 2) AS value FROM pick WHERE indicator = 'heartRates' AND hi > lo UNION ALL SELECT user_id, CAST(day AS TIMESTAMP), 'derivedBloodGlucoseCV', round(least(100.0, sd / a * 100), 2) FROM pick WHERE indicator = 'bloodGlucoses' AND a > 0 AND sd IS NOT NULL")
for _name in ("hypo_events", "hypo_summary"):
    QUERIES[f"{_name}_clinical"] = (QUERIES[f"{_name}_clinical"][0], QUERIES[_name][1].replace("num >= 90", "num >= 70").replace("num < 90", "num < 70").replace("> 86400000000", "> 3600000000"))
