"""Queries of monitoring and data quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import registry
from tidemark.operators import daily, derived
from tidemark.operators import quality as q
from tidemark.sources.readings import FILTERED, readings
from tidemark.plans import daily_queries
from tidemark.sources.readings import READINGS_SQL as R

#: The moment that reports are made for, in the test data.
AS_OF = "2024-01-29 12:00:00"


def _at(moment: str = AS_OF):
    return F.lit(moment).cast("timestamp")



_TS = f"TIMESTAMP '{AS_OF}'"
_PLATFORM = "CASE WHEN source LIKE 'vital.%' THEN 'vital' WHEN source LIKE 'theta.%' THEN 'theta' WHEN source LIKE 'apple_health%' THEN 'apple_health' ELSE 'other' END"
_X = f"CASE WHEN task_id IS NULL OR task_id <> '{FILTERED}' THEN CAST(num AS DOUBLE) END"


def _on(f, *moment):
    return lambda s, d: f(readings(s, d), *map(_at, moment))


_RULES = " UNION ALL ".join(f"SELECT '{i}' AS indicator, '{t}' AS target, '{u}' AS unit" for i, m, t, u in registry.rules())
_INPUTS = " UNION ALL ".join(f"SELECT '{name}' AS derived, '{i}' AS input" for name, (inputs, _) in derived.RULES.items() for i in inputs)
_SUMMARIES = daily_queries.QUERIES["daily_summaries"][1]

QUERIES = {
    "hourly_ingestion": (_on(q.hourly_ingestion), f"WITH {R} SELECT date_trunc('hour', time) AS stat_hour, source, count(*) AS records, count(DISTINCT user_id) AS users, count(DISTINCT indicator) AS indicators, count(*) FILTER (WHERE task_id = '{FILTERED}') AS filtered, {_PLATFORM} AS platform FROM readings GROUP BY 1, 2"),
    "changed_hours": (lambda s, d: q.changed_hours(readings(s, d), _at() - F.expr("INTERVAL 2 HOURS"), _at() - F.expr("INTERVAL 7 DAYS")), f"WITH {R} SELECT DISTINCT date_trunc('hour', time) AS stat_hour FROM readings WHERE update_time >= {_TS} - INTERVAL 2 HOUR AND time >= {_TS} - INTERVAL 7 DAY"),
    "daily_profile": (_on(q.daily_profile), f"WITH {R}, x AS (SELECT *, {_X} AS x, CASE WHEN task_id IS NULL OR task_id <> '{FILTERED}' THEN num END AS xd FROM readings), g AS (SELECT date_trunc('day', time) AS stat_date, indicator, source, count(x) AS n, count(*) FILTER (WHERE num IS NULL) AS non_numeric, count(*) FILTER (WHERE task_id = '{FILTERED}') AS filtered, min(x) AS low, max(x) AS high, CAST(sum(xd) AS DOUBLE) / count(xd) AS mean, stddev_samp(x) AS sigma, " + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + " FROM x GROUP BY 1, 2, 3), f AS (SELECT *, coalesce(sigma > 0 AND high > mean + 10 * sigma, false) AS a, coalesce(sigma > 0 AND low < mean - 10 * sigma, false) AS b FROM g) SELECT * EXCLUDE (a, b, mean, sigma), round(mean, 3) AS mean, round(sigma, 3) AS sigma, concat_ws(',', CASE WHEN a THEN 'suspicious_max' END, CASE WHEN b THEN 'suspicious_min' END) AS issues, CASE CAST(a AS INT) + CAST(b AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' ELSE 'critical' END AS health FROM f"),
    "ingestion_stats": (_on(q.ingestion_stats), f"WITH {R} SELECT {_PLATFORM} AS platform, count(*) AS records, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('hour', time)) AS hours FROM readings GROUP BY 1"),
    "exclusion_rate": (_on(q.exclusion_rate), f"WITH {R} SELECT indicator, count(*) AS total, count(*) FILTER (WHERE task_id = '{FILTERED}') AS filtered, round(count(*) FILTER (WHERE task_id = '{FILTERED}') / count(*) * 100, 4) AS rate FROM readings GROUP BY 1"),
    "cross_source_ratio": (_on(q.cross_source_ratio), f"WITH {R}, p AS (SELECT indicator, source, CAST(max(num) AS DOUBLE) AS top FROM good GROUP BY 1, 2 HAVING max(num) > 0) SELECT indicator, count(*) AS sources, arg_max(source, (top, source)) AS high_source, arg_min(source, (top, source)) AS low_source, round(max(top) / min(top), 6) AS ratio, max(top) / min(top) > 100 AS issue FROM p GROUP BY 1 HAVING count(*) >= 2"),
    "week_over_week": (_on(q.week_over_week, AS_OF), f"WITH {R}, c AS (SELECT {_PLATFORM} AS platform, count(*) FILTER (WHERE time >= {_TS} - INTERVAL 7 DAY AND time < {_TS}) AS this_week, count(*) FILTER (WHERE time >= {_TS} - INTERVAL 14 DAY AND time < {_TS} - INTERVAL 7 DAY) AS last_week, count(DISTINCT user_id) FILTER (WHERE time >= {_TS} - INTERVAL 7 DAY AND time < {_TS}) AS users_now, count(DISTINCT user_id) FILTER (WHERE time >= {_TS} - INTERVAL 14 DAY AND time < {_TS} - INTERVAL 7 DAY) AS users_before FROM readings GROUP BY 1) SELECT *, CASE WHEN last_week > 0 THEN round((this_week - last_week) * 100.0 / last_week, 1) END AS change_pct FROM c"),
    "silent_platforms": (_on(q.silent_platforms, AS_OF), f"WITH {R}, c AS (SELECT {_PLATFORM} AS platform, count(*) FILTER (WHERE time >= {_TS} - INTERVAL 1 DAY AND time < {_TS}) AS last_24h, count(*) FILTER (WHERE time >= {_TS} - INTERVAL 2 DAY AND time < {_TS} - INTERVAL 1 DAY) AS prev_24h FROM readings GROUP BY 1) SELECT *, prev_24h > 0 AND last_24h = 0 AS silent FROM c"),
    "source_status": (_on(q.source_status, AS_OF), f"WITH {R}, c AS (SELECT source, count(*) AS records, count(DISTINCT CAST(time AS DATE)) AS active_days, max(time) AS last FROM readings WHERE time >= {_TS} - INTERVAL 7 DAY AND time < {_TS} GROUP BY 1) SELECT source, records, active_days, round(records / greatest(active_days, 1), 4) AS avg_daily, CASE WHEN epoch_us({_TS}) - epoch_us(last) > 48 * 3600000000 THEN 'stopped' WHEN epoch_us({_TS}) - epoch_us(last) > 24 * 3600000000 THEN 'warning' ELSE 'ok' END AS status FROM c"),
    "source_share": (_on(q.source_share), f"WITH {R} SELECT source, indicator, count(*) AS records, round(count(*) / sum(count(*)) OVER (PARTITION BY source) * 100, 4) AS share FROM readings GROUP BY 1, 2"),
    "summary_misclassification": (lambda s, d: q.misclassified(readings(s, d), most=2), f"WITH {R}, p AS (SELECT indicator, user_id, CAST(time AS DATE) AS d, count(*) AS n FROM readings GROUP BY 1, 2, 3 HAVING count(*) > 2) SELECT indicator, count(DISTINCT user_id) AS users, max(n) AS max_per_day FROM p GROUP BY 1 ORDER BY max_per_day DESC, indicator LIMIT 20"),
    "name_consistency": (lambda s, d: q.name_clashes(readings(s, d).withColumn("indicator", F.when(F.col("event_id") % 2 == 0, F.upper("indicator")).otherwise(F.col("indicator")))), f"WITH {R}, n AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN upper(indicator) ELSE indicator END AS indicator FROM readings) SELECT lower(indicator) AS folded, count(*) AS n, string_agg(indicator, ',' ORDER BY indicator) AS names FROM n GROUP BY 1 HAVING count(*) > 1"),
    "timestamp_quality": (_on(q.timestamp_quality, "2024-01-20"), f"WITH {R} SELECT source, count(*) FILTER (WHERE time < TIMESTAMP '2010-01-01') AS too_old, count(*) FILTER (WHERE time > TIMESTAMP '2024-01-22') AS in_future, count(*) AS total FROM readings GROUP BY 1"),
    "user_profile": (_on(q.user_profile, AS_OF), f"WITH {R}, p AS (SELECT user_id, indicator, count(DISTINCT CAST(time AS DATE)) AS days, count(*) AS records, max(time) AS latest, CAST(min(num) AS DOUBLE) AS low, CAST(max(num) AS DOUBLE) AS high, count(DISTINCT CAST(time AS DATE)) FILTER (WHERE CAST(time AS DATE) > CAST({_TS} AS DATE) - 14) AS recent FROM good GROUP BY 1, 2) SELECT *, datediff('day', CAST(latest AS DATE), CAST({_TS} AS DATE)) AS days_since, CASE WHEN recent >= 11 THEN 'continuous' WHEN recent >= 7 THEN 'intermittent' ELSE 'sparse' END AS density FROM p"),
    "analyzable_pairs": (lambda s, d: q.analyzable_pairs(q.user_profile(readings(s, d), _at())), f"WITH {R}, p AS (SELECT user_id, indicator, count(DISTINCT CAST(time AS DATE)) AS days FROM good GROUP BY 1, 2 HAVING count(DISTINCT CAST(time AS DATE)) FILTER (WHERE CAST(time AS DATE) > CAST({_TS} AS DATE) - 14) >= 7) SELECT a.user_id, a.indicator AS first, b.indicator AS second, least(a.days, b.days) AS days, least(a.days, b.days) >= 14 AS sufficient FROM p a JOIN p b ON a.user_id = b.user_id AND a.indicator < b.indicator"),
    "coverage_report": (lambda s, d: q.coverage(readings(s, d), registry.rules_table(s)), f"WITH {R}, r AS ({_RULES}), s AS (SELECT indicator, count(*) AS records, count(DISTINCT user_id) AS users FROM readings GROUP BY 1) SELECT r.indicator, target, unit, coalesce(records, 0) AS records, coalesce(users, 0) AS users FROM r LEFT JOIN s ON r.indicator = s.indicator"),
    "coverage_observed": (lambda s, d: q.observed_targets(daily.summaries(readings(s, d)), registry.rules_table(s)), f"WITH s AS ({_SUMMARIES}), r AS ({_RULES}), o AS (SELECT target, string_agg(indicator, ',' ORDER BY indicator) AS observed, CAST(sum(n) AS BIGINT) AS n FROM (SELECT split_part(indicator, '.', 1) AS target, indicator, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1) SELECT r.indicator, r.target, coalesce(observed, '') AS observed, coalesce(n, 0) AS \"rows\" FROM r LEFT JOIN o ON o.target = r.target"),
    "coverage_derived": (lambda s, d: q.derived_dependencies(daily.summaries(readings(s, d)), derived.inputs_table(s)), f"WITH s AS ({_SUMMARIES}), i AS ({_INPUTS}), h AS (SELECT DISTINCT split_part(indicator, '.', 1) AS input FROM s) SELECT derived, count(*) AS inputs, coalesce(string_agg(i.input, ',' ORDER BY i.input) FILTER (WHERE h.input IS NULL), '') AS missing, count(*) = count(h.input) AS satisfied FROM i LEFT JOIN h ON h.input = i.input GROUP BY 1"),
}
