"""Daily aggregation: one grouping by user, indicator, source and local day replaces a query per user and day.

A day is local to the reading's zone; indicators named for sleep have days from 18:00 to 18:00. Methods are
compiled to columns, so one shuffle serves all of them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import registry
from tidemark.sources.readings import not_filtered

KEYS = ["user_id", "indicator", "source", "timezone", "day"]


def sleep_shift(indicator: Column) -> Column:
    return F.when(F.lower(indicator).contains("sleep"), F.expr("INTERVAL 18 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))


def local_time(time: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(time, zone)


def with_day(df: DataFrame) -> DataFrame:
    """df with local_time, day (a date) and day_start_utc, the day's beginning."""
    shift = sleep_shift(F.col("indicator"))
    df = df.withColumn("local_time", local_time(F.col("time"), F.col("timezone")))
    df = df.withColumn("day", F.to_date(F.col("local_time") - shift))
    return df.withColumn("day_start_utc", F.to_utc_timestamp(F.col("day").cast("timestamp") + shift, F.col("timezone")))


def method_column(method: str, num: Column, time: Column, local: Column) -> Column:
    """The aggregate of a method's name; rounding is half up on decimals, as SQL does it. Of readings of one moment the
    smallest is the first and the largest the last."""
    number = num.cast("double")
    if bound := registry.threshold(method):
        kind, low, high = bound
        hit = number < low if kind == "below" else number > low if kind == "above" else number.between(low, high)
        return F.round((F.lit(100) * F.count_if(hit)).cast("decimal(20,6)") / F.count("*").cast("decimal(20,0)"), 2).cast("double")
    simple = {
        "avg": lambda: F.round(F.avg(num), 2), "max": lambda: F.round(F.max(num), 2), "min": lambda: F.round(F.min(num), 2), "sum": lambda: F.round(F.sum(num), 2), "total": lambda: F.round(F.sum(num), 2), "count": lambda: F.count("*"),
        "stddev": lambda: F.round(F.stddev_samp(number), 2), "variance": lambda: F.round(F.var_samp(number), 2), "last": lambda: F.max_by(num, F.struct(time, num)), "first": lambda: F.min_by(num, F.struct(time, num)),
        "median": lambda: F.round(F.percentile(number, F.lit(0.5)), 6), "p95": lambda: F.round(F.percentile(number, F.lit(0.95)), 6),
    }
    if method in simple:
        return simple[method]().cast("long" if method == "count" else "double")
    if method == "time_of_max":  # of equal extremes the earliest
        return F.date_format(F.min_by(local, F.struct(-num, time)), "HH:mm")
    if method == "time_of_min":
        return F.date_format(F.min_by(local, F.struct(num, time)), "HH:mm")
    raise ValueError(f"unknown method {method}")


def aggregate(df: DataFrame, methods: Iterable[str]) -> DataFrame:
    """Rows by KEYS with a column for each method."""
    good = with_day(df.where(not_filtered(F.col("task_id"))))
    return good.groupBy(*KEYS).agg(*[method_column(m, F.col("num"), F.col("time"), F.col("local_time")).alias(m) for m in methods])


def plain_rules(custom: Sequence[registry.Custom] = ()) -> list[tuple[str, str, str]]:
    """(indicator, method, target) of the rules that one grouping computes as numbers, the caller's own among them."""
    special = ("time_of_", "hypo_", "gmi_", "morning_", "nighttime_", "sleep_onset")
    own = {(c.indicator, c.method) for c in custom}
    return [(i, m, t) for i, m, t, _ in registry.rules(custom=custom) if (i, m) in own or not m.startswith(special)]


def summaries(df: DataFrame, custom: Sequence[registry.Custom] = ()) -> DataFrame:
    """Long summary rows (user_id, indicator, start_time, end_time, value) named target.source; nulls are left out.

    custom: rules of the caller; they are a value that is passed on, so sessions and workers share none."""
    wanted = plain_rules(custom)
    own = {(c.indicator, c.method): c.column for c in custom}
    made = [(i, m, t, f"m{n}" if (i, m) in own else m) for n, (i, m, t) in enumerate(wanted)]
    good = with_day(df.where(F.col("indicator").isin(sorted({i for i, *_ in wanted})) & not_filtered(F.col("task_id"))))
    num, time, local = F.col("num"), F.col("time"), F.col("local_time")
    columns = {c: own[i, m](num, time).cast("double") if (i, m) in own else method_column(m, num, time, local) for i, m, _, c in made}
    wide = good.groupBy(*KEYS).agg(*[x.alias(c) for c, x in columns.items()])
    values = F.array(*[F.struct(F.lit(i).alias("of"), F.lit(t).alias("target"), F.col(c).alias("value")) for i, _, t, c in made])
    rows = wide.select("user_id", "source", "day", F.explode(F.filter(values, lambda x: (x["of"] == F.col("indicator")) & x["value"].isNotNull())).alias("r"))
    start = F.col("day").cast("timestamp")
    return rows.select("user_id", F.concat("r.target", F.lit("."), F.regexp_replace(F.coalesce("source", F.lit("unknown")), r"^vital\.", "")).alias("indicator"), start.alias("start_time"), (start + F.expr("INTERVAL 86399 SECONDS")).alias("end_time"), F.col("r.value").alias("value"))
