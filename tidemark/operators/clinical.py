"""Operators over the order of readings: hypoglycaemia episodes, glucose management, heart rate and sleep specials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import registry
from tidemark.operators import daily
from tidemark.operators.daily import KEYS, with_day
from tidemark.sources.readings import not_filtered


def _good(df: DataFrame, indicator: str) -> DataFrame:
    return with_day(df.where((F.col("indicator") == indicator) & not_filtered(F.col("task_id"))))


def hypo_events(df: DataFrame, low: float = 70, least: float = 20, gap_minutes: int = 60, lasting_minutes: int = 15) -> DataFrame:
    """Episodes below `low`, broken by a reading not below it or by a gap, of at least `lasting_minutes`."""
    g = _good(df, "bloodGlucoses").where(F.col("num") >= least)
    w = Window.partitionBy(*KEYS).orderBy("time")
    gap = (F.unix_micros("time") - F.unix_micros(F.lag("time").over(w))) > gap_minutes * 60_000_000
    # peers share a value: the running sum has the default range frame
    g = g.withColumn("_break", F.when((F.col("num") >= low) | F.coalesce(gap, F.lit(False)), 1).otherwise(0)).withColumn("_island", F.sum("_break").over(w))
    e = g.where(F.col("num") < low).groupBy(*KEYS, "_island").agg(F.min("time").alias("start"), F.max("time").alias("stop"), F.min("num").alias("nadir"), F.min("local_time").alias("local_start"))
    minutes = (F.unix_micros("stop") - F.unix_micros("start")) / F.lit(60_000_000)
    return e.where(minutes >= lasting_minutes).select(*KEYS, F.date_format("local_start", "HH:mm").alias("at_time"), F.round(minutes, 0).cast("long").alias("minutes"), F.col("nadir").cast("double").alias("nadir"))


def hypo_summary(df: DataFrame, **kw) -> DataFrame:
    """A row for each day with glucose readings: the number of episodes (0 without), their times and details."""
    days = _good(df, "bloodGlucoses").select(*KEYS).distinct()
    e = hypo_events(df, **kw).groupBy(*KEYS).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at_time", "minutes", "nadir"))).alias("events"))
    out = days.join(e, KEYS, "left")
    return out.select("user_id", "source", "day", F.coalesce("n", F.lit(0)).cast("long").alias("event_count"), F.coalesce(F.array_join(F.transform("events", lambda x: x["at_time"]), ","), F.lit("")).alias("event_times"), F.coalesce(F.aggregate("events", F.lit(0).cast("long"), lambda a, x: a + x["minutes"]), F.lit(0)).cast("long").alias("event_minutes"))


def gmi(df: DataFrame, days: int = 14, apart_seconds: int = 30, coverage: float = 0.70, least: float = 20) -> DataFrame:
    """Glucose management indicator of the `days` days up to each day with readings.

    Readings closer than `apart_seconds` to the last one kept are passed over, one after the other in time; the
    sampling interval is the commonest gap of 1 to 60 minutes (the first seen of equally common ones); without
    enough coverage the value is null. Readings are copied to each day whose window holds them, then folded in
    order within the row of their day, whose size the window bounds."""
    g = _good(df, "bloodGlucoses").where(F.col("num") >= least)
    by = ["user_id", "source", "timezone"]
    have = g.select(*by, "day").distinct()
    spread = g.select(*by, F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day"), F.unix_micros("time").alias("t"), F.col("num").cast("double").alias("v"))
    rows = spread.join(have, [*by, "day"], "left_semi").groupBy(*by, "day").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("r"))
    kept = f"aggregate(r, cast(array() as array<struct<t:bigint,v:double>>), (a, x) -> if(size(a) = 0 or x.t - element_at(a, -1).t >= {apart_seconds * 1_000_000}, concat(a, array(x)), a))"
    rows = rows.withColumn("kept", F.expr(kept))
    gaps = "filter(transform(sequence(2, greatest(2, size(kept))), i -> cast(bround((element_at(kept, least(i, size(kept))).t - element_at(kept, i - 1).t) / 60000000D, 0) as int)), g -> g between 1 and 60)"
    rows = rows.withColumn("gaps", F.expr(f"if(size(kept) < 2, cast(array() as array<int>), {gaps})"))
    rows = rows.withColumn("interval", F.expr("try_element_at(transform(array_sort(transform(array_distinct(gaps), g -> struct(-size(filter(gaps, x -> x = g)) as n, array_position(gaps, g) as p, g as g))), x -> x.g), 1)"))
    mean = F.expr("aggregate(kept, 0D, (a, x) -> a + x.v) / size(kept)")
    covered = F.size("kept") * F.col("interval") / F.lit(days * 1440) >= coverage
    return rows.select("user_id", "source", "day", F.size("kept").cast("long").alias("kept"), F.col("interval").cast("long").alias("interval"), F.when(covered, F.bround(F.lit(3.31) + F.lit(0.02392) * mean, 2)).alias("gmi"))


def morning_jump(df: DataFrame) -> DataFrame:
    """The largest heart rate from 6:00 to 8:59 less the mean from 1:00 to 4:59, where that is positive."""
    g = _good(df, "heartRates").where(F.col("num").between(30, 220)).withColumn("h", F.hour("local_time"))
    out = g.groupBy("user_id", "day").agg(F.max(F.when(F.col("h").between(6, 8), F.col("num"))).alias("top"), F.avg(F.when(F.col("h").between(1, 4), F.col("num"))).alias("rest"))
    return out.where("top > rest").select("user_id", "day", F.round(F.col("top") - F.col("rest"), 2).cast("double").alias("jump"))


def night_resting(df: DataFrame, points: int = 5) -> DataFrame:
    """The tenth percentile of heart rates from 1:00 to 4:59, of at least `points` readings."""
    g = _good(df, "heartRates").where(F.col("num").between(30, 220) & F.hour("local_time").between(1, 4))
    return g.groupBy("user_id", "day").agg(F.round(F.percentile(F.col("num").cast("double"), F.lit(0.10)), 4).alias("resting"), F.count("*").alias("points")).where(F.col("points") >= points)


def sleep_onset(df: DataFrame, asleep: str = "oxygenSaturations", most_minutes: int = 120) -> DataFrame:
    """Minutes from the first in-bed reading of an 18:00 day to the first reading of `asleep` after it."""
    shift = F.expr("INTERVAL 18 HOURS")
    g = df.where(not_filtered(F.col("task_id")) & F.col("indicator").isin("sleepAnalysis_InBed", asleep)).withColumn("night", F.to_date(F.from_utc_timestamp("time", F.col("timezone")) - shift))
    w = Window.partitionBy("user_id", "night")
    g = g.withColumn("bed", F.min(F.when(F.col("indicator") == "sleepAnalysis_InBed", F.col("time"))).over(w))
    out = g.groupBy("user_id", "night").agg(F.first("bed").alias("bed"), F.min(F.when((F.col("indicator") == asleep) & (F.col("time") > F.col("bed")), F.col("time"))).alias("asleep"))
    minutes = (F.unix_micros("asleep") - F.unix_micros("bed")) / F.lit(60_000_000)
    return out.where((minutes > 0) & (minutes <= most_minutes)).select("user_id", "night", F.round(minutes, 2).alias("latency"))


def hypo_details(df: DataFrame, **kw) -> DataFrame:
    """The episodes of each day with glucose readings as JSON, [] without any."""
    days = _good(df, "bloodGlucoses").select(*KEYS).distinct()
    e = hypo_events(df, **kw).groupBy(*KEYS).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("at_time").alias("start"), "minutes", "nadir")))).alias("details"))
    return days.join(e, KEYS, "left").select("user_id", "source", "day", F.coalesce("details", F.lit("[]")).alias("details"))


def special_summaries(df: DataFrame) -> DataFrame:
    """Long summary rows (user_id, indicator, day, value as text) of the methods that aren't plain numbers of one grouping."""
    name = lambda method, of: F.concat(F.lit(registry.target(method, of) + "."), F.regexp_replace(F.coalesce("source", F.lit("unknown")), r"^vital\.", ""))
    glucose = df.where("indicator = 'bloodGlucoses'")
    times = daily.aggregate(glucose, ["time_of_max", "time_of_min"])
    hypo = hypo_summary(df)
    parts = [times.select("user_id", name(m, "bloodGlucoses").alias("indicator"), "day", F.col(m).alias("value")) for m in ("time_of_max", "time_of_min")]
    parts += [hypo.select("user_id", name(m, "bloodGlucoses").alias("indicator"), "day", F.col(c).cast("string").alias("value")) for m, c in (("hypo_event_count", "event_count"), ("hypo_event_times", "event_times"))]
    parts.append(hypo_details(df).select("user_id", name("hypo_event_details", "bloodGlucoses").alias("indicator"), "day", F.col("details").alias("value")))
    parts.append(gmi(df).select("user_id", name("gmi_14d", "bloodGlucoses").alias("indicator"), "day", F.col("gmi").cast("string").alias("value")))
    for method, of, found, day, value in (("morning_hr_jump", "heartRates", morning_jump(df), "day", "jump"), ("nighttime_resting_hr", "heartRates", night_resting(df), "day", "resting"), ("sleep_onset_latency", "sleepAnalysis_InBed", sleep_onset(df), "night", "latency")):
        parts.append(found.select("user_id", F.lit(registry.target(method, of)).alias("indicator"), F.col(day).alias("day"), F.round(value, 2).cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value is not null")
