"""Monitoring and data quality: each report is one pass over the readings or their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import base_indicator
from tidemark.sources.readings import FILTERED, not_filtered


def platform(source: Column) -> Column:
    """The platform that a source belongs to."""
    return F.when(source.isNull() | (source == ""), "other").when(source.startswith("vital."), "vital").when(source.startswith("theta."), "theta").when(source.startswith("apple_health"), "apple_health").when(source.isin("chat", "journal"), "app").when(source.contains(" "), "ehr").otherwise("other")


def hourly_ingestion(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", "time").alias("stat_hour"), "source").agg(F.count("*").alias("records"), F.countDistinct("user_id").alias("users"), F.countDistinct("indicator").alias("indicators"), F.count_if(F.col("task_id") == FILTERED).alias("filtered")).withColumn("platform", platform(F.col("source")))


def changed_hours(df: DataFrame, since: Column, oldest: Column) -> DataFrame:
    """Hours with a change since `since`, not older than `oldest`: the ones to profile anew."""
    return df.where((F.col("update_time") >= since) & (F.col("time") >= oldest)).select(F.date_trunc("hour", "time").alias("stat_hour")).distinct()


def flags(low: Column, high: Column, mean: Column, sigma: Column) -> Column:
    """The names of extreme values beyond ten standard deviations."""
    return F.array_compact(F.array(F.when((sigma > 0) & (high > mean + 10 * sigma), F.lit("suspicious_max")), F.when((sigma > 0) & (low < mean - 10 * sigma), F.lit("suspicious_min"))))


def health(n: Column) -> Column:
    return F.when(n == 0, "ok").when(n == 1, "warning").otherwise("critical")


MILLION = 1_000_000


def daily_profile(df: DataFrame) -> DataFrame:
    """A row for each day, indicator and source: counts, spread, percentiles, flags.

    Equal values are counted before the exact percentiles are taken, so a task keeps the different values of a day, which
    the resolution of an indicator bounds, however many users have them."""
    kept = F.when(not_filtered(F.col("task_id")), F.col("num"))
    by = [F.date_trunc("day", "time").alias("stat_date"), "indicator", "source"]
    counted = df.groupBy(*by, kept.alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col("num").isNull()).alias("no"), F.count_if(F.col("task_id") == FILTERED).alias("f"))
    # counts of equal values are taken apart into millions and the rest, so that products stay exact up to 10**13 readings
    v, c = F.col("v"), F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)
    x = v.cast("double")
    sums = [F.sum(c).alias("n"), F.sum("no").alias("non_numeric"), F.sum("f").alias("filtered"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum((v * c.cast("decimal(12,0)")).cast("decimal(30,2)")).alias("s1"), *[F.sum((v * v * part.cast("decimal(7,0)")).cast("decimal(38,4)")).alias(name) for name, part in (("s2", c % MILLION), ("s2m", F.floor(c / MILLION)))]]
    marks = (1, 5, 25, 50, 75, 95, 99)
    out = counted.groupBy("stat_date", "indicator", "source").agg(*sums, F.percentile(x, F.array(*[F.lit(q / 100) for q in marks]), F.when(v.isNotNull(), F.col("c")).otherwise(1)).alias("p"))
    n, s1 = F.col("n"), F.col("s1").cast("double")
    out = out.withColumn("mean", F.when(n > 0, s1 / n)).withColumn("sigma", F.when(n > 1, F.sqrt(F.greatest(F.col("s2").cast("double") + F.col("s2m").cast("double") * MILLION - s1 * s1 / n, F.lit(0.0)) / (n - 1))))
    out = out.select("stat_date", "indicator", "source", "n", "non_numeric", "filtered", "low", "high", "mean", "sigma", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{q}") for i, q in enumerate(marks)])
    issues = flags(F.col("low"), F.col("high"), F.col("mean"), F.col("sigma"))
    return out.withColumn("issues", F.array_join(issues, ",")).withColumn("health", health(F.size(issues))).withColumn("mean", F.round("mean", 3)).withColumn("sigma", F.round("sigma", 3))


def ingestion_stats(df: DataFrame) -> DataFrame:
    return df.withColumn("platform", platform(F.col("source"))).groupBy("platform").agg(F.count("*").alias("records"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.date_trunc("hour", "time")).alias("hours"))


def exclusion_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("indicator").agg(F.count("*").alias("total"), F.count_if(F.col("task_id") == FILTERED).alias("filtered")).withColumn("rate", F.round(F.col("filtered") / F.col("total") * 100, 4))


def cross_source_ratio(df: DataFrame, most: float = 100) -> DataFrame:
    """Indicators whose sources' largest values differ by more than a factor."""
    per = df.where(not_filtered(F.col("task_id"))).groupBy("indicator", "source").agg(F.max("num").cast("double").alias("top")).where("top > 0")
    out = per.groupBy("indicator").agg(F.count("*").alias("sources"), F.max_by("source", F.struct("top", "source")).alias("high_source"), F.min_by("source", F.struct("top", "source")).alias("low_source"), (F.max("top") / F.min("top")).alias("ratio"))
    return out.where("sources >= 2").select("indicator", "sources", "high_source", "low_source", F.round("ratio", 6).alias("ratio"), (F.col("ratio") > most).alias("issue"))


def week_over_week(df: DataFrame, as_of: Column) -> DataFrame:
    day = F.expr("INTERVAL 7 DAYS")
    now = (F.col("time") >= as_of - day) & (F.col("time") < as_of)
    before = (F.col("time") >= as_of - day - day) & (F.col("time") < as_of - day)
    out = df.withColumn("platform", platform(F.col("source"))).groupBy("platform").agg(F.count_if(now).alias("this_week"), F.count_if(before).alias("last_week"), F.countDistinct(F.when(now, F.col("user_id"))).alias("users_now"), F.countDistinct(F.when(before, F.col("user_id"))).alias("users_before"))
    return out.withColumn("change_pct", F.when(F.col("last_week") > 0, F.round((F.col("this_week") - F.col("last_week")) * 100.0 / F.col("last_week"), 1).cast("double")))


def silent_platforms(df: DataFrame, as_of: Column) -> DataFrame:
    """Platforms with records in the day before the last 24 hours, and none in them."""
    day = F.expr("INTERVAL 1 DAY")
    return df.withColumn("platform", platform(F.col("source"))).groupBy("platform").agg(F.count_if((F.col("time") >= as_of - day) & (F.col("time") < as_of)).alias("last_24h"), F.count_if((F.col("time") >= as_of - day - day) & (F.col("time") < as_of - day)).alias("prev_24h")).withColumn("silent", (F.col("prev_24h") > 0) & (F.col("last_24h") == 0))


def source_status(df: DataFrame, as_of: Column) -> DataFrame:
    week = df.where((F.col("time") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("time") < as_of))
    out = week.groupBy("source").agg(F.count("*").alias("records"), F.countDistinct(F.to_date("time")).alias("active_days"), F.max("time").alias("last"))
    hours = (F.unix_micros(as_of) - F.unix_micros("last")) / F.lit(3_600_000_000)
    return out.select("source", "records", "active_days", F.round(F.col("records") / F.greatest("active_days", F.lit(1)), 4).alias("avg_daily"), F.when(hours > 48, "stopped").when(hours > 24, "warning").otherwise("ok").alias("status"))


def source_share(df: DataFrame) -> DataFrame:
    n = df.groupBy("source", "indicator").agg(F.count("*").alias("records"))
    return n.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy("source")) * 100, 4))


def misclassified(df: DataFrame, most: int = 10, top: int = 20) -> DataFrame:
    """Indicators with more than `most` rows on some user's day: the report's `top` worst."""
    per = df.groupBy("indicator", "user_id", F.to_date("time").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return per.groupBy("indicator").agg(F.countDistinct("user_id").alias("users"), F.max("n").alias("max_per_day")).orderBy(F.desc("max_per_day"), "indicator").limit(top)


def name_clashes(df: DataFrame) -> DataFrame:
    """Names that differ in case only."""
    names = df.select("indicator").distinct()
    return names.groupBy(F.lower("indicator").alias("folded")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("indicator")), ",").alias("names")).where("n > 1")


def timestamp_quality(df: DataFrame, as_of: Column) -> DataFrame:
    return df.groupBy("source").agg(F.count_if(F.col("time") < F.lit("2010-01-01").cast("timestamp")).alias("too_old"), F.count_if(F.col("time") > as_of + F.expr("INTERVAL 48 HOURS")).alias("in_future"), F.count("*").alias("total"))


def user_profile(df: DataFrame, as_of: Column) -> DataFrame:
    """A row for each user and indicator: days, records, newest reading, spread, and how dense 14 days are."""
    g = df.where(not_filtered(F.col("task_id")))
    d = F.to_date("time")
    out = g.groupBy("user_id", "indicator").agg(F.countDistinct(d).alias("days"), F.count("*").alias("records"), F.max("time").alias("latest"), F.min("num").cast("double").alias("low"), F.max("num").cast("double").alias("high"), F.countDistinct(F.when(d > F.date_sub(F.to_date(as_of), 14), d)).alias("recent"))
    return out.withColumn("days_since", F.datediff(F.to_date(as_of), F.to_date("latest")).cast("long")).withColumn("density", F.when(F.col("recent") >= 11, "continuous").when(F.col("recent") >= 7, "intermittent").otherwise("sparse"))


def analyzable_pairs(profile: DataFrame, least_days: int = 14) -> DataFrame:
    """Pairs of a user's indicators that are dense enough to be compared, and whether both have enough days for it.

    Pairs of one base indicator and of two derived ones are left out; there are at most as many as the registry has pairs."""
    dense = profile.where(F.col("density").isin("continuous", "intermittent")).select("user_id", "indicator", "days", base_indicator(F.col("indicator")).alias("base"), F.col("indicator").startswith("derived").alias("derived"))
    a, b = dense.alias("a"), dense.alias("b")
    pairs = a.join(b, F.expr("a.user_id = b.user_id and a.indicator < b.indicator and a.base <> b.base and not (a.derived and b.derived)"))
    days = F.least("a.days", "b.days")
    return pairs.select(F.col("a.user_id").alias("user_id"), F.col("a.indicator").alias("first"), F.col("b.indicator").alias("second"), days.alias("days"), (days >= least_days).alias("sufficient"))


def coverage(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of the registry with the records that their source indicators have, 0 for gaps."""
    seen = df.groupBy("indicator").agg(F.count("*").alias("records"), F.countDistinct("user_id").alias("users"))
    # rules and counts both have a row for each name of the registry at most, so the counts are the side to send
    return rules.join(F.broadcast(seen.join(F.broadcast(rules.select("indicator").distinct()), "indicator", "left_semi")), "indicator", "left").select("indicator", "target", "unit", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("users", F.lit(0)).alias("users"))


def observed_targets(summaries: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of the registry with the names (target.source) that summaries (user_id, indicator) have of them, "" and 0 for none."""
    made = summaries.groupBy(F.substring_index("indicator", ".", 1).alias("target"), "indicator").agg(F.count("*").alias("n"))
    made = made.join(F.broadcast(rules.select("target")), "target", "left_semi").groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("indicator")), ",").alias("observed"), F.sum("n").alias("rows"))
    return rules.join(made, "target", "left").select(rules["indicator"], "target", F.coalesce("observed", F.lit("")).alias("observed"), F.coalesce("rows", F.lit(0)).alias("rows"))


def derived_dependencies(summaries: DataFrame, inputs: DataFrame) -> DataFrame:
    """Second-level indicators (derived, input) with the inputs that no summary has and whether all are there."""
    have = summaries.select(F.substring_index("indicator", ".", 1).alias("input")).distinct().withColumn("there", F.lit(True))
    out = inputs.join(have, "input", "left").groupBy("derived").agg(F.count("*").alias("inputs"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("input")))), ",").alias("missing"))
    return out.select("derived", "inputs", "missing", (F.col("missing") == "").alias("satisfied"))
