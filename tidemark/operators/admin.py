"""Lists and counts for administration and agents: statistics by source, windows, corrected values, newest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.readings import FILTERED

#: Sources that are no devices.
NO_DEVICES = ["chat", "journal"]


def source_group(source: Column) -> Column:
    """The name under which administration lists a source."""
    return F.when(source.contains("apple_health"), "apple_health").when(source.startswith("theta."), F.split_part(source, F.lit("."), F.lit(2))).when(source.contains("vital"), "vital").when(source.contains("resmed"), "resmed").otherwise(source)


def stats(df: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    """Records and the newest time of each source group and indicator in the last days."""
    recent = df.where(F.col("time") >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(source_group(F.col("source")).alias("source"), "indicator").agg(F.count("*").alias("records"), F.max("time").alias("latest"))


def window(df: DataFrame, start: Column, end: Column, indicators: list[str] | None = None, sources: list[str] | None = None, most_days: int = 7) -> DataFrame:
    """Readings of a window, of which at most `most_days` from its start are given, by indicators and sources if asked for."""
    out = df.where((F.col("time") >= start) & (F.col("time") < F.least(end, start + F.make_dt_interval(F.lit(most_days)))))
    if indicators:
        out = out.where(F.col("indicator").isin(indicators))
    return out.where(F.col("source").isin(sources)) if sources else out


def sources(df: DataFrame, top: int = 100) -> DataFrame:
    """Each user's sources with the most records: count, first and last time."""
    n = df.groupBy("user_id", "source").agg(F.count("*").alias("records"), F.min("time").alias("first"), F.max("time").alias("last"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("records"), "source"))).where(F.col("r") <= top).drop("r")


def fetch(df: DataFrame, corrections: DataFrame, limit: int) -> DataFrame:
    """The newest readings of each user and indicator, values and times as users corrected them (event_id, value, time)."""
    c = corrections.select("event_id", F.col("value").alias("_value"), F.col("time").alias("_time"))
    t = df.join(c, "event_id", "left").select("user_id", "indicator", "event_id", F.coalesce("_value", "value").alias("value"), F.coalesce("_time", "time").alias("time"))
    w = Window.partitionBy("user_id", "indicator").orderBy(F.desc("time"), F.desc("event_id"))
    return t.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def workspace(files: DataFrame) -> DataFrame:
    """Files of each workspace (workspace, text): how many, how many empty ones, characters in all."""
    return files.groupBy("workspace").agg(F.count("*").alias("files"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def newest(files: DataFrame) -> DataFrame:
    """The newest version of each file (file_key, time, version)."""
    w = Window.partitionBy("file_key").orderBy(F.desc("time"), F.desc("version"))
    return files.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def series_quality(df: DataFrame) -> DataFrame:
    """Extremes, guarded numbers and filtered rows of each indicator and device, and whether any is negative."""
    out = df.where(~F.col("source").isin(NO_DEVICES)).groupBy("indicator", "source").agg(F.min("num").cast("double").alias("low"), F.max("num").cast("double").alias("high"), F.count("num").alias("n"), F.count_if(F.col("task_id") == FILTERED).alias("filtered"))
    return out.withColumn("negative_value", F.col("low") < 0)


def derived_trend(summaries: DataFrame) -> DataFrame:
    """Records and indicators of second-level indicators by day."""
    return summaries.where(F.col("indicator").startswith("derived")).groupBy("day").agg(F.count("*").alias("records"), F.countDistinct("indicator").alias("indicators"))
