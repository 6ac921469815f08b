"""Incremental aggregation as a stream: late rows recompute their days, and sinks are merges by natural keys.

There is no watermark: a row of any age triggers its day again, as it must not be dropped. Readings and summaries are
Parquet folders partitioned by day. A micro-batch merges its readings into the partitions of their UTC days,
recomputes the local days that they touch from the partitions around them, and writes only the partitions of those
days again. A batch that is run again changes nothing, so a restart from the checkpoint is safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.registry import Custom
from tidemark.operators import daily, mapping
from tidemark.session import checkpoint

READING_KEYS = ["user_id", "indicator", "source", "time"]
SUMMARY_KEYS = ["user_id", "indicator", "start_time", "end_time"]
READINGS = "user_id string, indicator string, source string, time timestamp, num decimal(14,2), timezone string, task_id string, update_time timestamp"
SUMMARIES = "user_id string, indicator string, start_time timestamp, end_time timestamp, value double"
_PART = "part"


class Days:
    """A Parquet folder partitioned by the day of a column."""

    def __init__(self, spark: SparkSession, path: str, schema: str, day: str):
        self.spark, self.path, self.schema, self.day = spark, path, schema, day
        try:
            self.read().schema
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            spark.createDataFrame([], schema).withColumn(_PART, F.to_date(day)).write.partitionBy(_PART).parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {_PART} date").parquet(self.path)

    def of(self, days: DataFrame) -> DataFrame:
        """The rows of the partitions of some days (part); the join prunes partitions as it runs."""
        return self.read().join(F.broadcast(days.select(_PART).distinct()), _PART, "left_semi").drop(_PART)

    def replace(self, days: DataFrame, rows: DataFrame) -> None:
        """Write the partitions of the days (part) anew; a day that has no rows left keeps an empty one."""
        rows = checkpoint(rows.withColumn(_PART, F.to_date(self.day)))
        left = days.select(_PART).distinct().join(rows.select(_PART).distinct(), _PART, "left_anti")
        if not left.isEmpty():
            # dynamic overwrite leaves partitions without new rows alone, so an empty day gets a row that readers pass over
            rows = rows.unionByName(left, allowMissingColumns=True)
        rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(_PART).mode("overwrite").parquet(self.path)

    def rows(self) -> DataFrame:
        """All rows, without the marks of empty days."""
        return self.read().where(F.col(self.day).isNotNull()).drop(_PART)


def affected_days(batch: DataFrame) -> DataFrame:
    return daily.with_day(batch).select("user_id", "indicator", "source", "timezone", "day").distinct()


def apply_batch(batch: DataFrame, readings: Days, summaries: Days, custom: Sequence[Custom] = ()) -> None:
    values = ["num", "timezone", "task_id"]
    batch = checkpoint(batch.select(*READING_KEYS, *values, "update_time"))
    written = batch.select(F.to_date("time").alias(_PART)).distinct()
    old = readings.of(written).where("time is not null")
    readings.replace(written, mapping.upsert(old, batch, READING_KEYS, values, order="update_time", stamp="update_time"))
    recompute(checkpoint(affected_days(batch)), readings, summaries, custom)


def recompute(touched: DataFrame, readings: Days, summaries: Days, custom: Sequence[Custom] = ()) -> None:
    """Make the summaries of some days (user_id, indicator, source, timezone, day) anew from all of their readings."""
    # a local day lies within a day of the UTC day of its name, on either side, a night one more
    around = touched.select(F.explode(F.sequence(F.date_sub("day", 1), F.date_add("day", 2))).alias(_PART)).distinct()
    now = daily.with_day(readings.of(around).where("time is not null"))
    fresh = daily.summaries(now.join(touched, ["user_id", "indicator", "source", "timezone", "day"], "left_semi").drop("day", "local_time", "day_start_utc"), custom)
    days = touched.select(F.col("day").alias(_PART)).distinct()
    # every summary of a touched day is made again or has no readings left, so the old ones of its indicator and source go
    rules = touched.sparkSession.createDataFrame([(i, t) for i, _, t in daily.plain_rules(custom)], "indicator string, target string")
    gone = touched.join(F.broadcast(rules), "indicator").select("user_id", F.concat("target", F.lit("."), F.regexp_replace(F.coalesce("source", F.lit("unknown")), r"^vital\.", "")).alias("indicator"), F.col("day").cast("timestamp").alias("start_time")).distinct()
    kept = summaries.of(days).where("start_time is not null").join(gone, ["user_id", "indicator", "start_time"], "left_anti").select(*SUMMARY_KEYS, "value")
    summaries.replace(days, kept.unionByName(fresh.select(*SUMMARY_KEYS, "value")))


def start(stream: DataFrame, readings: Days, summaries: Days, checkpoints: str, custom: Sequence[Custom] = (), **trigger: object) -> StreamingQuery:
    """Run the stream of readings; trigger as of writeStream (availableNow, processingTime); custom: rules of the caller."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, readings, summaries, custom)).option("checkpointLocation", checkpoints).trigger(**(trigger or {"availableNow": True})).start()


def tables(spark: SparkSession, folder: str) -> tuple[Days, Days]:
    """The readings and summaries below a folder."""
    return Days(spark, f"{folder}/readings", READINGS, "time"), Days(spark, f"{folder}/summaries", SUMMARIES, "start_time")
