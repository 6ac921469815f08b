"""Baselines as a stateful stream: each user's category keeps its days in the state store and is folded when one comes in.

The state of a key is its days within the lookback (day, value, time of the update), so it is bounded, late and corrected
days find their place, and the result is that of insight.baselines() over the same days, however the rows are cut into
batches and in whatever order they come. A timer drops keys that have sent nothing for as long as the lookback: what
they send afterwards has no old day within it. Time is when the engine met a row, so no row is late and none is lost.
Results go to a folder partitioned by batch, which a batch that runs again writes again, so a restart from the
checkpoint changes nothing.

Defined cases: of a day's values the one updated last counts, of those the largest; a row without a user, category, day or
value is passed over; keys of fewer than `least` days have no baseline; an empty stream gives none."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import insight
from tidemark.streaming.raw import batch_name

VALUES = "user_id string, category string, day date, value double, update_time timestamp"
RESULT = "user_id string, category string, n long, mean double, sigma double, frozen boolean, newest date"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOOKBACK = 91
_EPOCH, _DAY_MS = dt.date(1970, 1, 1), 86_400_000


def fold(values: list[float], alpha: float = 0.1, freeze_at: float = 2.0, freeze_after: int = 3, thaw_at: float = 1.0, thaw_after: int = 7) -> tuple[float, float, bool]:
    """Mean, deviation and whether it is frozen, of values in order of their days; as insight.baselines(), to the last bit,
    as whole numbers often lie exactly on a threshold."""
    early = values[: max(len(values) // 3, 7)]
    total = grown = m2 = 0.0  # sum, and mean and squared distance as they grow (Welford)
    for n, x in enumerate(early, 1):
        total += x
        away = x - grown
        grown += away / n
        m2 += away * (x - grown)
    mean, sigma = total / len(early), math.sqrt(m2 / len(early)) or 1.0
    frozen, away, near = False, 0, 0
    for x in values:
        z = abs(x - mean) / sigma
        if not frozen and z > freeze_at:
            away += 1
            frozen, near = away >= freeze_after, 0
        elif not frozen or (z <= thaw_at and near + 1 >= thaw_after):
            mean += alpha * (x - mean)
            frozen, away, near = False, 0, 0
        else:
            near = near + 1 if z <= thaw_at else 0
    return mean, sigma, frozen


class Baselines(StatefulProcessor):
    """State of a key: its days, as (day number, value, update in microseconds)."""

    def __init__(self, lookback: int, least: int):
        self.lookback, self.least = lookback, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", "day int, value double, stamp long")
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {d: (v, s) for d, v, s in self.days.get()} if self.days.exists() else {}
        before, met = dict(held), 0
        for pdf in rows:
            met = max(met, int(pdf["met"].astype("datetime64[ms]").astype("int64").max()))
            stamps = pdf["update_time"].astype("datetime64[us]").astype("int64").where(pdf["update_time"].notna(), -(2**63))
            for day, value, stamp in zip(pdf["day"], pdf["value"], stamps, strict=True):
                d = (day - _EPOCH).days
                new = (float(value), int(stamp))
                if d not in held or (new[1], new[0]) > (held[d][1], held[d][0]):
                    held[d] = new
        newest = max(held)
        held = {d: x for d, x in held.items() if d > newest - self.lookback}
        if not self.seen.exists():
            self.handle.registerTimer(met + self.lookback * _DAY_MS)
        self.seen.update((met,))
        if held != before:
            self.days.put([(d, *held[d]) for d in sorted(held)])
        if len(held) >= self.least:
            mean, sigma, frozen = fold([held[d][0] for d in sorted(held)])
            yield pd.DataFrame({"user_id": [key[0]], "category": [key[1]], "n": [len(held)], "mean": [mean], "sigma": [sigma], "frozen": [frozen], "newest": [_EPOCH + dt.timedelta(days=newest)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.seen.get()[0] + self.lookback * _DAY_MS
        if until <= timerValues.getCurrentWatermarkInMs():
            self.days.clear()
            self.seen.clear()
        else:
            self.handle.registerTimer(until)
        return iter(())

    def close(self) -> None:
        pass


def within(values: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(user_id, category, day, value): what the stream has in its state after all these rows, as a batch."""
    v = values.where("user_id is not null and category is not null and day is not null and value is not null")
    one = v.groupBy("user_id", "category", "day").agg(F.max_by("value", F.struct(F.col("update_time").isNotNull(), "update_time", "value")).alias("value"))
    newest = F.max("day").over(Window.partitionBy("user_id", "category"))
    return one.withColumn("newest", newest).where(F.col("day") > F.date_sub("newest", lookback)).drop("newest")


def updates(stream: DataFrame, lookback: int = LOOKBACK, least: int = 3) -> DataFrame:
    """The stream of baselines (RESULT) of the keys that a batch has rows of."""
    rows = stream.where("user_id is not null and category is not null and day is not null and value is not null")
    met = rows.withColumn("met", F.current_timestamp()).withWatermark("met", "0 seconds")
    return met.groupBy("user_id", "category").transformWithStateInPandas(statefulProcessor=Baselines(lookback, least), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")


def start(stream: DataFrame, folder: str, checkpoints: str, lookback: int = LOOKBACK, **trigger: object) -> StreamingQuery:
    """Keep the baselines below a folder up to date; trigger as of writeStream."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.current_timestamp()).withColumn("batch", F.lit(batch_name(batch, number))).write.option("partitionOverwriteMode", "dynamic").partitionBy("batch").mode("overwrite").parquet(folder)

    return updates(stream, lookback).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoints).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest baseline of each key below the folder."""
    rows = spark.read.schema(f"{RESULT}, at timestamp, batch string").parquet(folder)
    return rows.groupBy(*insight.KEY).agg(F.max_by(F.struct("n", "mean", "sigma", "frozen", "newest"), "at").alias("r")).select(*insight.KEY, "r.*")
