"""Scheduled runs of the aggregation with a durable cursor, a cold start, and the recomputation of long ranges.

A run looks for readings written since the cursor, recomputes their days whole, writes these days' summaries, and then
the cursor: the time of the newest reading that it has seen, to the microsecond, and how many readings had that time.
Days are recomputed from all of their readings, so a run that stops anywhere before its cursor is written is simply done
again by the next one: nothing is lost, and nothing counts twice. A reading that is written later with the very time of
the cursor is found by the count. A long range is done in chunks of days, and the cursor of its own says which are done."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.registry import Custom
from tidemark.operators import daily
from tidemark.session import checkpoint
from tidemark.streaming import incremental
from tidemark.streaming.incremental import Days

#: How far a run without a cursor looks back, and the days of a chunk of a range.
COLD_START, CHUNK_DAYS = dt.timedelta(days=1), 30
_CURSORS = "name string, run long, at timestamp, rows long"


class Cursors:
    """Cursors by name: a file is added for each step, the last one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, folder

    def last(self, name: str) -> tuple[int, dt.datetime, int] | None:
        """Number, time and rows of the last step, or None."""
        try:
            rows = self.spark.read.schema(_CURSORS).parquet(self.path)
            last = rows.where(F.col("name") == name).select(F.max(F.struct("run", "at", "rows")).alias("r")).first()["r"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return None if last is None else (last["run"], last["at"], last["rows"])

    def commit(self, name: str, at: dt.datetime, rows: int) -> None:
        before = self.last(name)
        self.spark.createDataFrame([(name, before[0] + 1 if before else 0, at, rows)], _CURSORS).coalesce(1).write.mode("append").parquet(self.path)


def run(readings: Days, summaries: Days, cursors: Cursors, now: dt.datetime, name: str = "daily", custom: Sequence[Custom] = ()) -> dict[str, object]:
    """Bring the summaries up to date. Returns mode (normal or cold_start), status (success or no_data), touched days and cursor."""
    last = cursors.last(name)
    since = last[1] if last else now - COLD_START
    seen = readings.rows().where(F.col("update_time") >= F.lit(since))
    top = seen.groupBy("update_time").agg(F.count("*").alias("n")).agg(F.max(F.struct("update_time", "n")).alias("r")).first()["r"]
    mode = "normal" if last else "cold_start"
    if top is None or (last and top["update_time"] == last[1] and top["n"] == last[2]):
        return {"mode": mode, "status": "no_data", "days": 0, "cursor": last[1] if last else None}
    touched = checkpoint(incremental.affected_days(seen))
    incremental.recompute(touched, readings, summaries, custom)
    cursors.commit(name, top["update_time"], top["n"])
    return {"mode": mode, "status": "success", "days": touched.count(), "cursor": top["update_time"]}


def chunks(first: dt.date, last: dt.date, days: int = CHUNK_DAYS) -> list[tuple[dt.date, dt.date]]:
    """The days from first to last, both included, in chunks of at most `days`, the earliest first."""
    out = []
    while first <= last:
        end = min(last, first + dt.timedelta(days=days - 1))
        out.append((first, end))
        first = end + dt.timedelta(days=1)
    return out


def of_days(readings: DataFrame, first: dt.date, last: dt.date, user: str | None = None) -> DataFrame:
    """The local days (user_id, indicator, source, timezone, day) from first to last that have readings."""
    days = daily.with_day(readings if user is None else readings.where(F.col("user_id") == user))
    return days.where(F.col("day").between(F.lit(first), F.lit(last))).select("user_id", "indicator", "source", "timezone", "day").distinct()


def recompute_range(readings: Days, summaries: Days, cursors: Cursors, first: dt.date, last: dt.date, user: str | None = None, days: int = CHUNK_DAYS) -> int:
    """Recompute the summaries of a range of local days; returns the number of chunks done.

    Called again after a crash with the same range and user, it goes on behind the last chunk that was finished; a range
    that was finished is done anew."""
    name = f"range {first} {last} {user or '*'}"
    plan = chunks(first, last, days)
    at = cursors.last(name)
    done = at[2] if at and at[2] < len(plan) else 0
    for k, (a, z) in enumerate(plan[done:], done + 1):
        # a local day lies within a day of the UTC day of its name, a night one more
        part = F.col("part").between(F.lit(a - dt.timedelta(days=1)), F.lit(z + dt.timedelta(days=2)))
        near = readings.read().where(part & F.col("time").isNotNull()).drop("part")
        touched = checkpoint(of_days(near, a, z, user))
        incremental.recompute(touched, readings, summaries)
        cursors.commit(name, dt.datetime.combine(z, dt.time()), k)
    return len(plan) - done
