"""Second-level indicators: the best source of each input per user and day, pivoted once, then one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import registry
from tidemark.operators import daily

#: Rules: name to (inputs, formula over their columns). A null or negative input gives no value.
_ratio = lambda a, b: F.when(b > 0, a / b * 100)
_over = lambda a, b: F.when(a > b, a - b)
_capped = lambda x: F.when(x > 100, 100.0).otherwise(x)
RULES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "derivedSleepEfficiency": (("dailyTotalSleepAnalysis_Asleep(Total)", "dailyTotalSleepAnalysis_InBed"), lambda t, b: _capped(_ratio(t, b))),
    "derivedDeepSleepRatio": (("dailyTotalSleepAnalysis_Asleep(Deep)", "dailyTotalSleepAnalysis_Asleep(Total)"), _ratio),
    "derivedRemSleepRatio": (("dailyTotalSleepAnalysis_Asleep(REM)", "dailyTotalSleepAnalysis_Asleep(Total)"), _ratio),
    "derivedLightSleepRatio": (("dailyTotalSleepAnalysis_Asleep(Core)", "dailyTotalSleepAnalysis_Asleep(Total)"), _ratio),
    "derivedAwakeRatio": (("dailyTotalSleepAnalysis_Awake", "dailyTotalSleepAnalysis_Asleep(Total)"), lambda a, t: _ratio(a, a + t)),
    "derivedHrRange": (("dailyMaxHeartRates", "dailyMinHeartRates"), _over),
    "derivedHrReserve": (("dailyMaxHeartRates", "dailyAvgRestingHeartRates"), _over),
    "derivedWalkingHrElevation": (("dailyAvgWalkingHeartRates", "dailyAvgRestingHeartRates"), _over),
    "derivedStepEfficiency": (("dailyTotalWalkingRunningDistances", "dailyTotalSteps"), lambda d, s: F.when(s > 0, F.bround(d / s, 4))),
    "derivedActivityMinutesRatio": (("dailyTotalExerciseMinutes",), lambda m: m / 1440 * 100),
    "derivedBloodGlucoseCV": (("dailyStddevBloodGlucoses", "dailyAvgBloodGlucoses"), lambda s, a: _capped(_ratio(s, a))),
}


#: Older names of inputs, which come before all sources.
LEGACY = {
    "dailyTotalSleepAnalysis_Asleep(Total)": "daily_stats_sleepAnalysis_Asleep(Total)Sum", "dailyTotalSleepAnalysis_InBed": "daily_stats_sleepAnalysis_InBedSum", "dailyTotalSleepAnalysis_Asleep(Deep)": "daily_stats_sleepAnalysis_Asleep(Deep)Sum",
    "dailyTotalSleepAnalysis_Asleep(REM)": "daily_stats_sleepAnalysis_Asleep(REM)Sum", "dailyTotalSleepAnalysis_Asleep(Core)": "daily_stats_sleepAnalysis_Asleep(Core)Sum", "dailyTotalSleepAnalysis_Awake": "daily_stats_sleepAnalysis_AwakeSum",
    "dailyMaxHeartRates": "daily_stats_heartRatesMax", "dailyMinHeartRates": "daily_stats_heartRatesMin", "dailyAvgHeartRates": "daily_stats_heartRatesAvg", "dailyAvgRestingHeartRates": "daily_stats_restingHeartRatesAvg", "dailyAvgWalkingHeartRates": "daily_stats_walkingHeartRatesAvg",
    "dailyTotalSteps": "daily_stats_stepsSum", "dailyTotalWalkingRunningDistances": "daily_stats_walkingRunningDistancesSum", "dailyTotalExerciseMinutes": "daily_stats_exerciseMinutesSum", "dailyAvgHrvDatas": "daily_stats_hrvDatasAvg",
    "dailyAvgRespiratoryRates": "daily_stats_respiratoryRatesAvg", "dailyAvgOxygenSaturations": "daily_stats_oxygenSaturationsAvg", "dailyMinOxygenSaturations": "daily_stats_oxygenSaturationsMin",
}


def inputs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, i) for name, (names, _) in RULES.items() for i in names], "derived string, input string")


def priority(source: Column) -> Column:
    out = F.lit(999)
    for name, p in registry.SOURCE_PRIORITY.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def derive(summaries: DataFrame) -> DataFrame:
    """Rows (user_id, day, indicator, value) from summaries (user_id, day, target, source, value): an older name gives an
    input, else the source with the best priority, of equal ones the larger value; days without all inputs of a rule give
    none."""
    inputs = sorted({i for names, _ in RULES.values() for i in names})
    older = F.create_map(*[F.lit(x) for new, old in LEGACY.items() for x in (old, new)])
    named = F.try_element_at(older, F.col("target"))
    summaries = summaries.select("user_id", "day", F.coalesce(named, "target").alias("target"), "source", "value", F.when(named.isNotNull(), 0).otherwise(priority(F.col("source"))).alias("rank"))
    w = Window.partitionBy("user_id", "day", "target").orderBy("rank", F.desc("value"), "source")
    best = summaries.where(F.col("target").isin(inputs) & (F.col("value") >= 0)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    wide = best.groupBy("user_id", "day").pivot("target", inputs).agg(F.first("value"))
    made = F.array(*[F.struct(F.lit(name).alias("indicator"), F.round(formula(*[F.col(f"`{i}`") for i in names]), 2).alias("value")) for name, (names, formula) in RULES.items()])
    return wide.select("user_id", "day", F.explode(F.filter(made, lambda x: x["value"].isNotNull())).alias("r")).select("user_id", "day", "r.indicator", "r.value")


def from_readings(df: DataFrame) -> DataFrame:
    rules = [r for r in daily.plain_rules() if r[1] in ("avg", "max", "min", "total", "stddev")]
    wide = daily.aggregate(df, ["avg", "max", "min", "total", "stddev"])
    made = F.array(*[F.struct(F.lit(i).alias("of"), F.lit(t).alias("target"), F.col(m).alias("value")) for i, m, t in rules])
    # one source gives all inputs of an indicator's day, as the one of best priority
    return derive(wide.select("user_id", "day", "source", F.explode(F.filter(made, lambda x: x["of"] == F.col("indicator"))).alias("r")).select("user_id", "day", "source", "r.target", "r.value"))


def latest(df: DataFrame) -> DataFrame:
    """The newest reading of each user and indicator."""
    w = Window.partitionBy("user_id", "indicator").orderBy(F.desc("time"), F.desc("event_id"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("user_id", "indicator", "time", F.col("num").cast("double").alias("num"))
