"""Registries: indicators with their units and aggregation methods, names of summaries, categories, priorities."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession


@dataclass(frozen=True)
class Indicator:
    name: str
    unit: str
    methods: tuple[str, ...]
    kind: str = "SERIES"


#: Indicators with the methods by which their days are summarised.
GLUCOSE_METHODS = "avg max min last stddev time_of_max time_of_min tir_70_180 pct_below_70 pct_above_180 tir_70_140 pct_above_140 hypo_event_count hypo_event_times hypo_event_details gmi_14d".split()
INDICATORS = [
    Indicator("bloodGlucoses", "mg/dL", tuple(GLUCOSE_METHODS)), Indicator("heartRates", "count/min", ("avg", "max", "min", "morning_hr_jump", "nighttime_resting_hr")),
    *(Indicator(n, "count/min", ("avg", "min", "max")) for n in ("restingHeartRates", "walkingHeartRates")), Indicator("oxygenSaturations", "%", ("avg", "min", "max")), Indicator("walkingSpeeds", "m/s", ("avg", "max")),
    Indicator("hrvDatas", "ms", ("avg",)), Indicator("hrvRMSSD", "ms", ("avg",)), Indicator("respiratoryRates", "count/min", ("avg",)), Indicator("sleepEfficiency", "%", ("avg",)),
    Indicator("bodyMasss", "kg", ("last",)), Indicator("bmis", "count", ("last",)), Indicator("bodyFatPercentages", "%", ("last",)),
    Indicator("steps", "count", ("total",)), Indicator("floors", "count", ("total",)), Indicator("walkingRunningDistances", "m", ("total",)), Indicator("cyclingDistances", "m", ("total",)), Indicator("exerciseMinutes", "min", ("total",)), Indicator("activeCalories", "kcal", ("total",)), Indicator("basalCalories", "kcal", ("total",)), Indicator("waters", "L", ("total",)), Indicator("sleepDisturbances", "count", ("total",)),
    *(Indicator(f"sleepAnalysis_{s}", "ms", ("total",)) for s in ("Awake", "Asleep(Deep)", "Asleep(Core)", "Asleep(REM)", "Asleep(Total)")), Indicator("sleepAnalysis_InBed", "ms", ("total", "sleep_onset_latency")),
    *(Indicator(n, u, ("avg",), "MIX") for n, u in (("diastolicPressures", "mmHg"), ("systolicPressures", "mmHg"), ("bodyTemperatures", "degC"), ("vo2Maxs", "mL/kg/min"))),
]

#: Sources by priority, 1 the best; unknown ones have 999.
SOURCE_PRIORITY = {
    "vital.dexcom_v3": 1, "vital.abbott_libreview": 2, "vital.freestyle_libre": 3, "vital.omron": 4, "vital.ihealth": 5, "vital.withings": 6, "vital.renpho": 7, "vital.garmin": 8, "vital.polar": 9, "vital.whoop_v2": 10, "vital.fitbit": 11, "vital.oura": 12, "vital.ultrahuman": 13,
    "vital.eight_sleep": 14, "vital.beurer_api": 15, "vital.hammerhead": 16, "vital.wahoo": 17, "vital.zwift": 18, "vital.peloton": 19, "vital.cronometer": 20, "vital.my_fitness_pal_v2": 21, "resmed": 22, "vital.map_my_fitness": 22, "frontierx": 23, "apple_health": 99,
}


def target(method: str, indicator: str, period: str = "daily") -> str:
    """The summary's name: period, method in camel case, indicator; total and sum are both Total."""
    camel = "Total" if method in ("total", "sum") else "".join(p[:1].upper() + p[1:] for p in method.split("_"))
    return f"{period}{camel}{indicator[:1].upper()}{indicator[1:]}"


def threshold(method: str) -> tuple[str, float, float | None] | None:
    """(kind, bound, upper bound) of a method named for thresholds: pct_below_X, pct_above_X, tir_L_U."""
    if m := re.fullmatch(r"pct_(below|above)_(\d+(?:\.\d+)?)", method):
        return m[1], float(m[2]), None
    if m := re.fullmatch(r"tir_(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)", method):
        return "within", float(m[1]), float(m[2])
    return None


#: Units of methods whose result is no amount of the source's unit.
METHOD_UNITS = {"time_of_max": "HHMM", "time_of_min": "HHMM", "hypo_event_count": "count", "hypo_event_times": "HHMM[]", "hypo_event_details": "JSON", "gmi_14d": "%", "count": "count"}


def output_unit(method: str, unit: str) -> str:
    return METHOD_UNITS.get(method) or ("%" if threshold(method) else unit)


@dataclass(frozen=True)
class Custom:
    """A caller's rule: an aggregate of a day's numbers and times (columns) of an indicator, under its own method name."""

    indicator: str
    method: str
    unit: str
    column: Callable[[Column, Column], Column]
    target: str | None = None  # the summary's name, else made from method and indicator


def rules(include_mixed: bool = False, custom: Sequence[Custom] = ()) -> list[tuple[str, str, str, str]]:
    """(indicator, method, target, unit) for each summary that is made, the caller's own at the end.

    A custom rule of an indicator and method that the registry has takes its place; of two with the same the last counts."""
    own = {(c.indicator, c.method): (c.indicator, c.method, c.target or target(c.method, c.indicator), c.unit) for c in custom}
    made = [(i.name, m, target(m, i.name), output_unit(m, i.unit)) for i in INDICATORS if i.kind == "SERIES" or include_mixed for m in i.methods]
    return [r for r in made if r[:2] not in own] + [*own.values()]


def rules_table(spark: SparkSession, custom: Sequence[Custom] = ()) -> DataFrame:
    return spark.createDataFrame(rules(custom=custom), "indicator string, method string, target string, unit string")
