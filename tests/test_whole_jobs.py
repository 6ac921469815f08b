"""Operators and queries that must do the whole job: nothing cut away by ids, sizes or inner joins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import derived, graph, insight, quality
from tidemark.plans import catalog


def test_token_bridges_reach_every_part(spark):
    rows = [(i, [f"w{i % 7}", f"x{i % 5}", f"y{i % 3}"][: 1 + i % 3]) for i in range(590, 660)]
    want = {(a, b) for a, s in rows for b, t in rows if a < b and min(len(s), len(t)) >= 2 and 2 * len({*s} & {*t}) >= max(len(s), len(t))}
    got = graph.token_bridge(spark.createDataFrame(rows, "id long, tokens array<string>"))
    assert {(r["a"], r["b"]) for r in got.collect()} == want and want


def test_whole_tables_are_read(spark):
    q = catalog.queries()
    suppliers = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert q["running_sum_peers"](spark, SF).select("l_suppkey").distinct().count() == suppliers
    ordered = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()
    assert q["set_operations"](spark, SF).where(F.col("kind") == "ordered").count() == ordered


def test_coverage_keeps_gaps(spark):
    rules = spark.createDataFrame([("a", "dailyAvgA", "x"), ("b", "dailyAvgB", "y")], "indicator string, target string, unit string")
    df = spark.createDataFrame([("u", "a"), ("v", "a"), ("v", "c")], "user_id string, indicator string")
    assert sorted(map(tuple, quality.coverage(df, rules).collect())) == [("a", "dailyAvgA", "x", 2, 2), ("b", "dailyAvgB", "y", 0, 0)]


def test_coverage_of_summaries_and_derived_indicators(spark):
    rules = spark.createDataFrame([("heartRates", "dailyMaxHeartRates", "x"), ("heartRates", "dailyMinHeartRates", "x")], "indicator string, target string, unit string")
    df = spark.createDataFrame([("u", "dailyMaxHeartRates.garmin"), ("v", "dailyMaxHeartRates.oura"), ("v", "dailyMaxHeartRates.oura")], "user_id string, indicator string")
    assert sorted(map(tuple, quality.observed_targets(df, rules).select("target", "observed", "rows").collect())) == [("dailyMaxHeartRates", "dailyMaxHeartRates.garmin,dailyMaxHeartRates.oura", 3), ("dailyMinHeartRates", "", 0)]
    got = {r["derived"]: (r["missing"], r["satisfied"]) for r in quality.derived_dependencies(df, derived.inputs_table(spark)).collect()}
    assert got["derivedHrRange"] == ("dailyMinHeartRates", False) and len(got) == len(derived.RULES)


TARGET = dt.date(2025, 3, 30)
DAILY = "user_id string, category string, day date, value double"


def days(spark, *series):
    """(user, category, values of the days up to the target)."""
    return spark.createDataFrame([(u, c, TARGET - dt.timedelta(days=len(v) - 1 - i), float(x)) for u, c, v in series for i, x in enumerate(v)], DAILY)


def test_trends_must_be_large_and_to_the_worse(spark):
    up, down, flat = [60 + i * 0.4 for i in range(29)], [80 - i * 0.4 for i in range(29)], [60 + i * 0.1 for i in range(29)]
    v = days(spark, ("up", "heartRate", up), ("down", "heartRate", down), ("flat", "heartRate", flat), ("noisy", "heartRate", up), ("other", "x", up), ("thin", "bodyFat", down))
    base = v.select("user_id", "category").distinct().withColumn("sigma", F.when(F.col("user_id") == "noisy", 10.0).otherwise(4.0))
    got = {r["user_id"]: (round(r["total"], 3), r["severity"]) for r in insight.trend_findings(v, base, str(TARGET)).collect()}
    assert got == {"up": (11.2, "moderate"), "thin": (-11.2, "mild")}


def test_weekday_pattern_needs_days_of_both_kinds(spark):
    # 30 March 2025 is a Sunday
    whole = [200 if (TARGET - dt.timedelta(days=28 - i)).weekday() >= 5 else 100 for i in range(29)]
    v = days(spark, ("a", "steps", whole), ("b", "steps", whole))
    v = v.where("user_id = 'a' or weekday(day) < 5 or day > date'2025-03-16'").where("user_id = 'a' or day <> date'2025-03-30'")
    assert v.where("user_id = 'b'").count() >= 20
    assert [r["user_id"] for r in insight.weekday_pattern(v, str(TARGET)).collect()] == ["a"]


def test_glucose_runs_up_to_the_target(spark):
    z = {"long": [0, 0, *[2.5] * 7], "short": [0, 0, 0, *[2.5] * 6], "over": [*[2.5] * 8, 0], "mild": [*[1.6] * 9]}
    dev = days(spark, *[(u, "bloodGlucose", v) for u, v in z.items()], ("steps", "steps", [3] * 9)).withColumn("z", F.col("value"))
    assert {r["user_id"]: (r["length"], r["severity"]) for r in insight.glucose(dev, str(TARGET)).collect()} == {"long": (7, "moderate"), "mild": (9, "mild")}


def test_gmi_needs_coverage(spark):
    """Days without enough coverage have no glucose indicator."""
    assert catalog.queries()["gmi_14d"](spark, SF).where("gmi is not null and kept * interval < 0.7 * 14 * 1440").count() == 0


def test_signals_together_and_sustained(spark):
    series = [("two", "heartRate", [0, 2.5, 3.2, 2.5]), ("two", "hrv", [-2.2] * 4), ("up", "hrv", [5] * 9), ("up", "heartRate", [5] * 9), ("apart", "heartRate", [2.5] * 3 + [0] * 3), ("apart", "spo2", [0] * 3 + [-2.5] * 3), ("weak", "heartRate", [1.9] * 9), ("weak", "hrv", [-1.9] * 9)]
    dev = days(spark, *series).withColumn("z", F.col("value")).withColumn("mean", F.lit(0.0))
    assert [(r["user_id"], r["signals"], r["run"], r["peak"], r["severity"]) for r in insight.multi_signal(dev, str(TARGET)).collect()] == [("two", 2, 3, 2.5, "mild")]
    series = [("one", "heartRate", [0, *[2.6] * 5]), ("short", "heartRate", [2.6] * 4), ("low", "hrv", [-3.1] * 6), ("chronic", "hrv", [3.0] * 20), ("worse", "hrv", [3.0] * 13 + [4.0] * 7), ("thin", "weight", [5.5] * 6), ("slow", "weight", [2.9] * 9)]
    dev = days(spark, *series).withColumn("z", F.col("value")).withColumn("mean", F.lit(0.0))
    got = {r["user_id"]: (r["run"], r["severity"]) for r in insight.single_sustained(dev, str(TARGET)).collect()}
    assert got == {"one": (5, "mild"), "low": (6, "moderate"), "worse": (20, "severe"), "thin": (6, "severe")}


def test_recovery(spark):
    fall = [0.0] * 5 + [8 - i * 0.4 for i in range(16)] + [1.0] * 2
    dev = days(spark, ("back", "heartRate", fall), ("still", "heartRate", [0, *[5.0] * 12]), ("hrv", "hrv", fall), ("calm", "heartRate", [1.0] * 30)).withColumn("z", F.col("value")).withColumn("sigma", F.lit(1.0))
    assert [(r["user_id"], r["peak"], r["now"], r["days"]) for r in insight.recovery(dev, str(TARGET)).collect()] == [("back", 8.0, 1.0, 18)]


def test_categories_take_the_first_alias(spark):
    rows = [("u", n) for n in ("heartRates", "dailyAvgHeartRates.oura", "dailyAvgHeartRates.apple_health", "stepsX", "dailyTotalSteps", "dailyTotalSteps.a", "weight")] + [("v", "heartRates.b")]
    got = {(r["user_id"], r["category"]): r["indicator"] for r in insight.resolve_categories(spark.createDataFrame(rows, "user_id string, indicator string")).collect()}
    assert got == {("u", "heartRate"): "dailyAvgHeartRates.apple_health", ("u", "steps"): "dailyTotalSteps", ("u", "weight"): "weight", ("v", "heartRate"): "heartRates.b"}


def test_tags_gates_and_cooldown(spark):
    base = spark.createDataFrame([("u", "bmi", 8, 29.0), ("u", "heartRate", 20, 95.0), ("w", "heartRate", 13, 40.0), ("x", "bloodGlucose", 9, 101.0)], "user_id string, category string, n long, mean double")
    assert sorted(map(tuple, insight.tags(base).collect())) == [("u", "cardiac_risk"), ("u", "obesity"), ("x", "pre_diabetes")]
    dense = spark.createDataFrame([("u", "heartRate", 15), ("w", "heartRate", 9)], "user_id string, category string, n long")
    got = {(r["user_id"], r["recipe"]) for r in insight.matched(base, dense).collect()}
    assert ("u", "recovery_trend") in got and ("w", "recovery_trend") not in got and ("x", "long_term_trend") in got
    v = days(spark, ("old", "steps", [1] * 9)).withColumn("day", F.date_sub("day", 8))
    assert insight.fresh(v, str(TARGET)).count() == 0 and insight.fresh(v, str(TARGET), 8).count() == 9
    found = spark.createDataFrame([("u", "recovery_trend", TARGET), ("u", "multi_signal_deterioration", TARGET)], "user_id string, recipe string, target date")
    past = spark.createDataFrame([("u", "recovery_trend", TARGET - dt.timedelta(days=6)), ("u", "multi_signal_deterioration", TARGET - dt.timedelta(days=3))], "user_id string, recipe string, target date")
    assert [r["recipe"] for r in insight.cooled_down(found, past).collect()] == ["multi_signal_deterioration"]


def test_sibling_expansion_counts_groups_larger_than_most(spark):
    r = random.Random(7)
    rows = [(g, f"m{i:02}") for g in "abcd" for i in range(30) if r.random() < 0.5]
    of = {}
    for g, m in rows:
        of.setdefault(m, set()).add(g)
    want = set()
    for a in of:
        near = sorted((1 if len(of[a] & of[b]) >= 2 else 2, b) for b in of if b != a and of[a] & of[b])
        want |= {(a, b, d) for d, b in near[:4]}
    got = graph.sibling_expansion(spark.createDataFrame(rows, "g string, m string"), "g", "m", 4).collect()
    assert {(x["a"], x["b"], x["distance"]) for x in got} == want and len(got) == len(want)
