"""No step may gather what grows with the tables: in one task, in a broadcast, or in pairs that are shuffled."""

import contextlib
import datetime as dt
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import concept_graph, graph, insight, mapping, vectors
from tidemark.plans import catalog
from tidemark.sources import readings


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_users_are_dealt_out_before_they_are_multiplied(spark, monkeypatch):
    monkeypatch.setattr(readings, "USERS_OF_TASK", 20)
    v = readings.daily_values(spark, SF)
    users = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert v.rdd.getNumPartitions() >= users / 20
    assert v.select("user_id", F.spark_partition_id().alias("p")).distinct().count() == users


@pytest.mark.parametrize("name", ["insight_single_sustained", "insight_multi_signal", "insight_glucose", "insight_recovery", "insight_trend", "insight_trend_findings", "insight_weekday_pattern", "insight_weekday_steps", "insight_fresh", "insight_tags", "baselines_of_days"])
def test_values_of_a_user_stay_where_they_are(spark, name):
    p = plan(catalog.queries()[name](spark, SF))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1


def test_scored_days_are_those_of_the_join(spark):
    rows = [(u, "steps", dt.date(2024, 1, 1) + dt.timedelta(days=i), float((i * k) % 11)) for u, k in (("a", 3), ("b", 7)) for i in range(40)]
    v = spark.createDataFrame(rows, "user_id string, category string, day date, value double")
    base = insight.baselines(v)
    got, want = insight.scored(base), insight.deviations(v, base)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 80
    assert plan(got.where("z > 1")).count("lambda a") == plan(got).count("lambda a")
    assert sorted(map(tuple, insight.fresh_users(v, "2024-02-15").collect())) == [("a", 40), ("b", 40)] and insight.fresh_users(v, "2024-02-20").count() == 0


def above_join(df):
    """The plan above its topmost join."""
    return plan(df).split("Join")[0]


def test_shared_labels_are_given_with_the_first_group(spark):
    rows = [("g", "a", "x"), ("g", "b", "x"), ("h", "a", "y"), ("h", "b", "y"), ("h", "c", "y"), ("i", "a", "x"), ("i", "b", "x"), ("i", "c", "z"), (None, "a", "x"), (None, "d", "x")]
    out = graph.relations(spark.createDataFrame(rows, "g string, m string, label string"), "g", "m", "label")
    assert sorted(map(tuple, out.collect())) == [("a", "b", "x|y"), ("a", "c", "y"), ("b", "c", "y")]
    assert "Exchange" not in above_join(out)


def test_token_pairs_are_multiplied_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    rows = [(i, [["p", "q"], ["q", "p", "r"], ["p", "s"], ["u", "v"]][i % 4]) for i in range(40)]
    want = {(a, b) for a, s in rows for b, t in rows if a < b and 2 * len({*s} & {*t}) >= max(len(s), len(t))}
    out = graph.token_bridge(spark.createDataFrame(rows, "id long, tokens array<string>"))
    got = [(r["a"], r["b"]) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "Join" not in plan(out)


def test_crowded_positions_give_few_candidates(spark):
    rows = [("g", 100 + i % 3, i) for i in range(2000)] + [("g", 139, 3000), ("h", 100, 3001), ("g", 60, 3002), (None, 100, 3003)]
    points = spark.createDataFrame(rows, "grp string, position long, id long")
    asked = points.where("id in (0, 3000)")
    want = []
    for q in (0, 3000):
        at = dict((i, p) for _, p, i in rows)[q]
        near = sorted((abs(p - at), i) for g, p, i in rows if g == "g" and i not in (0, 3000) and abs(p - at) <= 40)[:5]
        want += [("g", q, i, d) for d, i in near]
    out = mapping.nearby(points, asked, 40, 5)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "collect_list" in plan(out)  # what is joined is an array of each bin, no pairs


def test_neighbours_are_given_with_the_first_shared_group(spark):
    groups = spark.createDataFrame([("size", "1", "a|b|c|d", None), ("type", "t", "a|b|e", None), ("cui", "k", "a|f", "b|g"), ("cui", "l", "b", "a|c")], "kind string, group string, left string, right string")
    codes = spark.createDataFrame([(c, i) for i, c in enumerate("abcdefg")], "code string, node long")
    out = concept_graph.neighbours(concept_graph.build(groups, codes), spark.createDataFrame([(0,), (1,), (9,)], "node long"))
    want = [(0, 1, True), (0, 2, False), (0, 3, False), (0, 4, False), (0, 6, True), (1, 0, True), (1, 2, True), (1, 3, False), (1, 4, False), (1, 5, True)]
    assert sorted(map(tuple, out.collect())) == want
    assert "Exchange" not in above_join(out)


def test_scores_of_few_vectors_are_held_at_once(spark):
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (1300, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "id long, vector array<double>, label int").coalesce(1)
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
    want = {(q, i) for q in range(20) for g in (0, 1) for i in sorted(range(g, 1300, 2), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:3]}
    got = vectors.top_k(df, df.where("id < 20").select(F.col("id").alias("query_id"), "vector"), 3, "label").collect()
    assert {(x["query_id"], x["id"]) for x in got} == want and len(got) == len(want)
    assert vectors.ROWS * vectors.MOST_QUERIES * 8 <= 2**24


def test_line_items_are_dealt_out_by_their_number(spark):
    p = plan(catalog.queries()["running_sum_peers"](spark, SF))
    assert "REPARTITION_BY_NUM" in p and p.count("Exchange") == 1


def waits_in_generated_code(df):
    """Of each multiplication above the topmost join, from the top, whether it is in generated code."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [bool(re.search(r"\*\(\d+\) Generate", x)) for x in above_join(df.select("*")).splitlines() if "Generate " in x]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_only_the_pairs_of_one_token_row_wait(spark):
    rows = [(i, [["p", "q"], ["q", "p", "r"]][i % 2]) for i in range(40)]
    assert waits_in_generated_code(graph.token_bridge(spark.createDataFrame(rows, "id long, tokens array<string>"))) == [True, False]


def test_blocks_of_a_class_are_paired_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    kept = []
    monkeypatch.setattr(graph, "written", lambda df, f=graph.written: kept.append(f(df)) or kept[-1])
    out = graph.token_bridge(spark.createDataFrame([(i, ["p", "q"]) for i in range(40)], "id long, tokens array<string>"))
    n = kept[0].count()
    assert n > 10 and kept[1].count() == n * (n + 1) // 2 and out.count() == out.distinct().count() == 40 * 39 // 2


def test_pairs_of_a_group_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    out = graph.relations(spark.createDataFrame([("g", f"m{i:03}", "x") for i in range(120)], "g string, m string, label string"), "g", "m", "label")
    assert waits_in_generated_code(out) == [True, False]
    of_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(of_task) == 120 * 119 // 2 and max(of_task) < sum(of_task) / 20


def test_members_of_one_and_of_several_groups_share_labels(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    r = random.Random(3)
    rows = [(g, f"m{i}", r.choice("xyz")) for i in range(60) for g in r.sample("abcdef", r.choice([1, 1, 2, 3]))]
    rows += rows[::7] + [("a", "m0", "y"), (None, "m1", "x"), ("b", None, "x"), ("c", "m2", None), ("w", "alone", "x")]
    of = {}
    for g, m, label in rows:
        if None not in (g, m, label):
            of.setdefault(m, set()).add((g, label))
    want = sorted((a, b, "|".join(sorted({label for _, label in of[a] & of[b]}))) for a in of for b in of if a < b and of[a] & of[b])
    out = graph.relations(spark.createDataFrame(rows, "g string, m string, label string"), "g", "m", "label")
    assert sorted(map(tuple, out.collect())) == want and len({x[2] for x in want}) > 3
