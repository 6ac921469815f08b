"""Packing, prefixes, abbreviations, custom rules, and caps that are gone, against plain versions."""

import datetime as dt
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions import registry, scalars
from tidemark.operators import concept_graph, daily, packing, quality, vectors
from tidemark.streaming import incremental


def plain_pack(costs, most):
    """Record by record: {place: chunk}."""
    out, used, chunk = {}, 0, None
    for i, c in enumerate(costs):
        if c > most:
            used, chunk = 0, None
            continue
        if chunk is None or used + c > most:
            used, chunk = 0, i
        used += c
        out[i] = chunk
    return out


@pytest.mark.parametrize(("most", "block"), [(10, 3), (25, 4096), (1, 2), (100, 7)])
def test_packing_is_the_greedy_fill(spark, most, block):
    r = random.Random(most)
    groups = {k: [r.choice([1, 2, 3, 5, 8, 13, 30, 120]) for _ in range(r.choice([0, 1, 2, 40, 300]))] for k in range(12)}
    groups |= {None: [3] * 50, 50: [1] * 200, 51: [most + 1] * 5, 52: [most] * 6, 53: [0, 0, 4, 0, 9, 0], 54: [2, most + 5, 2, 2]}
    rows = [(k, i, c or (None if i % 2 else 0), "x") for k, costs in groups.items() for i, c in enumerate(costs)]
    got = packing.pack(spark.createDataFrame(rows, "key long, place int, cost int, k string").repartition(3), "key", most, block)
    want = {(k, i, c) for k, costs in groups.items() for i, c in plain_pack(costs, most).items()}
    assert {(x["key"], x["place"], x["chunk"]) for x in got.collect()} == want and want


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "key string, place int, cost int"), "key", 5).count() == 0
    assert packing.budget(100, 10, 0) == 88 and packing.budget(100, 10, 5) == 81 and packing.budget(100) == 100


def plain_expanded(text):
    at = re.compile(r"\b(" + "|".join(map(re.escape, sorted(scalars.ABBREVIATIONS, key=len, reverse=True))) + r")\b")
    return at.sub(lambda m: f"{m[1]} ({scalars.ABBREVIATIONS[m[1]]})", text)


def test_abbreviations(spark):
    r = random.Random(1)
    bits = [*scalars.ABBREVIATIONS, "MRIs", "xCT", "CT_", "CT1", "é", "CTé", " ", " ", "-", ".", "(", "Ab Ag", "\n", "IgE,IgG", "$1", "\\", "|"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(300)] + ["", "MRA MR MRI", "CD (CD)", "CoA/CoV"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "i int, t string")
    got = {x["i"]: x["e"] for x in df.select("i", scalars.expanded(F.col("t")).alias("e")).collect()}
    assert got == {i: plain_expanded(t) for i, t in enumerate(texts)} | {9999: None}


def test_prefix_groups(spark):
    r = random.Random(2)
    names = [(i, " ".join(r.choices(["Red", "red", "blue", "cell", "count", "of"], k=r.randint(0, 5))) + r.choice(["", " [x]", "[Mass]  "])) for i in range(200)]
    names += [(7, names[7][1]), (8, "Another name of eight"), (None, "red cell"), (900, None), (901, "   "), (902, "unique words only")]
    of = {}
    for code, name in names:
        if code is not None and name is not None:
            w = name.split("[")[0].lower().split()
            of.setdefault(code, set()).update(" ".join(w[: k + 1]) for k in range(len(w)))
    count = Counter(p for ps in of.values() for p in ps)
    want = {}
    for code, ps in of.items():
        if good := [p for p in ps if count[p] >= 2 and p not in ("red", "blue cell")]:
            want[code] = max(good, key=lambda p: (len(p.split()), count[p], p))
    got = {x["code"]: (x["prefix"], x["words"], x["n"]) for x in concept_graph.prefix_groups(spark.createDataFrame(names, "code int, name string"), blocked=("red", "blue cell")).collect()}
    assert got == {c: (p, len(p.split()), count[p]) for c, p in want.items()}


def test_custom_rules_are_values(spark, tmp_path):
    """A caller's rule is in the registry's table, in summaries and in the stream, and nowhere else."""
    own = [registry.Custom("steps", "peak", "count", lambda num, time: F.max(num)), registry.Custom("steps", "total", "count", lambda num, time: F.sum(num) * 2), registry.Custom("moods", "morning_share", "%", lambda num, time: F.avg((F.hour(time) < 12).cast("double")), "dailyMorningMoods")]
    t = dt.datetime(2024, 5, 1, 10)
    rows = [("u", i, "s", t + dt.timedelta(hours=h), Decimal(v), "UTC", None, t) for i, h, v in (("steps", 0, 5), ("steps", 3, 7), ("moods", 0, 1), ("moods", 5, 3))]
    df = spark.createDataFrame(rows, incremental.READINGS)
    want = {("dailyPeakSteps.s", 7.0), ("dailyTotalSteps.s", 24.0), ("dailyMorningMoods.s", 0.5)}
    assert {(r["indicator"], r["value"]) for r in daily.summaries(df, own).collect()} == want
    assert {(r["indicator"], r["value"]) for r in daily.summaries(df).collect()} == {("dailyTotalSteps.s", 12.0)}
    table = {(r["indicator"], r["target"]) for r in registry.rules_table(spark, own).collect()}
    assert {("steps", "dailyPeakSteps"), ("moods", "dailyMorningMoods")} <= table and ("moods", "dailyMorningMoods") not in {(r["indicator"], r["target"]) for r in registry.rules_table(spark).collect()}
    rules = {r["target"]: r["records"] for r in quality.coverage(df, registry.rules_table(spark, own)).collect()}
    assert rules["dailyMorningMoods"] == 2
    kept, made = incremental.tables(spark, str(tmp_path))
    incremental.apply_batch(df, kept, made, own)
    assert {(r["indicator"], r["value"]) for r in made.rows().collect()} == want


def test_daily_profile_counts_beyond_a_hundred_million(spark):
    """Equal readings of a day more than eight digits can count."""
    t = dt.datetime(2024, 5, 1, 10)
    df = spark.range(200_000_000, numPartitions=8).select(F.lit("steps").alias("indicator"), F.lit("s").alias("source"), F.lit(t).alias("time"), (F.col("id") % 2 * 3).cast("decimal(14,2)").alias("num"), F.lit(None).cast("string").alias("task_id"))
    (r,) = quality.daily_profile(df.union(df.limit(1))).collect()
    assert r["n"] == 200_000_001 and r["mean"] == 1.5 and r["sigma"] == 1.5


def test_search_of_names_without_codes_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_QUERIES", 7)
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(60, 5)), rng.normal(size=(23, 5))
    rows = [(i % 70,) for i in range(150)] + [(None,)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)] + [(61, None), (62, [0.0] * 5)], "id long, vector array<double>")
    asked = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(q)] + [(99, None)], "query_id long, vector array<double>")
    got = {r["id"]: (r["n"], round(r["score"], 9)) for r in vectors.unmapped_search(spark.createDataFrame(rows, "id long"), df, asked, 0.3).collect()}
    cos = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    n = Counter(i for (i,) in rows)
    assert got == {i: (n[i], round(float(cos[i].max()), 9)) for i in range(60) if n[i] and cos[i].max() >= 0.3}
    assert vectors.unmapped_search(spark.createDataFrame(rows, "id long"), df, asked.where("1 = 0"), 0.3).count() == 0


def test_upserted_orders_have_every_order(spark):
    from tidemark.plans import catalog

    assert catalog.queries()["upsert_orders"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
