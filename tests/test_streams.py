"""Streams that keep state: any split into batches, restarts and crashes give what the batch operators give."""

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import daily, insight
from tidemark.plans import catalog
from tidemark.sources.readings import readings
from tidemark.streaming import baselines, incremental, raw, runs


def short(x):
    return float(f"{x:.9g}")


def rounded(df):
    return sorted((r["user_id"], r["category"], r["n"], short(r["mean"]), short(r["sigma"]), r["frozen"]) for r in df.collect())


def daily_rows(spark):
    """The events as values with an update time, some of them corrected later, some repeated."""
    r = readings(spark, SF).where("task_id is null")
    v = r.groupBy("user_id", F.col("indicator").alias("category"), F.to_date("time").alias("day")).agg(F.avg(F.col("num").cast("double")).alias("value"), F.max("update_time").alias("update_time"))
    rows = [tuple(x) for x in v.where("user_id < '3'").collect()]
    rows += [(u, c, d, x + 40, t + dt.timedelta(hours=5)) for u, c, d, x, t in rows[::5]] + rows[::7]
    return rows + [(None, "a", dt.date(2024, 1, 1), 1.0, None), ("u", None, dt.date(2024, 1, 1), 1.0, None), ("u", "a", None, 1.0, None), ("u", "a", dt.date(2024, 1, 1), None, None), *[("u", "a", dt.date(2024, 1, d), float(d), None) for d in range(1, 9)]]


@pytest.mark.parametrize("seed", range(2))
def test_streamed_baselines_are_the_batch_ones(spark, tmp_path, seed):
    """Shuffled rows in several batches, each after a restart from the checkpoint."""
    rows = daily_rows(spark)
    random.Random(seed).shuffle(rows)
    landing, folder, lookback = str(tmp_path / "in"), str(tmp_path / "out"), 20
    step = len(rows) // 3 + 1
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], baselines.VALUES).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(baselines.VALUES).parquet(landing)
        q = baselines.start(stream, folder, str(tmp_path / "cp"), lookback)
        assert q.awaitTermination(180) and q.exception() is None
    got = rounded(baselines.current(spark, folder))
    want = rounded(insight.baselines(baselines.within(spark.createDataFrame(rows, baselines.VALUES), lookback)))
    assert got == want and len(want) > 30
    q = baselines.start(spark.readStream.schema(baselines.VALUES).parquet(landing), folder, str(tmp_path / "cp"), lookback)
    assert q.awaitTermination(120) and rounded(baselines.current(spark, folder)) == got


def test_fold_freezes_and_thaws_like_the_batch(spark):
    r = random.Random(4)
    series = {f"u{i}": [r.gauss(0, 1) + (9 if 20 < d < 30 + i % 9 else 0) for d in range(5 + 3 * i)] for i in range(25)}
    series["flat"] = [2.0] * 30
    rows = [(u, "c", dt.date(2024, 1, 1) + dt.timedelta(days=d), x) for u, v in series.items() for d, x in enumerate(v)]
    want = {x["user_id"]: (short(x["mean"]), short(x["sigma"]), x["frozen"]) for x in insight.baselines(spark.createDataFrame(rows, "user_id string, category string, day date, value double")).collect()}
    got = {u: baselines.fold(v) for u, v in series.items()}
    assert {u: (short(m), short(s), f) for u, (m, s, f) in got.items()} == want and {f for _, _, f in got.values()} == {True, False}


def test_baselines_on_a_threshold_are_those_of_the_sql(spark, tmp_path):
    """Whole numbers with a deviation of 16, one of them just as far away, and a mean that ends in a 5 to be rounded."""
    series = [[1, 22, 47, 50, 46, 41, 20, 37, 33, 47, 16, 9, 35, 43, 18, 27, 2, 25, 6, 34, 32, 12, 13, 37, 40, 1], [47, 50, 37, 36, 29, 46, 49, 17, 14, 10, 2, 35, 8, 32, 27, 22, 36, 7, 18, 7, 47, 45]]
    rows = [(1, u, d % 7 + 1, float(x), "R", dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for u, values in enumerate(series) for d, x in enumerate(values)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalog.queries()["streamed_baselines"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(got) == sorted(db.sql(catalog.oracle_sql()["streamed_baselines"]).fetchall()) and len(got) == 2


RAW = "msg_id string, received timestamp, payload string, user_id string"


def test_messages_are_stored_once(spark, tmp_path):
    """Events as messages in shuffled overlapping batches; the state is lost in between, as after the horizon."""
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.concat(F.lit("m"), F.col("event_id") % 700).alias("msg_id"), F.col("ts").cast("timestamp").alias("received"), F.to_json(F.struct("event_type", "value")).alias("payload"), F.col("user_id").cast("string").alias("user_id"))
    rows = [tuple(x) for x in e.collect()]
    random.Random(1).shuffle(rows)
    rows = rows[:900] + [(None, dt.datetime(2024, 1, 1), "no name", "u")] * 2
    landing, folder = str(tmp_path / "in"), str(tmp_path / "store")
    store = raw.Messages(spark, folder, RAW, buckets=4)
    for k, (a, b, checkpoint) in enumerate([(0, 500, "one"), (300, 902, "one"), (0, 902, "later")]):
        spark.createDataFrame(rows[a:b], RAW).coalesce(2).write.mode("append").parquet(f"{landing}{checkpoint}")
        # "later" is a new stream: nothing of the keyed state is left, only the stored names
        q = raw.start(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(f"{landing}{checkpoint}"), store, str(tmp_path / checkpoint))
        assert q.awaitTermination(180) and q.exception() is None
        if k == 0:
            first = {r["msg_id"]: r["payload"] for r in store.stored().collect()}
    got = store.stored().collect()
    assert len(got) == len({r["msg_id"] for r in got}) == len({m for m, *_ in rows if m})
    assert {r["msg_id"]: r["payload"] for r in got}.items() >= first.items()
    assert {r["payload"] for r in store.rejected().collect()} == {"no name"}


def test_a_batch_that_runs_again_stores_the_same(spark, tmp_path):
    store = raw.Messages(spark, str(tmp_path), RAW, buckets=3)
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batch = spark.createDataFrame([("a", at(2), "second", "u"), ("a", at(1), "first", "u"), ("a", None, "timeless", "u"), ("b", at(1), "b", "v"), (None, at(1), "x", "v")], RAW)
    for _ in range(2):
        store.add(batch, 0)
    store.add(batch, 1)
    store.add(batch.where("1 = 0"), 2)
    assert {(r["msg_id"], r["payload"]) for r in store.stored().collect()} == {("a", "first"), ("b", "b")} and store.stored().count() == 2


def reading(user, indicator, text, num, updated):
    return (user, indicator, "apple_health", dt.datetime.fromisoformat(text), Decimal(num), "UTC", None, dt.datetime.fromisoformat(updated))


def tables_with(spark, folder, rows):
    kept, made = incremental.tables(spark, folder)
    add(spark, kept, rows)
    return kept, made


def add(spark, kept, rows):
    df = spark.createDataFrame(rows, incremental.READINGS)
    days = df.select(F.to_date("time").alias("part")).distinct()
    kept.replace(days, kept.of(days).where("time is not null").select(*df.columns).unionByName(df))


def made_now(summaries):
    return sorted((r["user_id"], r["indicator"], str(r["start_time"]), round(r["value"], 6)) for r in summaries.rows().where("value is not null").collect())


def all_at_once(spark, kept):
    s = daily.summaries(kept.rows()).where("value is not null")
    return sorted((r["user_id"], r["indicator"], str(r["start_time"]), round(float(r["value"]), 6)) for r in s.collect())


ROWS = [reading("u", "steps", f"2024-03-{d:02} 10:00:00", d * 100, f"2024-03-{d:02} 10:00:00.250001") for d in range(1, 29)] + [reading("v", "heartRates", f"2024-03-{d:02} 0{h}:00:00", 60 + h, f"2024-03-28 10:00:0{h}") for d in (3, 4) for h in range(1, 5)]


def test_runs_go_on_from_the_cursor(spark, tmp_path):
    kept, made = tables_with(spark, str(tmp_path / "t"), ROWS)
    cursors = runs.Cursors(spark, str(tmp_path / "cursors"))
    now = dt.datetime(2024, 3, 28, 12)
    first = runs.run(kept, made, cursors, now)
    # without a cursor only what was written in the last day counts
    assert first["mode"] == "cold_start" and first["cursor"] == dt.datetime(2024, 3, 28, 10, 0, 4) and {r[0] for r in made_now(made)} == {"u", "v"}
    assert {r[2][:10] for r in made_now(made) if r[0] == "u"} == {"2024-03-28"}
    assert runs.run(kept, made, cursors, now)["status"] == "no_data"
    # a reading with the very microsecond of the cursor, and a later one of an old day
    add(spark, kept, [reading("w", "steps", "2024-03-05 10:00:00", 7, "2024-03-28 10:00:04"), reading("u", "steps", "2024-03-01 11:00:00", 5, "2024-03-28 10:00:04.000001")])
    second = runs.run(kept, made, cursors, now)
    assert (second["mode"], second["status"], second["cursor"].microsecond) == ("normal", "success", 1)
    assert {r for r in made_now(made) if r[0] == "w"} == {r for r in all_at_once(spark, kept) if r[0] == "w"} != set()
    assert runs.run(kept, made, cursors, now)["status"] == "no_data"


def test_a_crash_before_the_cursor_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    kept, made = tables_with(spark, str(tmp_path / "t"), ROWS)
    cursors, now = runs.Cursors(spark, str(tmp_path / "cursors")), dt.datetime(2024, 3, 1, 12)
    commit = runs.Cursors.commit
    with monkeypatch.context() as m:
        m.setattr(runs.Cursors, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            runs.run(kept, made, cursors, now)
    assert cursors.last("daily") is None and runs.Cursors.commit is commit
    before = made_now(made)
    assert runs.run(kept, made, cursors, now)["status"] == "success"
    assert before == made_now(made) == all_at_once(spark, kept)


def test_a_range_is_recomputed_in_chunks_and_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    assert runs.chunks(dt.date(2024, 1, 1), dt.date(2024, 3, 1)) == [(dt.date(2024, 1, 1), dt.date(2024, 1, 30)), (dt.date(2024, 1, 31), dt.date(2024, 2, 29)), (dt.date(2024, 3, 1), dt.date(2024, 3, 1))]
    assert runs.chunks(dt.date(2024, 1, 2), dt.date(2024, 1, 1)) == []
    kept, made = tables_with(spark, str(tmp_path / "t"), ROWS)
    cursors = runs.Cursors(spark, str(tmp_path / "cursors"))
    span, done = (dt.date(2024, 3, 1), dt.date(2024, 3, 28)), []
    recompute = incremental.recompute

    def once(touched, *tables):
        done.append(touched.count())
        if len(done) == 2:
            raise RuntimeError("lost")
        recompute(touched, *tables)

    monkeypatch.setattr(incremental, "recompute", once)
    with pytest.raises(RuntimeError):
        runs.recompute_range(kept, made, cursors, *span, days=10)
    assert runs.recompute_range(kept, made, cursors, *span, days=10) == 2 and len(done) == 4
    assert made_now(made) == all_at_once(spark, kept)
    assert runs.recompute_range(kept, made, cursors, *span, user="v", days=10) == 3 and made_now(made) == all_at_once(spark, kept)
