import pandas as pd
from pyspark.sql import functions as F

from quire.plans import stream_queries
from quire.streaming import activity

SMALL = "/root/testdata/sf0.001"


def by_loop(rows, end, seconds=300.0):
    """(key, position, time) of saves, those of timers up to ``end`` (seconds) too, of (key, time, position) in order."""
    states, want = {}, []

    def due(u, now):
        states[u], at = activity.debounce_due(states.get(u), now, seconds)
        if at is not None:
            want.append((u, states[u][0], round(at * 1e6)))

    for u, ts, position in rows:
        due(u, ts)
        states[u], save = activity.debounce_step(states.get(u), ts, position, seconds=seconds)
        if save:
            want.append((u, position, round(ts * 1e6)))
    for u in states:
        due(u, end)
    return sorted(want)


def micros(ts):
    return round(pd.Timestamp(ts).timestamp() * 1e6)


def test_debounced_equals_loop(spark):
    got = sorted((r["user_id"], r["position"], micros(r["ts"])) for r in stream_queries.stream_debounced(spark, SMALL).collect())
    e = pd.read_parquet(f"{SMALL}/events.parquet").sort_values(["ts", "event_id"])
    rows = [(u, ts.timestamp(), i % 7) for u, ts, i in zip(e["user_id"], e["ts"], e["event_id"], strict=True)]
    end = int(max(r[1] for r in rows) * 1000) / 1000
    assert got == by_loop(rows, end) and got


def stream_of(spark, folder, batches):
    """A stream that reads a batch of (user_id, seconds, position) a trigger."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(u, float(t), p, n) for n, (u, t, p) in enumerate(rows)], "user_id bigint, t double, position bigint, event_id bigint")
        df.select("user_id", F.timestamp_seconds("t").alias("ts"), "position", "event_id", F.lit(5).alias("x")).coalesce(1).write.parquet(f"{folder}/{i}.parquet")
    schema = "user_id bigint, ts timestamp, position bigint, event_id bigint, x int"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(df, folder, mode="append"):
    """(rows by batch, states held at the end)"""
    rows = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: rows.append([tuple(r) for r in b.collect()])).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows, q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_a_silent_reader_is_saved_by_the_timer(spark, tmp_path):
    batches = [[(1, 1000, 1), (1, 1010, 2)], [(2, 1400, 1)], [(2, 1500, 1)], [(2, 200_000, 1)], [(2, 200_001, 1)]]
    rows, states = run(activity.debounced(stream_of(spark, tmp_path / "in", batches)), tmp_path / "s")
    assert [(u, p, micros(ts)) for b in rows for u, ts, p in b] == [(1, 2, 1_300_000_000)]  # 300 s after it was first seen, no event of its own
    assert states == 1  # reader 1, silent for a day, is let go


def test_idle_readers_leave_no_pace(spark, tmp_path):
    batches = [[(1, 1000, 0), (2, 1000, 0)], [(2, 5000, 0)], [(2, 5001, 0)]]
    events = stream_of(spark, tmp_path / "in", batches).withWatermark("ts", "0 seconds")
    rows, states = run(activity.pace(events, idle=600), tmp_path / "s", "update")
    assert states == 1 and {r[0]: r[2] for b in rows for r in b} == {1: 1, 2: 3}
    rows, states = run(activity.pace(stream_of(spark, tmp_path / "again", batches)), tmp_path / "t", "update")
    assert states == 2


def test_debounce_steps():
    s, save = activity.debounce_step(None, 0, 1)
    assert not save
    for i in range(9):
        s, save = activity.debounce_step(s, 1, i % 2)
        assert not save or i == 9
    s, save = activity.debounce_step(s, 2, 7)
    assert save
    s, save = activity.debounce_step(s, 303, 7)
    assert not save  # nothing changed
    s, save = activity.debounce_step(s, 304, 8)
    assert save


def test_checkpoint_due(spark):
    df = spark.sql("select * from values (4, 9, 0, false), (5, 8, 0, false), (5, 1, 524288, false), (0, 0, 0, true) t(s, p, z, f)")
    assert [r[0] for r in df.select(activity.checkpoint_due(F.col("s"), F.col("p"), F.col("z"), F.col("f"))).collect()] == [False, True, True, True]
