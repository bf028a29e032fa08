"""Stateful streams over reading events: debounced saving, paces, time buckets, day sets with late data.

All work on any streaming DataFrame and give the same rows as their batch forms. State is kept by reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators import activity


def fold_pace(avg: int, n: int, x: int, weight: int = 1000, most: int = 65535) -> tuple[int, int]:
    """One step of the capped running average."""
    if x <= 0:
        return avg, n
    w = min(n, weight)
    return (avg * w + min(x, most)) // (w + 1), n + 1


def pace(events: DataFrame, key: str = "user_id", idle: float | None = None) -> DataFrame:
    """(key, avg, n) after each batch that holds events (key, ts, event_id, x) of the key; nulls of x or ts are left out.

    With ``idle``, events have a watermark on ts, and the state of a key without events for so many seconds is let go.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        avg, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x in rows["x"].tolist():
            avg, n = fold_pace(int(avg), int(n), int(x))
        state.update((avg, n))
        if idle is not None:
            _wake(state, rows["ts"].iloc[-1].timestamp() + idle)
        yield pd.DataFrame({key: [k[0]], "avg": [avg], "n": [n]})

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    known = events.where("ts is not null and x is not null")
    return known.groupBy(key).applyInPandasWithState(step, f"{key} bigint, avg bigint, n bigint", "avg bigint, n bigint", "update", timeout)


def _wake(state: GroupState, at: float) -> None:
    """Calls for the state's key again once the watermark passes a time (seconds), or as soon as can be."""
    state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs() + 1))


def debounce_step(state: tuple | None, ts: float, position: int, changes: int = 10, seconds: float = 300.0) -> tuple[tuple, bool]:
    """State (last position, changes since the last save, time of it) and whether to save now; the first sight never does."""
    if state is None:
        return (position, 0, ts), False
    last, n, saved = state
    n += position != last
    if n >= changes or n and ts - saved >= seconds:
        return (position, 0, ts), True
    return (position, n, saved), False


def debounce_due(state: tuple | None, now: float, seconds: float = 300.0) -> tuple[tuple | None, float | None]:
    """State and the time of the save that falls due by ``now`` without an event, if any does."""
    if state is None or not state[1] or now < state[2] + seconds:
        return state, None
    return (state[0], 0, state[2] + seconds), state[2] + seconds


def debounced(events: DataFrame, key: str = "user_id", changes: int = 10, seconds: float = 300.0, late: str = "0 seconds", idle: float = 86_400.0) -> DataFrame:
    """(key, ts, position) to save: after ``changes`` changes of position, or ``seconds`` after the last save, without a further event too.

    What is pending is saved once the watermark (the newest event of any key less ``late``) has passed its time; a key without
    events for ``idle`` seconds more has no state. Events without a time or position are left out.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, seen = state.get if state.exists else (None, 0.0)
        held, out = tuple(held) if state.exists else None, []

        def due(now: float) -> None:
            nonlocal held
            held, at = debounce_due(held, now, seconds)
            if at is not None:
                out.append((k[0], pd.Timestamp(round(at * 1e6), unit="us"), int(held[0])))

        if state.hasTimedOut:
            pending = held[1]
            due(state.getCurrentWatermarkMs() / 1000)
            if not pending:
                state.remove()
                held = None
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            seen = max(seen, rows["ts"].iloc[-1].timestamp())
            for ts, position in zip(rows["ts"], rows["position"].tolist(), strict=True):
                due(ts.timestamp())
                held, save = debounce_step(held, ts.timestamp(), int(position), changes, seconds)
                if save:
                    out.append((k[0], ts, int(position)))
        if held is not None:
            state.update((*held, seen))
            _wake(state, held[2] + seconds if held[1] else seen + idle)
        yield pd.DataFrame(out, columns=[key, "ts", "position"])

    timed = events.where("ts is not null and position is not null").withWatermark("ts", late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} bigint, ts timestamp, position bigint", "position bigint, n bigint, saved double, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def buckets(spans: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, bucket, weekday, seconds): running sums over spans (key, ts, seconds) cut at the times of day."""
    parts = activity.split_spans(spans)
    return parts.groupBy(key, "bucket", "weekday").agg(F.round(F.sum("part"), 3).alias("seconds"), F.count("*").alias("parts"))


def day_sets(events: DataFrame, key: str = "user_id", late: str = "730 days") -> DataFrame:
    """Distinct (key, day); a day older than the history behind the newest is late and dropped."""
    marked = events.withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp"))).withWatermark("day", late)
    return marked.dropDuplicates([key, "day"]).select(key, F.col("day").cast("date").alias("day"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions cut at gaps (our own addition), with late events up to ``late``."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("end"), "events")


def checkpoint_due(seconds: Column, pages: Column, size: Column, forced: Column) -> Column:
    """Whether to write a checkpoint: forced, or after five seconds with eight pages or 512 KiB."""
    return forced | ((seconds >= 5) & ((pages >= 8) | (size >= 512 * 1024)))
