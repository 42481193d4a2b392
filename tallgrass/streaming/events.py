"""Streams of events: windowed counts, idle sessions and a rate limit. Each has a batch query that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the Parquet files of a folder, with ts as an instant."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def idle_sessions(events: DataFrame, *, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end when nothing happens for the gap."""
    runs = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))
    return runs.select("user_id", "n", "begins", "ends")


def rate_limit(events: DataFrame, *, limit: int = 50) -> DataFrame:
    """Each event with its number within user and kind, and whether it is within the limit; the only state is a counter."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        number = range(seen + 1, seen + 1 + len(rows))
        state.update((seen + len(rows),))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "user_id": key[0], "allowed": [n <= limit for n in number]})

    return events.groupBy("user_id", "event_type").applyInPandasWithState(run, "event_id bigint, user_id bigint, allowed boolean", "n bigint", "append", GroupStateTimeout.NoTimeout)


def episode_steps(events: DataFrame, *, starts: set[str], submits: set[str], wrong: set[str], budget: int = 40, ttl_seconds: int = 7200, late: str = "10 minutes") -> DataFrame:
    """Rows (event_id, user_id, status, remaining): the steps of each user's episodes, as operators.episodes.episode_steps gives them for a whole table; kinds of events play the parts.

    The state of an episode is its counter and two instants, and ends when the watermark has passed its expiry; events later than the watermark are dropped, and events without a time too.
    """
    ttl = ttl_seconds * 1_000_000

    def step(kind: str, at: int, used: int, last: int, ended: int) -> tuple[str, int | None, tuple[int, int, int] | None]:
        """Status, remaining and next state; a negative last is no episode, a negative ended one that is open."""
        if kind in starts:
            return "started", budget, (0, at, -1)
        if last < 0 or at - (ended if ended >= 0 else last) > ttl:
            return "gone", None, None
        if ended >= 0:
            return "finished", None, (used, last, ended)
        if kind in submits:
            return ("forced", 0, (used, at, at)) if used >= budget else ("submitted", budget - used - 1, (used, at, at))
        if kind in wrong:
            return "wrong_tool", max(budget - used, 0), (used, at, -1)
        return ("run" if used < budget else "spent"), max(budget - used - 1, 0), (used + 1, at, -1)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, -1, -1)
        rows, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for event_id, kind, at in zip(rows["event_id"], rows["event_type"], rows["us"], strict=True):
            status, left, after = step(kind, at, *now)
            now = after or (0, -1, -1)
            out.append((event_id, key[0], status, left))
        if now[1] < 0:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(int(x) for x in now))
            state.setTimeoutTimestamp(max((max(now[1], now[2]) + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "status", "remaining"]).astype({"remaining": "Int32"})

    timed = events.where("ts IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(run, "event_id bigint, user_id bigint, status string, remaining int", "used bigint, last bigint, ended bigint", "append", GroupStateTimeout.EventTimeTimeout)
