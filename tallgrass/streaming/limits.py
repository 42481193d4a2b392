"""A rate limit whose state ends: counters with timers, so that the state holds the sessions that are open and no others."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "event_id bigint, user_id bigint, event_type string, number bigint, allowed boolean"


class _Counter(StatefulProcessor):
    """The number and the instant (in milliseconds) of a key's last event; a timer ends it when nothing has come for the idle time."""

    def __init__(self, limit: int, idle_ms: int):
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "n bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        for chunk in rows:
            chunk = chunk.sort_values(["ms", "event_id"])
            numbers = []
            for at in chunk["ms"]:
                n, last = (1 if last is None or at - last > self.idle_ms else n + 1), at if last is None else max(last, at)
                numbers.append(n)
            yield pd.DataFrame({"event_id": chunk["event_id"].to_numpy(), "user_id": key[0], "event_type": key[1], "number": numbers, "allowed": [x <= self.limit for x in numbers]})
        if last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.state.update((int(n), int(last)))
            self.handle.registerTimer(max(int(last) + self.idle_ms + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_timers(spark: SparkSession) -> None:
    """Sets the session's state store to one that has timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def session_limit(events: DataFrame, *, limit: int = 50, idle_seconds: int = 7200, late: str = "10 minutes") -> DataFrame:
    """A stream's events, each with its number within the session of its user and kind, and whether it is within the limit. A session ends when nothing happens for the idle time, and its counter with it.

    A key's events are counted as they come, Arrow batch by Arrow batch (by time within one): none of them is held. Events later than the watermark are dropped, and events without a time, user or kind too.
    """
    timed = events.where("ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    keyed = timed.select("event_id", "user_id", "event_type", "ts", "ms").groupBy("user_id", "event_type")
    return keyed.transformWithStateInPandas(statefulProcessor=_Counter(limit, idle_seconds * 1000), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def session_limit_table(events: DataFrame, *, limit: int = 50, idle_seconds: int = 7200) -> DataFrame:
    """The same for a whole table, by windows."""
    timed = events.where("ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    order = Window.partitionBy("user_id", "event_type").orderBy("ms", "event_id")
    opened = timed.withColumn("opens", F.coalesce((F.col("ms") - F.lag("ms").over(order) > idle_seconds * 1000).cast("int"), F.lit(1)))
    sessions = opened.withColumn("session", F.sum("opens").over(order))
    number = F.row_number().over(Window.partitionBy("user_id", "event_type", "session").orderBy("ms", "event_id")).cast("long")
    return sessions.withColumn("number", number).select("event_id", "user_id", "event_type", "number", (F.col("number") <= limit).alias("allowed"))
