"""The rate limit whose state ends: stream against table, and the state itself."""

from __future__ import annotations

import datetime
import random

from tallgrass.streaming import events, limits

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp_ntz"


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drain(stream, out, folder) -> int:
    """Runs a stream to its end and gives the rows of its state."""
    q = stream.writeStream.format("parquet").option("path", str(out)).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_stream_equals_table_and_state_ends(spark, tmp_path):
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    limits.use_timers(spark)
    try:
        rng, start = random.Random(4), datetime.datetime(2024, 1, 1)
        path, rows, every = str(tmp_path / "events"), 0, []
        for day in range(4):  # a batch a day: sessions of one day are over on the next one
            batch = [(rows + i, rng.randrange(12) + (100 * day if i % 3 else 0), rng.choice("ab"), start + datetime.timedelta(days=day, seconds=rng.randrange(30_000))) for i in range(80)]
            rows += 80
            every += batch
            write(spark, batch, path)
            state = drain(limits.session_limit(events.read_events(spark, path), limit=3, idle_seconds=3600), tmp_path / "out", tmp_path / "checkpoint")
        want = {tuple(r) for r in limits.session_limit_table(spark.createDataFrame(every, SCHEMA), limit=3, idle_seconds=3600).collect()}
        seen = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert seen == want and any(not r[4] for r in seen)
        keys = {(r[1], r[2]) for r in every}
        assert state < len(keys)  # counters of the first days are gone
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)


def test_events_without_keys_are_dropped(spark):
    rows = [(1, None, "a", datetime.datetime(2024, 1, 1)), (2, 1, None, datetime.datetime(2024, 1, 1)), (3, 1, "a", None), (4, 1, "a", datetime.datetime(2024, 1, 1))]
    assert [tuple(r) for r in limits.session_limit_table(spark.createDataFrame(rows, SCHEMA)).collect()] == [(4, 1, "a", 1, True)]
