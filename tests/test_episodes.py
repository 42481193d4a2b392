"""Episodes against a fold over ordered actions, as a table and as a stream; scopes; deck files."""

import datetime
import fnmatch
import random

from pyspark.sql import functions as F

from tallgrass.functions import access
from tallgrass.operators import episodes
from tallgrass.plans import episodes as plans
from tallgrass.sources import decks
from tallgrass.streaming import events

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def fold(rows, budget, ttl):
    """rows: (key, id, second, kind) in order."""
    state, out = {}, {}
    for key, i, at, kind in rows:
        ep = state.get(key)
        if ep and at - ep["seen"] > ttl:
            ep = state[key] = None
        if kind == "start":
            state[key] = {"seen": at, "used": 0, "done": False}
            out[i] = ("started", budget)
        elif ep is None:
            out[i] = ("gone", None)
        elif ep["done"]:
            out[i] = ("finished", None)
        else:
            ep["seen"], left = at, budget - ep["used"]
            if kind == "submit":
                ep["done"] = True
                out[i] = ("forced", 0) if left <= 0 else ("submitted", left - 1)
            elif kind == "wrong":
                out[i] = ("wrong_tool", left)
            elif left > 0:
                ep["used"] += 1
                out[i] = ("run", left - 1)
            else:
                out[i] = ("spent", 0)
    return out


def actions(n, seed):
    draw, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += draw.choice([0, 5, 20, 60])
        rows.append((draw.choice([1, 2, 3]), i, at, draw.choice(["start", "submit", "wrong", "look", "look", "look", None])))
    return rows


def test_episode_steps(spark):
    for seed in range(3):
        rows = actions(150, seed)
        df = spark.createDataFrame([(k, i, START + datetime.timedelta(seconds=s), kind, "kept", "old") for k, i, s, kind in rows], "k int, id int, ts timestamp, kind string, gone string, status string")
        is_kind = lambda name: F.col("kind") == name
        got = episodes.episode_steps(df, ["k"], ["ts", "id"], "ts", starts=is_kind("start"), submits=is_kind("submit"), wrong=is_kind("wrong"), budget=2, ttl_seconds=60)
        assert got.columns == ["k", "id", "ts", "kind", "gone", "status", "remaining"] and {r.gone for r in got.collect()} == {"kept"}
        assert {r.id: (r.status, r.remaining) for r in got.collect()} == fold(rows, 2, 60)
    assert episodes.episode_steps(df.limit(0), ["k"], ["ts", "id"], "ts", starts=is_kind("start"), submits=is_kind("submit"), wrong=is_kind("wrong")).count() == 0
    odd = spark.createDataFrame([(None, 1, START, "start"), (None, 2, None, "look"), (None, 3, START, "look")], "k int, id int, ts timestamp, kind string")
    got = episodes.episode_steps(odd, ["k"], ["id"], "ts", starts=is_kind("start"), submits=is_kind("submit"), wrong=is_kind("wrong"))
    assert [(r.status, r.remaining) for r in got.orderBy("id").collect()] == [("started", 40), ("run", 39), ("run", 38)]


def test_stream_of_episodes(spark, sf, tmp_path):
    folder, table = str(tmp_path / "events"), spark.read.parquet(f"{sf}/events.parquet")
    cuts = [r[0] for r in table.selectExpr("explode(percentile_approx(unix_micros(cast(ts as timestamp)), array(0.3, 0.7)))").collect()]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    parts = [table.where(us < cuts[0]), table.where((us >= cuts[0]) & (us < cuts[1])), table.where(us >= cuts[1])]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        live = events.episode_steps(events.read_events(spark, folder), starts={"signup"}, submits={"purchase"}, wrong={"error"}, budget=plans.BUDGET, ttl_seconds=plans.TTL)
        q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None and i < 3
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.event_id, r.status, r.remaining or 0) for r in got) == sorted((r.event_id, r.status, r.remaining or 0) for r in plans.steps(table).collect())


def test_unfinished(spark):
    asked, stored = spark.createDataFrame([(1,), (2,), (None,), (2,)], "id int"), spark.createDataFrame([(1,), (None,), (1,)], "id int")
    assert [r.id for r in episodes.unfinished(asked, stored, ["id"]).orderBy("id").collect()] == [None, 2, 2]


def test_scopes(spark):
    df = spark.createDataFrame([("nurse", "Patient.read"), ("nurse", "Encounter.read"), ("guest", "Patient.read"), (None, "Patient.read"), ("nurse", None)], "role string, scope string")
    grants = {"nurse": ["Patient.read", "Observation.read"], "other": ["Encounter.read"], "none": []}
    assert [r[0] for r in df.select(access.has_scope(F.col("role"), F.col("scope"), grants)).collect()] == [True, False, False, False, False]


def test_deck_files(spark):
    globs, names = ["*.apkg", "Deck v?.apkg", "[A-C]*_[!x].apkg", "a+b (1).apkg"], ["Deck v2.apkg", "Deck v22.apkg", "B1_y.apkg", "B1_x.apkg", "a+b (1).apkg", "aab (1).apkg", "x.zip", "x.apkg\n"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "filename string")
    for g in globs:
        got = decks.discovered(df, [{"name": "p", "role": "fact", "priority": 1, "globs": [g]}]).collect()
        assert [r.filename for r in got if r.profile] == [n for n in names if fnmatch.fnmatchcase(n, g)], g
    both = [{"name": "wide", "role": "fact", "priority": 9, "globs": ["*"]}, {"name": "fine", "role": "board", "priority": 1, "globs": ["*.zip"]}, {"name": "late", "role": "fact", "priority": 1, "globs": ["*.zip"]}, {"name": "bare", "role": "fact", "priority": 0, "globs": []}]
    assert {r.filename: r.profile and r.profile.name for r in decks.discovered(df, both).collect()} == {n: "fine" if n.endswith(".zip") else "wide" for n in names} | {None: None}
    rows = [(1, "Default"), (1, "B::a"), (1, "C"), (1, "A::a"), (2, "Default"), (3, None)]
    assert {r.g: r.deck for r in decks.primary_deck(spark.createDataFrame(rows, "g int, deck string"), "g", "deck").collect()} == {1: "C", 2: "Default", 3: "Default"}
