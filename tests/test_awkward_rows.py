"""Nulls, repeated rows, empty tables and columns that are named like the operators' helpers."""

from pyspark.sql import functions as F

from tallgrass.operators import dedup, pairs, stats, timeline


def test_pick_first(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 3, "c"), (None, 3, "c")], "k int, _rn int, __rn string")
    assert sorted(map(tuple, dedup.pick_first(df, ["k"], ["_rn", "__rn"]).collect()), key=str) == [(1, 1, "a"), (None, 3, "c")]
    assert dedup.pick_first(df.limit(0), ["k"], ["_rn"]).count() == 0


def test_insert_and_upsert(spark):
    old, new = spark.createDataFrame([(1, "x", 0)], "k int, v string, _rn int"), spark.createDataFrame([(1, "y", 5), (2, None, 6), (2, None, 6), (None, "z", 7)], "k int, v string, _rn int")
    assert sorted(map(tuple, dedup.insert_ignore(old, new, ["k"], ["_rn"]).collect()), key=str) == [(2, None, 6), (None, "z", 7)]
    assert sorted(map(tuple, dedup.upsert(old, new, ["k"], ["_rn"]).collect()), key=str) == [(1, "y", 5), (2, None, 6), (None, "z", 7)]
    assert dedup.insert_ignore(old.limit(0), new.limit(0), ["k"], ["_rn"]).count() == 0 and dedup.upsert(old, new.limit(0), ["k"], ["_rn"]).count() == 1


def test_fill_missing(spark):
    df = spark.createDataFrame([(1, None, "mine", "_v"), (2, "b", "mine", "_v"), (None, None, "mine", "_v")], "k int, v string, _v string, _new_v string")
    source = spark.createDataFrame([(1, "a"), (2, "z"), (3, "q")], "k int, v string")
    got = dedup.fill_missing(df, source, ["k"], ["v"], "filled").orderBy(F.col("k").asc_nulls_last())
    assert [r.asDict() for r in got.collect()] == [
        {"k": 1, "_v": "mine", "_new_v": "_v", "v": "a", "filled": True}, {"k": 2, "_v": "mine", "_new_v": "_v", "v": "b", "filled": False}, {"k": None, "_v": "mine", "_new_v": "_v", "v": None, "filled": False},
    ]


def test_timeline_columns(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (None, 1, None)], "_n int, t int, _value string")
    got = timeline.changed(df, ["_n"], ["t"], F.col("_value"), "header").orderBy(F.col("_n").asc_nulls_last(), "t")
    assert got.columns == ["_n", "t", "_value", "header"] and [r.header for r in got.collect()] == [True, False, True, False, True, True]
    kept = timeline.anchors(df, ["_n"], ["t"])
    assert kept.columns == ["_n", "t", "_value", "position"] and sorted((r._n, r.t) for r in kept.collect()) == [(1, 2), (1, 4), (1, 5)]
    assert timeline.anchors(df.limit(0), ["_n"], ["t"]).count() == 0


def test_quota_split_columns(spark):
    df = spark.createDataFrame([(None, i) for i in range(4)] + [(1, i) for i in range(5)], "_n int, _rank int")
    got = stats.quota_split(df, ["_n"], ["_rank"], {"x": 0.5, "y": 0.5})
    assert got.columns == ["_n", "_rank", "split"] and sorted((r._n or 0, r._rank) for r in got.where("split = 'x'").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_prefix_matches_columns(spark):
    codes, rules = spark.createDataFrame([("A12", 7), (None, 8), ("", 9), ("A12", 7)], "code string, _p int"), spark.createDataFrame([("A1", "r1"), ("B", "r2"), (None, "r3")], "prefix string, __p string")
    assert sorted(map(tuple, pairs.prefix_matches(codes, "code", rules, "prefix").collect())) == [("A12", 7, "A1", "r1")] * 2
    assert pairs.prefix_matches(codes.limit(0), "code", rules, "prefix").count() == 0
