"""Pairs of parts: names are compared once, however many parts have them."""

from __future__ import annotations

from tallgrass.functions import text
from tallgrass.plans import texts


class Parts:
    def __init__(self, part):
        self.part = part


def test_names_are_compared_once(spark):
    rows = [(i, "B" if i % 7 else None, "T", 1, ["red ring", "ring red", "Red ring", "", None][i % 5]) for i in range(60)]
    part = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_name string")
    got = {(r.a, r.b): r.similarity for r in texts.similarity_pairs(Parts(part)).collect()}
    fit = [r for r in rows if r[1]]
    assert set(got) == {(x[0], y[0]) for x in fit for y in fit if x[0] < y[0]}
    names = {r[0]: r[4] for r in rows}
    pairs = sorted({(names[a], names[b]) for a, b in got}, key=str)
    want = spark.createDataFrame(pairs, "x string, y string").withColumn("s", text.F.round(text.similarity(text.F.col("x"), text.F.col("y")), 6)).collect()
    by = {(r.x, r.y): r.s for r in want}
    assert all(s == by[names[a], names[b]] for (a, b), s in got.items())
    plan = texts.similarity_pairs(Parts(part))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and "round(" not in plan.split("InMemoryRelation")[0]  # pairs of parts compare nothing
