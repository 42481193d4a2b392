"""Ancestors and interval labels against walks over the edges, and the reader of closure files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import graph
from tallgrass.operators.hierarchy import Hierarchy, stabbed
from tallgrass.sources import files


def above(edges: list[tuple]) -> dict:
    """node -> {ancestor: shortest depth}, by a search from each node."""
    up = {}
    for c, p in edges:
        if c is not None and p is not None and c != p:
            up.setdefault(c, set()).add(p)
    out = {}
    for node in up:
        depth, wave, d = {}, {node}, 0
        while wave:
            d += 1
            wave = {p for n in wave for p in up.get(n, ())} - set(depth) - {node}
            depth |= {p: d for p in wave}
        out[node] = depth
    return out


def dag(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(c, rng.randrange(c)) for c in range(1, n) for _ in range(rng.choice([1, 1, 2, 3]))] + [(5, 5), (None, 1), (2, None)]


def test_ancestors_of_long_chains_and_dags(spark):
    chain = [(i + 1, i) for i in range(100)]
    for edges in (chain, dag(60, 1), [(1, 2), (2, 3), (3, 1), (4, 1)]):
        df = spark.createDataFrame(edges, "c int, p int")
        got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(df, "c", "p").collect()}
        assert got == {(n, a): d for n, ds in above(edges).items() for a, d in ds.items() if a != n}
    near = graph.ancestors(spark.createDataFrame(chain, "c int, p int"), "c", "p", max_depth=5).collect()
    assert len(near) == sum(min(i, 5) for i in range(1, 101)) and max(r.depth for r in near) == 5


def test_ancestors_keep_their_plan_flat(spark):
    df = graph.ancestors(spark.createDataFrame([(i + 1, i) for i in range(40)], "c int, p int"), "c", "p")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


@pytest.mark.parametrize("edges", [dag(80, 3), [(i + 1, i) for i in range(1000)], [(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (9, 8), (4, 9)]], ids=["dag", "chain", "diamonds"])
def test_intervals_equal_walks(spark, edges):
    h, rng = Hierarchy(spark.createDataFrame(edges, "c int, p int"), "c", "p"), random.Random(1)
    up = above(edges)
    nodes = sorted({x for e in edges for x in e if x is not None})
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(600)] + [(None, 1), (nodes[-1], None), (10**6, 0)]
    got = {(r.x, r.y): r.below for r in h.below(spark.createDataFrame(pairs, "x int, y int"), "x", "y").collect()}
    assert got == {(x, y): y in up.get(x, {}) for x, y in pairs}
    items, tops = rng.sample(nodes, min(30, len(nodes))), rng.sample(nodes, min(10, len(nodes)))
    under = h.under(spark.createDataFrame([(i,) for i in items] * 2, "item int"), "item", spark.createDataFrame([(t,) for t in tops], "top int"), "top").collect()
    assert sorted(map(tuple, under)) == sorted((t, i) for t in tops for i in items if t in up.get(i, {}))


def test_large_tables_are_not_broadcast(spark):
    """Millions of short rows look small to Spark; nothing that grows with the nodes may be collected on the driver, and a parent's leaves take no part in the rounds."""
    edges = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("c"), F.explode(F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("g"), F.col("id") % 7))).alias("p")).cache()
    tree = Hierarchy(edges, "c", "p")
    label = tree.label(edges, "c", "x", "y")
    assert "Broadcast" not in label._jdf.queryExecution().executedPlan().toString() and label.count() == 9000 and label.where("y = x + 1").count() == 9000
    assert tree.nodes.agg(F.min("low"), F.max("high"), F.count("*")).first()[:] == (1, 2 * 3009, 3009)
    under = tree.under(edges.select(F.col("c").alias("item")), "item", edges.select(F.col("p").alias("top")), "top")
    assert sorted(map(tuple, under.collect())) == sorted((r.p, r.c) for r in edges.distinct().collect())
    edges.unpersist()


def test_cycles_raise(spark):
    for edges in ([(1, 2), (2, 1)], [(1, 0), (2, 1), (1, 2)]):
        with pytest.raises(ValueError, match="cycle"):
            Hierarchy(spark.createDataFrame(edges, "c int, p int"), "c", "p")


def test_empty_hierarchy(spark):
    h = Hierarchy(spark.createDataFrame([], "c int, p int"), "c", "p")
    assert h.nodes.count() == 0 and not h.below(spark.createDataFrame([(1, 2)], "x int, y int"), "x", "y").first().below


def test_stabbed_equals_comparison(spark):
    rng = random.Random(4)
    ranges = [(i, a := rng.randrange(200), a + rng.randrange(60)) for i in range(80)]
    points = [(rng.randrange(220),) for _ in range(90)]
    got = stabbed(spark.createDataFrame(ranges, "i int, lo long, hi long"), "lo", "hi", spark.createDataFrame(points, "at long").withColumn("n", F.lit(1)), "at")
    assert sorted((r.i, r.at) for r in got.collect()) == sorted((i, p) for i, lo, hi in ranges for (p,) in points if lo <= p < hi)


def test_closure_file(spark, tmp_path):
    (tmp_path / "closure.txt").write_text("supertypeId\tsubtypeId\n10\t1\n20\t1 \n10\t2\n\t3\n10\t1\n")
    only = spark.createDataFrame([("1",), ("7",)], "node string")
    assert sorted(map(tuple, files.closure_table(spark, str(tmp_path / "closure.txt"), only=only).collect())) == [("1", "10"), ("1", "20")]
    (tmp_path / "relations.txt").write_text("active\tsubtypeId\tsupertypeId\ttypeId\n1\ta\tb\tis\n0\ta\tc\tis\n1\ta\td\tsite\n1\tx\ty\tother\n")
    kinds = spark.createDataFrame([("is",), ("site",)], "kind string")
    assert sorted((r.node, r.ancestor, r.kind) for r in files.closure_table(spark, str(tmp_path / "relations.txt"), kinds=kinds).collect()) == [("a", "b", "is"), ("a", "d", "site")]
