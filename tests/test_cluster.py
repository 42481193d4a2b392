"""Range pairs with widths of their own, and clusters under a clique condition, against sequential rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators.cluster import clique_clusters, faults, fits, range_pairs

NO = {"habit": [("never", "current"), ("never", "former")], "drink": [("none", "heavy")]}
SCHEMA = "i int, sex string, age double, width double, habit string, drink string, kind string"


def made(n: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    nodes = [(i, rng.choice(["f", "m", "m", None]), rng.choice([None, *range(0, 90)]), rng.choice([0.0, 0.5, 3.0, 10.0, 40.0]), rng.choice(["never", "current", "former", None]), rng.choice(["none", "heavy", None]), rng.choice("xyz")) for i in range(n)]
    nodes = [(i, s, None if a is None else float(a), *r) for i, s, a, *r in nodes]
    items = [(i, rng.randrange(n // 3 + 1)) for i in range(n) for _ in range(rng.choice([0, 1, 2, 4]))] + [(0, None), (None, 1)]
    return nodes, items


def near(x: tuple, y: tuple) -> bool:
    if x[1] is None or x[1] != y[1]:
        return False
    if x[2] is not None and y[2] is not None and abs(x[2] - y[2]) > min(x[3], y[3]):
        return False
    return {x[4], y[4]} not in ({"never", "current"}, {"never", "former"}) and {x[5], y[5]} != {"none", "heavy"}


@pytest.mark.parametrize("seed", [1, 2])
def test_range_pairs_equal_all_pairs(spark, seed):
    nodes, items = made(120, seed)
    df, held = spark.createDataFrame(nodes, SCHEMA), spark.createDataFrame(items, "i int, feature int")
    want = {(x[0], y[0]) for x in nodes for y in nodes if x[0] < y[0] and near(x, y)}
    assert sorted(map(tuple, range_pairs(df, ["sex"], "i", "age", "width", contradictions=NO).collect())) == sorted(want)
    of = {i: {f for j, f in items if j == i and f is not None} for i in range(120)}
    got = range_pairs(df, ["sex"], "i", "age", "width", contradictions=NO, shared=held).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, len(of[a] & of[b])) for a, b in want if of[a] & of[b])
    few = range_pairs(df, ["sex"], "i", "age", "width", contradictions=NO, shared=held, most=1).collect()
    assert few == []
    assert range_pairs(df.limit(0), ["sex"], "i", "age", "width").collect() == []


def sequential(nodes: list[tuple], items: list[tuple], most: dict) -> list[tuple]:
    """The rule item by item."""
    about = {n[0]: n for n in nodes}
    of = {i: {f for j, f in items if j == i and f is not None} for i in about}
    linked = lambda a, b: near(about[a], about[b]) and bool(of[a] & of[b])
    count = {a: sum(linked(a, b) for b in about if a != b) for a in about}
    cap = lambda members: most["wide"] if len({about[m][6] for m in members}) > 1 else most["narrow"]
    free, out = set(about), []
    for seed in sorted(about, key=lambda a: (-count[a], a)):
        if seed not in free:
            continue
        members = [seed]
        for c in sorted((b for b in free if b != seed and linked(seed, b)), key=lambda b: (-len(of[b] & of[seed]), b)):
            if len(members) >= cap(members):
                break
            if all(near(about[m], about[c]) for m in members):
                members.append(c)
        if len(members) > 1:
            free -= set(members)
            out += [(m, seed, k) for k, m in enumerate(members)]
    return out


@pytest.mark.parametrize(("seed", "narrow", "wide"), [(3, 2, 5), (4, 3, 3), (5, 6, 2)])
def test_clusters_equal_the_sequential_rule(spark, seed, narrow, wide):
    nodes, items = made(90, seed)
    df, held = spark.createDataFrame(nodes, SCHEMA), spark.createDataFrame(items, "i int, feature int")
    pairs = range_pairs(df, ["sex"], "i", "age", "width", contradictions=NO, shared=held)
    about = df.select("i", F.struct("sex", "age", "width", "habit", "drink", "kind").alias("about"))
    fit = lambda x, y: (x["sex"] == y["sex"]) & fits(x, y, value="age", width="width", contradictions=NO)
    cap = lambda members: F.when(F.size(F.array_distinct(F.transform(members, lambda m: m["kind"]))) > 1, wide).otherwise(narrow)
    got = clique_clusters(about, pairs, "i", fit=fit, cap=cap)
    assert sorted(map(tuple, got.collect())) == sorted(sequential(nodes, items, {"narrow": narrow, "wide": wide}))
    assert tuple(faults(got, about, pairs, "i", fit=fit).first()) == (0, 0, 0, 0)
    assert faults(got.union(got), about, pairs, "i", fit=fit).first()["n_repeated"] > 0


def test_no_pairs(spark):
    about = spark.createDataFrame([(1,)], "i int").select("i", F.struct("i").alias("about"))
    pairs = spark.createDataFrame([], "a int, b int, n_shared long")
    assert clique_clusters(about, pairs, "i", fit=lambda x, y: F.lit(True), cap=lambda m: F.lit(3)).collect() == []
