"""Traces against the rules written entry by entry, and Kendall's tau pair by pair."""

from __future__ import annotations

import random
from itertools import combinations

from tallgrass.operators import traces

SCHEMA = "item string, at int, kind string, name string, encounter string, section string, args string, output_length int"


def tau(x: list[int]) -> float | None:
    y, up, nx, ny = sorted(x), 0, 0, 0
    for i, j in combinations(range(len(x)), 2):
        a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
        up, nx, ny = up + a * b, nx + abs(a), ny + abs(b)
    return up / (nx * ny) ** 0.5 if nx else None


def test_order_agreement_equals_all_pairs(spark):
    rng = random.Random(5)
    lists = {f"t{i}": [rng.randrange(rng.choice([1, 2, 5, 18])) for _ in range(rng.randrange(1, 60))] for i in range(80)}
    rows = [(k, r, at) for k, v in lists.items() for at, r in enumerate(v)] + [(None, 1, 0), ("t0", None, 999)]
    rng.shuffle(rows)
    got = {r["item"]: r["tau"] for r in traces.order_agreement(spark.createDataFrame(rows, "item string, rank int, at int"), ["at"]).collect()}
    want = {k: tau(v) for k, v in lists.items() if tau(v) is not None}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gathering_and_workflow(spark):
    rows = [
        ("a", 0, "tool", "open_chart", None, None, "{}", 10), ("a", 1, "tool", "view_section", "e1", "labs", "x", 0), ("a", 2, "command", "view_section", "e1", "labs", "x", 5),
        ("a", 3, "tool", "view_section", "e1", "hpi", "y", None), ("a", 4, "tool", "view_section", "e2", "nowhere", "z", 3), ("a", 5, "submit", "submit", "e2", "plan", "x", 0),
        ("b", 0, "message", None, None, None, None, None), ("b", 1, "tool", "search", "e1", "plan", None, 1), ("b", 2, "tool", "search", None, "labs", None, 1),
        ("c", 0, "submit", "submit", None, None, None, 1), ("d", 0, "tool", None, None, None, None, 0), (None, 0, "tool", "open_chart", "e", "hpi", "q", 0),
    ]
    steps = spark.createDataFrame(rows, SCHEMA)
    got = {r["item"]: tuple(r)[1:] for r in traces.gathering(steps).collect()}
    # a: labs is read twice with the same arguments, which are two repeats of five actions
    assert got == {"a": (5, 3, 0.4, 0.4), "b": (2, 1, 0.0, 0.5), "c": (0, 0, None, None), "d": (1, 0, 1.0, 0.0)}
    flow = {r["item"]: tuple(r)[1:] for r in traces.workflow(steps, ["at"]).collect()}
    assert flow["a"][1:] == (2 / 3, "overview") and abs(flow["a"][0] - tau([12, 12, 2])) < 1e-9
    assert flow["b"] == (-1.0, 1.0, None) and flow["c"] == (None, None, None) and flow["d"] == (None, None, "other")
    means = traces.workflow_means(traces.workflow(steps, ["at"])).first()
    assert (means["overview"], means["specific"], means["other"]) == (0.5, 0.0, 0.5) and abs(means["breadth_depth"] - 5 / 6) < 1e-9


def test_empty_traces(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not traces.gathering(none).collect() and not traces.workflow(none, ["at"]).collect()
    assert tuple(traces.workflow_means(traces.workflow(none, ["at"])).first()) == (None, None, 0.0, 0.0, 0.0)


def test_efficiency_defaults(spark):
    runs = spark.createDataFrame([("x", 10, True, None, 5, None, 100), ("x", 20, None, 0, None, None, None), ("y", None, False, 8, 1, 1, 1)], "arm string, turns int, submitted boolean, budget int, tokens_in int, tokens_out int, latency_ms int")
    got = {r["arm"]: tuple(r)[1:] for r in traces.efficiency(runs, ["arm"]).collect()}
    assert got == {"x": (2, 15.0, 15.0, 0.5, 0.25, 2.5, 100.0), "y": (1, None, None, 0.0, None, 2.0, 1.0)}
