"""Weighted overlap of items against the plain rule, with large features, negative, null and absent weights, and by lists instead of pairs."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tallgrass.operators import pairs


def plain(rows, most, least):
    w = defaultdict(dict)
    for item, feature, x in rows:
        w[item][feature] = max((v for v in (x, w[item].get(feature)) if v is not None), default=None)
    held = defaultdict(list)
    for item, of in w.items():
        for f in of:
            held[f].append(item)
    total = {i: sum(v for v in of.values() if v is not None) if any(v is not None for v in of.values()) else None for i, of in w.items()}
    shared = {}
    for f, items in held.items():
        if f is not None and len(items) >= 2 and (most is None or len(items) <= most):
            for a in items:
                for b in items:
                    if a is not None and b is not None and a < b:
                        both = [v for v in (w[a][f], w[b][f]) if v is not None]
                        shared[a, b] = shared.get((a, b), 0) + (min(both) if both else 0)
    out = {}
    for (a, b), s in shared.items():
        if total[a] is not None and total[b] is not None and (d := total[a] + total[b] - s) and s / d >= least:
            out[a, b] = round(s / d, 9)
    return out


def got(spark, rows, most, least):
    df = pairs.weighted_overlap(spark.createDataFrame(rows, "i long, f long, w double"), "i", "f", F.col("w"), most=most, least_score=least)
    found = df.collect()
    assert len({(r.a, r.b) for r in found}) == len(found)
    return {(r.a, r.b): round(r.score, 9) for r in found}


def test_equals_the_plain_rule(spark):
    random.seed(4)
    rows = [(random.randrange(30), random.randrange(60), float(random.randrange(1, 50))) for _ in range(500)] + [(None, 3, 5.0), (2, None, 7.0), (5, None, 7.0)]
    wide = [(i, f, float(1 + (i * f) % 5)) for f in range(2) for i in range(150)] + [(i, 100 + i % 9, 3.0) for i in range(150)]
    for some, most in ((rows, 40), (rows, None), (rows, 8), (wide, None), (wide, 100)):
        for least in (0.0, 0.05, 0.3):
            assert got(spark, some, most, least) == plain(some, most, least)
    below = [*rows, *((i, 61 + i % 3, -float(20 + i)) for i in range(0, 30, 4))]
    assert got(spark, below, 40, 0.05) == plain(below, 40, 0.05)
    absent = [*rows, *((i, 70 + i % 2, None if i % 3 else 900.0) for i in range(12))]
    assert got(spark, absent, 40, 0.05) == plain(absent, 40, 0.05)


def test_pairs_are_summed_where_lists_arrive(spark):
    rows = spark.createDataFrame([(i, i % 3, 1.0) for i in range(9)], "i long, f long, w double")
    plan = pairs.weighted_overlap(rows, "i", "f", F.col("w"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#\d+L?, b#\d+L?", plan)
