"""Full-text search against a scan of the texts."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions.stemming import porter
from tallgrass.operators.search import FIELD, asked_words, match_all, postings, stretches


def scan(docs: list[tuple], queries: list[tuple], weights: list[float], stem) -> dict:
    out = {}
    words = lambda t: [stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]
    for q, text in queries:
        asked = set(words(text))
        for d, *fields in docs:
            lists = [words(f) for f in fields]
            if not asked or not all(any(w in ws for ws in lists) for w in asked):
                continue
            score = sum(weight * (1 + math.log(ws.count(w))) for w in asked for weight, ws in zip(weights, lists, strict=True) if w in ws)
            marks = sorted((i * FIELD + at, w) for i, ws in enumerate(lists) for at, w in enumerate(ws) if w in asked)
            shortest = min(b[0] - a[0] for i, a in enumerate(marks) for b in marks[i:] if {w for p, w in marks if a[0] <= p <= b[0]} == asked)
            out[q, d] = round(score * (1 + 1 / (1 + max(0, shortest - len(asked) + 1))), 6)
    return out


@pytest.mark.parametrize("stems", [False, True])
def test_search_equals_a_scan(spark, stems):
    rng = random.Random(8)
    vocabulary = ["cat", "cats", "running", "runs", "the", "the", "the", "relational", "relation", "x1", "Dog,", "dogs"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, rng.choice([say(rng.randint(0, 14)), None]), say(rng.randint(0, 4))) for i in range(60)]
    queries = [(i, say(rng.choice([1, 2, 2, 3]))) for i in range(30)] + [(90, ""), (91, None), (92, "zebra the")]
    post = postings(spark.createDataFrame(docs, "doc int, word string, score string"), "doc", {"word": 1.0, "score": 2.5}, stems=stems)
    got = {(r.q, r.doc): r.rank for r in match_all(post, spark.createDataFrame(queries, "q int, t string"), "q", "t", stems=stems).collect()}
    known = sorted({w for t in vocabulary + ["zebra"] for w in re.findall("[a-z0-9]+", t.lower())})
    form = {r.w: r.s for r in spark.createDataFrame([(w,) for w in known], "w string").select("w", (porter(F.col("w")) if stems else F.col("w")).alias("s")).collect()}
    want = scan(docs, queries, [1.0, 2.5], form.__getitem__)
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x], abs=2e-6) for x in want)
    best = match_all(post, spark.createDataFrame(queries, "q int, t string"), "q", "t", k=2, stems=stems).collect()
    for q, _ in queries:
        mine = sorted((-rank, d) for (i, d), rank in got.items() if i == q)[:2]
        assert [(-r.rank, r.doc) for r in sorted(best, key=lambda r: r.k) if r.q == q] == mine


def test_adjacent_words_rank_first(spark):
    docs = spark.createDataFrame([(1, "kidney and then a stone"), (2, "kidney stone"), (3, "stone kidney"), (4, "kidney")], "i int, t string")
    found = match_all(postings(docs, "i", {"t": 1.0}), spark.createDataFrame([(1, "Kidney stones")], "q int, t string"), "q", "t").orderBy("k").collect()
    assert [(r.doc, r.k) for r in found] == [(2, 1), (3, 2), (1, 3)]
    assert match_all(postings(docs.limit(0), "i", {"t": 1.0}), spark.createDataFrame([(1, "x")], "q int, t string"), "q", "t").count() == 0


@pytest.mark.parametrize("stems", [False, True])
def test_postings_of_asked_words_find_the_same(spark, stems):
    """Only words that are asked for are grouped, and the search finds what it finds in all postings."""
    docs = spark.createDataFrame([(i, f"runs running {'stone ' * (i % 3)}kidney kidneys w{i} relation relational", "web" if i % 2 else None) for i in range(40)], "i int, t string, s string")
    queries = spark.createDataFrame([(1, "kidney run"), (2, "stones kidney web"), (3, "relation w7"), (4, "none")], "q int, t string")
    fields = {"t": 1.0, "s": 2.0}
    few = postings(docs, "i", fields, stems=stems, only=asked_words(queries, "q", "t", stems=stems))
    assert not [r for r in few.select("word").distinct().collect() if r.word.startswith("w") and r.word not in ("w7", "web")]
    rows = lambda post: sorted(map(tuple, match_all(post, queries, "q", "t", stems=stems).collect()))
    assert rows(few) == rows(postings(docs, "i", fields, stems=stems)) != []


def test_stretches_equal_all_stretches():
    rng = random.Random(3)
    rows = [[sorted(rng.sample(range(60), rng.randint(1, 6))) for _ in range(rng.randint(1, 4))] for _ in range(80)]
    got = stretches(np.array([p for r in rows for x in r for p in x]), np.array([len(x) for r in rows for x in r]), np.array([len(r) for r in rows]))
    for r, n in zip(rows, got, strict=True):
        ends = sorted({p for x in r for p in x})
        assert n == min(b - a for a in ends for b in ends if b >= a and all(any(a <= p <= b for p in x) for x in r))
