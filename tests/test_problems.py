"""Problem lists against the rule written list by list."""

from __future__ import annotations

import os
import random

import pytest

from tallgrass.operators import problems


def begin(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def pairs(given: list[str], truth: list[str]) -> list[tuple[int, int]]:
    left, out, rest = list(range(len(given))), [], []
    for i, t in enumerate(truth):
        hit = next((j for j in left if given[j] == t), None)
        if hit is None:
            rest.append(i)
        else:
            left.remove(hit)
            out.append((i, hit))
    for i in rest:
        n = 5 if truth[i][:1] in ("S", "T") else 3
        near = [j for j in left if given[j][:n] == truth[i][:n]]
        if near:
            best = max(near, key=lambda j: (begin(given[j], truth[i]), -j))
            left.remove(best)
            out.append((i, best))
    return out


def weight(code: str, course: str | None) -> float:
    active, grave = course in ("acute", "acute_on_chronic"), code[:1] in problems.SEVERE_LETTERS
    return 3.0 if code[:3] in problems.SEVERE_CATEGORIES or (active and grave) else 2.0 if active or grave else 1.0


def test_scores_equal_the_plain_rule(spark):
    rng = random.Random(7)
    codes = ["E11.9", "e119", "E11.21", "E11.22", "I10", "I21.4", "I21.9", "S72.001A", "S72.0012", "S72.002", "Z00", "A41.9", "", "J9", "K72.10", "K72.1"]
    courses = ["acute", "Chronic", "flare", None, "odd", "acute on chronic"]
    lists = lambda: {i: [(rng.choice(codes), rng.choice(courses)) for _ in range(rng.randint(0, 7))] for i in range(80)}
    truth, given = lists(), lists()
    neutral = [(i, c) for i in range(80) for c in ("E11", "Z00") if rng.random() < 0.4]
    frame = lambda d: spark.createDataFrame([(i, k, c, a) for i, rows in d.items() for k, (c, a) in enumerate(rows)], "item int, place int, code string, course string")
    got = {r.item: r for r in problems.scores(frame(truth), frame(given), "item", neutral=spark.createDataFrame(neutral, "item int, category string")).collect()}
    assert set(got) == {i for i in given if given[i]}
    plain = lambda c: c.replace(".", "").upper()
    for i, r in got.items():
        t, g = [plain(c) for c, _ in truth[i]], [plain(c) for c, _ in given[i]]
        tc, gc = ([problems.COURSES.get(a.lower()) if a else None for _, a in rows[i]] for rows in (truth, given))
        of_t, of_g = dict(zip(t, tc, strict=True)), dict(zip(g, gc, strict=True))
        found = pairs(g, t)
        assert r.n_matched == len(found) and r.recall == pytest.approx(len(found) / len(t) if t else 1.0) and r.precision == pytest.approx(len(found) / len(g))
        whole = sum(weight(c, a) for c, a in zip(t, tc, strict=True))
        assert r.weighted_recall == pytest.approx(sum(weight(t[a], of_t[t[a]]) for a, _ in found) / whole if t else 1.0)
        spare = [g[j] for j in range(len(g)) if j not in {b for _, b in found}]
        mild = sum((i, c[:3]) in neutral for c in spare)
        rest = len(g) - mild
        assert r.n_neutral == mild and (r.precision_neutral is None if not rest else r.precision_neutral == pytest.approx(len(found) / rest))
        share = [1.0 if len(t[a]) >= 4 and t[a][3] == "9" else begin(t[a], g[b]) / max(len(t[a]), len(g[b]), 1) for a, b in found]
        assert r.specificity is None if not share else r.specificity == pytest.approx(sum(share) / len(share))
        told = [(of_t[t[a]], of_g[g[b]]) for a, b in found if of_t[t[a]] and of_g[g[b]]]
        assert (r.n_courses, r.n_right_courses) == (len(told), sum(a == b for a, b in told))
    one = problems.summary(problems.scores(frame(truth), frame(given), "item")).first()
    assert one.n_scored == len(got) and one.recall == pytest.approx(sum(r.recall for r in got.values()) / len(got)) and one.f1 == pytest.approx(2 * one.recall * one.precision / (one.recall + one.precision))


def test_no_rows(spark):
    none = spark.createDataFrame([], "item int, place int, code string, course string")
    assert problems.scores(none, none, "item").collect() == [] and problems.summary(problems.scores(none, none, "item")).first().n_scored == 0
