"""Literal facts about comparisons and statistics."""

import numpy as np
import pytest

from tallgrass.functions import similarity
from tallgrass.operators import stats


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 15))
        assert similarity.lcs_length(a, b) == brute_lcs(a, b)
    assert similarity.rouge_l("the cat sat".split(), "the cat ran".split()) == pytest.approx(2 / 3)
    assert similarity.rouge_l([], ["a"]) == 0.0


def test_wilcoxon(spark):
    rows = [("g", a, b) for a, b in [(125, 110), (115, 122), (130, 125), (140, 120), (140, 140), (115, 124), (140, 123), (125, 137), (140, 135), (135, 145)]]
    r = stats.wilcoxon(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b").first()
    assert (r.n, r.w_plus, r.w_minus) == (9, 27.0, 18.0)


def test_bootstrap(spark):
    rows = [("g", i, float(i % 10)) for i in range(500)]
    r = stats.bootstrap_mean(spark.createDataFrame(rows, "g string, i int, v double"), "g", "i", "v").first()
    assert r["mean"] == 4.5 and 4.0 < r.low < 4.5 < r.high < 5.0
