"""Periodic runs against all lags at all places."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallgrass.llm.periodic import kept, op12_periodic_runs, periodic_runs, runs, words_of

LEAST = 12


def brute(words: list) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(LEAST, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def cases() -> list[list[str]]:
    rng = random.Random(1)
    out = [[], ["a"], list("ab" * 6), list("ab" * 5), list("a" * 12), list("a" * 11), list("abababababababa" * 2), list("ababababa" * 2), list("x" + "abc" * 5 + "y" + "abc" * 4), list("a" * 40 + "b" + "a" * 40 + "b" + "a" * 40)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    out.append(list(fib[-1]))
    for _ in range(300):
        letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        text = ""
        for _ in range(rng.randint(1, 6)):
            piece = "".join(rng.choice(letters) for _ in range(rng.randint(1, 15)))
            text += piece * rng.choice([1, 2, 2, 3, 7]) + piece[: rng.randint(0, len(piece))]
        out.append(list(text))
    return out


def numbers(words: list[str]) -> np.ndarray:
    return words_of(" ".join(words))[1]


def test_equals_brute_force():
    for words in cases():
        assert runs(numbers(words)) == brute(words), "".join(words)


def test_large_blocks(monkeypatch):
    monkeypatch.setattr("tallgrass.llm.periodic.BLOCK", 7)
    for words in cases()[::9]:
        assert runs(numbers(words)) == brute(words)


def test_very_long_texts():
    """One word a million times, and a million words without runs."""
    assert runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5000, 1_000_000)
    ids[500_000:500_400] = ids[500_400:500_800]
    assert [r for r in runs(ids) if r[1] >= 800] == [(500_000, 800, 400)]


def expected(rows: list[tuple]) -> dict:
    out = {}
    for doc_id, text in rows:
        words = (text or "").split(" ") if text else []
        words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
        words = [w for w in words if w]
        h = zlib.crc32(str(doc_id).encode())
        n = len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[doc_id] = (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, " ".join(w) if w else None) for i, w in enumerate(cases())] + [(None, "a b " * 8), (1000, ""), (1001, " \n "), (1002, "é x\t" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == expected(rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 and bool(t) for i, t in rows if i is not None) > 5


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 15_000]  # brute force is slow on the others
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i, _ in short} == expected(short)


def test_awkward_rows(spark):
    schema = "doc_id long, text string, runs int, _runs string, _collapsed int, collapsed string"
    assert periodic_runs(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b " * 6, 1, "u", 2, "v")] * 2 + [(None, None, None, None, None, None)]
    got = periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["_runs"], r["_collapsed"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == [(0, None, None, [], ""), (1, "u", 2, [(0, 12, 2)], "a b"), (1, "u", 2, [(0, 12, 2)], "a b")]


@pytest.mark.parametrize(("found", "stay"), [([], "11111"), ([(0, 4, 2)], "11001"), ([(0, 4, 1), (2, 3, 1)], "10000")])
def test_kept(found, stay):
    assert "".join(str(int(x)) for x in kept(5, found)) == stay
