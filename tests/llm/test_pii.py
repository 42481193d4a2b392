"""Personal data: patterns against plain regular expressions, the network on drawn spans and on what the patterns lose."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tallgrass.llm import pii
from tallgrass.llm.pii import KINDS, Tagger, base_spans, find_personal_data, fits, op13_personal_data, reconcile

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
            ok = (True, kind != 1 or all(int(p) <= 255 for p in s.split(".")), 14 <= len(d) <= 19 and sum(doubled) % 10 == 0, 10 <= len(d) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    words = ["the", "and", "une", "eau", "für", "über", "casa", "ñ", "on.", "re,"]
    return pii.train([" ".join(rng.choice(words) for _ in range(20)) for _ in range(200)])


def test_patterns_equal_plain_expressions():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b.", "@", "@", ".", "-", " ", "+", "1", "23", "255", "256", "0", "(", ")", "é", "\n", "4111111111111111", "00", "x@y.de"]) for _ in range(rng.randint(0, 30)))
        assert base_spans(text) == plain(text), text


def test_long_words_take_linear_time():
    for piece in ("a", "1", "@", "1.", "+1", "a@", "1 "):
        base_spans(piece * (400_000 // len(piece)))


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii.fresh_parameters(rng).items()}
    draw = random.Random(3)
    x, y = (np.stack(a)[:, :15] for a in zip(*(pii.example("a 12 b@c.de und", draw) for _ in range(3)), strict=True))
    _, g = pii.loss_and_gradients(p, x, y)
    for k in p:
        for _ in range(3):
            i = tuple(int(rng.integers(0, n)) for n in p[k].shape)
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-3
            down[k][i] -= 1e-3
            slope = (pii.loss_and_gradients(up, x, y)[0] - pii.loss_and_gradients(down, x, y)[0]) / 2e-3
            assert abs(slope - g[k][i]) < 1e-3 + 0.01 * abs(slope), k


def test_best_tags_and_marginals_equal_all_sequences():
    rng = np.random.default_rng(1)
    p = {"t": rng.normal(0, 1, (pii.TAGS, pii.TAGS)), "s": rng.normal(0, 1, pii.TAGS)}
    em = rng.normal(0, 1, (4, 2, pii.TAGS))
    for w in range(2):
        paths = np.indices((pii.TAGS,) * 4).reshape(4, -1).T
        score = p["s"][paths[:, 0]] + sum(em[t, w, paths[:, t]] for t in range(4)) + sum(p["t"][paths[:, t], paths[:, t + 1]] for t in range(3))
        assert pii.best_tags(p, em)[w].tolist() == paths[score.argmax()].tolist()
        weight = np.exp(score) / np.exp(score).sum()
        probs = pii.marginals(p, em)[0]
        assert np.allclose([[weight[paths[:, t] == k].sum() for k in range(pii.TAGS)] for t in range(4)], probs[:, w])


def test_held_out_spans_are_found(model):
    rng, right, total = random.Random(77), 0, 0
    for _ in range(300):
        kinds = [rng.randrange(4) for _ in range(rng.choice([1, 2]))]
        text, gold = "the une casa ", []
        for kind in kinds:
            drawn = pii._drawn(kind, rng)
            gold.append((len(text), kind, len(text) + len(drawn)))
            text += drawn + " "
        text += "und eau the."
        got = {(s, k, e) for s, k, e, _ in Tagger(model).spans([text])[0]}
        right, total = right + sum(g in got for g in gold), total + len(gold)
    assert right >= 0.9 * total


def test_what_patterns_lose_is_added(model):
    """Two cards in a row are one match of 32 digits; a phone number before an address swallows it."""
    for text, lost in (("und 4111111111111111 5555555555554444 the", ["4111111111111111", "5555555555554444"]), ("casa +1 (826) 555-4081 190.137.223.204 une", ["+1 (826) 555-4081"])):
        base = base_spans(text)
        added = reconcile(text, Tagger(model).spans([text])[0], base)
        assert [text[s:e] for s, _, e, _ in added] == lost
    assert reconcile("un", [], []) == []


def test_clean_texts_stay_clean(model):
    for text in ("Version 4.0.1 of 2024-01-05 costs 12.50, see #12345 @ 7.", 'token = "87e15d78b9d8ef29b6c10061e3551a60fa07e990"', "9807915762804491 is no card: its check digit is wrong", "1 2 3 4 5 6 7 8 9 10 11 12"):
        assert base_spans(text) + reconcile(text, Tagger(model).spans([text])[0], base_spans(text)) == []


def test_windows_are_reconciled(model):
    """A span is found once, wherever it lies in the windows, with the same ends."""
    for at in range(0, 200, 7):
        text = "x" * 3 + " une" * (at // 4) + " " + "+49 (030) 555-4081 10.2.3.4 " + "und " * 30
        got = reconcile(text, Tagger(model).spans([text])[0], base_spans(text))
        assert [text[s:e] for s, _, e, _ in got] == ["+49 (030) 555-4081"]


def test_scheduling_takes_the_greatest_weight():
    text = "4111111111111111 5555555555554444"
    spans = [(0, 2, 16, 15.0), (17, 2, 33, 15.0), (10, 3, 20, 3.0), (0, 2, 16, 12.0)]
    assert [(s, k, e) for s, k, e, _ in reconcile(text, spans, [])] == [(0, 2, 16), (17, 2, 33)]
    assert [(s, k, e) for s, k, e, _ in reconcile(text, spans, [(14, 0, 18)])] == []


def test_query(spark, sf):
    """Base columns equal plain expressions on whole texts, base spans stay, and added ones have their kind's form and overlap none."""
    got = {r["doc_id"]: r for r in op13_personal_data(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got.values()) > 0
    for doc_id, text in rows:
        base, r = plain(text or ""), got[doc_id]
        named = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s in named] == named
        for span in set(spans) - set(named):
            kind, s, e = span.split(":")
            assert fits(KINDS.index(kind), text[int(s) : int(e)]) and not any(s2 < int(e) and int(s) < e2 for s2, _, e2 in base)


def test_awkward_rows(spark, model, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 5)
    schema = "doc_id long, text string, personal_data string, _spans int, kind string"
    assert find_personal_data(spark.createDataFrame([], schema), model=model).collect() == []
    assert find_personal_data(spark.createDataFrame([], schema)).collect() == []  # learns from no row too
    long = "a" * 1_000_000 + " x@y.de " + "1" * 1_000_000
    rows = [(1, "x@y.de é x@z.fr", "u", 2, "v")] * 2 + [(None, None, None, None, None), (2, "", "", 0, ""), (None, long, "w", 1, "x")]
    got = find_personal_data(spark.createDataFrame(rows, schema), model=model).collect()
    assert sorted((r["doc_id"] or 0, r["_spans"] or 0, [(s["kind"], s["start"], s["end"], s["base"]) for s in r["personal_data"]]) for r in got) == [
        (0, 0, []), (0, 1, [("email", 1_000_001, 1_000_007, True)]), (1, 2, [("email", 0, 6, True), ("email", 9, 15, True)]), (1, 2, [("email", 0, 6, True), ("email", 9, 15, True)]), (2, 0, [])]
