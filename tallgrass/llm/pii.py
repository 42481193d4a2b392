"""Personal data in texts: e-mail addresses, IP addresses, card numbers and phone numbers.

Patterns give the base spans. A character-level bidirectional LSTM with CRF transitions adds what greedy patterns swallow or lose, such as two card numbers in a row, or a phone number before an address. It is trained in
plain numpy, by the gradient of the CRF's likelihood, from labelled spans: those that patterns find in a bounded sample of the documents, and drawn ones that are put into the sample's texts.

Texts are decoded in overlapping windows, so far as these hold a digit or an @, as every span of the four kinds does. The windows' spans are reconciled over the whole text: parts that an edge has cut are united, and of overlapping
spans the set of greatest total weight stays, by interval scheduling. An added span has to have the exact form of its kind (octets, number of digits, check digit) and must not meet a base span; base spans always stay.

Only the sample's short snippets and the small model pass through the driver. Each text is worked on by itself in Arrow batches.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: The form of each kind.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WHOLE = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), _IP, _CARD, _PHONE)

WINDOW, STRIDE = 96, 48
EMBED, HIDDEN = 12, 16
TAGS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind
#: The sample: documents (a quarter more at most), and snippets of WINDOW characters from each at most.
SAMPLE, SNIPPETS = 1500, 6
STEPS, BATCH, RATE, SEED = 400, 40, 8e-3, 7
#: Windows that are decoded at once, and the characters by which an end of a span may be moved to the end of a word.
BLOCK, REACH = 512, 256


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind: int, s: str) -> bool:
    """Whether a string that has the pattern of its kind is one."""
    if kind == IP:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[-3:] or 0) <= 255 for p in s.split("."))
    if kind == CARD:
        number = digits(s)
        return 14 <= len(number) <= 19 and luhn(number)
    return kind != PHONE or 10 <= len(digits(s)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, found from each @, so that a long word without one isn't tried from each of its letters."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = text[done:at]
        begin = done + len(local.rstrip(LOCAL))
        match = _DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            yield begin, match.end()
        done = match.end() if match else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that are of their kind: leftmost and without overlap for each kind; what fails isn't tried again from another place."""
    out = [(s, EMAIL, e) for s, e in _emails(text)]
    for kind, pattern, mark in ((IP, _IP, "."), (CARD, _CARD, ""), (PHONE, _PHONE, "+")):
        if mark in text:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if fits(kind, m.group())]
    return sorted(out)


def codes(text: str) -> np.ndarray:
    """A class for each character: 0 padding, ASCII as it is, and one each for other letters and other characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points < 128, points, 129).astype(np.uint8)
    for i in np.flatnonzero(points >= 128):
        out[i] = 128 if text[i].isalpha() else 129
    out[points == 0] = 1
    return out


CLASSES = 130


# Training examples


def _drawn(kind: int, rng: random.Random) -> str:
    """A string of the shape of a kind."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    if kind == EMAIL:
        local = rng.choice(["", ".", "_", "-", "+"]).join([rng.choice([word(), word().upper(), n(2), word() + n(2)]) for _ in range(rng.randint(1, 2))])
        return f"{local}@{'.'.join(rng.choice([word(), word() + n(1)]) for _ in range(rng.randint(1, 2)))}.{rng.choice(['com', 'org', 'net', 'de', 'example', 'fr', word()[:3]])}"
    if kind == IP:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == CARD:
        if rng.random() < 0.6:
            return n(rng.choice([16, 16, 16, 14, 15, 19]))
        return rng.choice(" -").join(n(4) for _ in range(4))
    gap = rng.choice([" ", "-", ".", ""])
    area = rng.choice(["({})", "{}", "{}"]).format(n(3))
    return f"+{n(rng.choice([1, 1, 2, 3]))}{rng.choice([' ', gap])}{area}{rng.choice([' ', gap])}{n(3)}{rng.choice(['-', gap])}{n(4)}"


def _other(rng: random.Random) -> str:
    """A string with digits that is of no kind."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return rng.choice([
        "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{n(1)}.{n(1)}.{n(1)}", f"20{n(2)}-0{n(1)}-{n(2)}", n(rng.randint(1, 10)), f"{n(2)}.{n(2)}", n(24), f"@{n(2)}", f"+{n(2)}", f"{n(2)}:{n(2)}", f"#{n(5)}",
    ])


def example(snippet: str, rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of a window: a snippet, with some drawn spans and other strings put in, now and then in a row; spans that the patterns find in the snippet itself are labelled too."""
    pieces: list[tuple[str, int]] = []
    at = 0
    for s, kind, e in base_spans(snippet):
        if s >= at:
            pieces += [(snippet[at:s], -1), (snippet[s:e], kind)]
            at = e
    pieces.append((snippet[at:], -1))
    if rng.random() < 0.8:
        where = rng.randrange(len(pieces))
        if pieces[where][1] < 0:
            text = pieces[where][0]
            cut = rng.randint(0, len(text))
            cut = text.find(" ", cut) + 1 or cut
            put: list[tuple[str, int]] = []
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                kind = rng.randrange(len(KINDS) + 1)
                put += [(_other(rng), -1) if kind == len(KINDS) else (_drawn(kind, rng), kind), (rng.choice([" ", " ", " ", ", ", "\n", ". "]), -1)]
            pieces[where : where + 1] = [(text[:cut], -1), *put, (text[cut:], -1)]
    text = "".join(p for p, _ in pieces)
    tags = np.zeros(len(text), np.int64)
    at = 0
    for piece, kind in pieces:
        if kind >= 0:
            tags[at] = 1 + 2 * kind
            tags[at + 1 : at + len(piece)] = 2 + 2 * kind
        at += len(piece)
    first = rng.randint(0, max(0, len(text) - WINDOW))
    x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
    cut = text[first : first + WINDOW]
    x[: len(cut)], y[: len(cut)] = codes(cut), tags[first : first + WINDOW]
    return x, y


# The network


def fresh_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"e": rng.normal(0, 0.3, (CLASSES, EMBED)), "o": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
    for d in "fb":
        p |= {f"w{d}": rng.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN)), f"u{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(z: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states over time from the inputs' share of the gates (time, window, 4 HIDDEN): forget, in, out gates and new content."""
    h = c = np.zeros((z.shape[1], HIDDEN), np.float32)
    out, held = np.empty((len(z), z.shape[1], HIDDEN), np.float32), []
    for t in range(len(z)):
        a = z[t] + h @ u
        gates = _sigmoid(a[:, : 3 * HIDDEN])
        new = np.tanh(a[:, 3 * HIDDEN :])
        before, past = c, h
        c = gates[:, :HIDDEN] * c + gates[:, HIDDEN : 2 * HIDDEN] * new
        squashed = np.tanh(c)
        h = gates[:, 2 * HIDDEN :] * squashed
        out[t] = h
        if keep:
            held.append((gates, new, before, squashed, past))
    return out, held


def _lstm_back(dout: np.ndarray, held: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of u."""
    dh = dc = np.zeros(dout.shape[1:], np.float32)
    dz, du = np.empty((*dout.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
    for t in reversed(range(len(dout))):
        gates, new, before, squashed, past = held[t]
        f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - squashed**2)
        da = np.concatenate([dc * before * f * (1 - f), dc * new * i * (1 - i), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
        dz[t] = da
        du += past.T @ da
        dh, dc = da @ u.T, dc * f
    return dz, du


def emissions(p: dict, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Scores of tags (time, window, tag) for windows x (window, time)."""
    e = p["e"][x.T]
    forward, held_f = _lstm(e @ p["wf"] + p["cf"], p["uf"], keep)
    backward, held_b = _lstm((e @ p["wb"] + p["cb"])[::-1], p["ub"], keep)
    h = np.concatenate([forward, backward[::-1]], axis=2)
    return h @ p["o"] + p["ob"], (e, h, held_f, held_b)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(p: dict, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of tags (time, window, tag), expected transitions, and each window's log of the sum over all sequences."""
    n = len(em)
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0] + p["s"]
    for t in range(1, n):
        alpha[t] = em[t] + _logsum(alpha[t - 1][:, :, None] + p["t"], 1)
    for t in reversed(range(n - 1)):
        beta[t] = _logsum(p["t"] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    moves = np.zeros_like(p["t"])
    for t in range(1, n):
        moves += np.exp(alpha[t - 1][:, :, None] + p["t"] + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    return np.exp(alpha + beta - z[:, None]), moves, z


def loss_and_gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of tags y (window, time), and its gradients."""
    em, (e, h, held_f, held_b) = emissions(p, x, True)
    probs, moves, z = marginals(p, em)
    n, tags = len(x), y.T
    steps, windows = np.indices(tags.shape)
    gold = em[steps, windows, tags].sum() + p["s"][tags[0]].sum() + p["t"][tags[:-1], tags[1:]].sum()
    dem = probs
    first = dem[0].sum(axis=0) - np.bincount(tags[0], minlength=TAGS)
    dem[steps, windows, tags] -= 1
    dem /= n
    real = np.zeros_like(moves)
    np.add.at(real, (tags[:-1], tags[1:]), 1)
    g = {"t": (moves - real) / n, "s": first / n, "o": np.einsum("twh,twk->hk", h, dem), "ob": dem.sum(axis=(0, 1))}
    dh = dem @ p["o"].T
    dzf, g["uf"] = _lstm_back(dh[:, :, :HIDDEN], held_f, p["uf"])
    dzb, g["ub"] = _lstm_back(dh[::-1, :, HIDDEN:], held_b, p["ub"])
    dzb = dzb[::-1]
    de = dzf @ p["wf"].T + dzb @ p["wb"].T
    flat = e.reshape(-1, EMBED)
    for d, dz in (("f", dzf), ("b", dzb)):
        g[f"w{d}"], g[f"c{d}"] = flat.T @ dz.reshape(-1, 4 * HIDDEN), dz.sum(axis=(0, 1))
    g["e"] = np.zeros_like(p["e"])
    np.add.at(g["e"], x.T, de)
    return float((z.sum() - gold) / n), {k: v.astype(np.float32) for k, v in g.items()}


def train(snippets: list[str], seed: int = SEED, steps: int | None = None) -> dict[str, np.ndarray]:
    """Fits the network by Adam; examples are drawn from the snippets anew for every step, so a rerun over the same snippets gives the same model."""
    steps = STEPS if steps is None else steps
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    p = fresh_parameters(rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    snippets = snippets or [""]
    for t in range(1, steps + 1):
        x, y = map(np.stack, zip(*(example(draw.choice(snippets), draw) for _ in range(BATCH)), strict=True))
        _, g = loss_and_gradients(p, x, y)
        norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
        rate = RATE * min(1, 2 * (1 - t / (steps + 1)))
        for k in p:
            a = g[k] * min(1, 5 / max(norm, 1e-9))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a**2 - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
    return p


def best_tags(p: dict, em: np.ndarray) -> np.ndarray:
    """The likeliest sequence of tags of each window (window, time), by Viterbi."""
    score, back = em[0] + p["s"], np.empty(em.shape, np.int8)
    for t in range(1, len(em)):
        options = score[:, :, None] + p["t"]
        back[t] = options.argmax(axis=1)
        score = options.max(axis=1) + em[t]
    out = np.empty(em.shape[:2], np.int8)
    out[-1] = score.argmax(axis=1)
    for t in reversed(range(1, len(em))):
        out[t - 1] = back[t][np.arange(out.shape[1]), out[t]]
    return out.T


# Decoding


def window_starts(text: str) -> list[int]:
    """The windows of a text, at multiples of STRIDE, that hold a digit or an @."""
    marked = {m.start() // STRIDE for m in re.finditer(r"[0-9@]", text)}
    return sorted({STRIDE * k for s in marked for k in (s - 1, s) if k >= 0 and (k == 0 or STRIDE * (k + 1) < len(text))})


def _snap(text: str, kind: int, s: int, e: int) -> tuple[int, int] | None:
    """The span widened to whole numbers or words, by REACH characters on each side at most, and cut to its kind's form; None if it has none."""
    inside = LOCAL if kind == EMAIL else "0123456789"
    least, most = max(0, s - REACH), min(len(text), e + REACH)
    while s > least and text[s] in inside and text[s - 1] in inside:
        s -= 1
    while e < most and text[e - 1] in inside and text[e] in inside:
        e += 1
    if s > 0 and s == least or e < len(text) and e == most:
        return None
    if kind == PHONE and s > 0 and text[s - 1] == "+" and text[s] != "+":
        s -= 1
    piece = text[s:e]
    match = next(((s + a, s + b) for a, b in _emails(piece)), None) if kind == EMAIL else (m := _WHOLE[kind].search(piece)) and (s + m.start(), s + m.end())
    return match if match and fits(kind, text[match[0] : match[1]]) else None


def reconcile(text: str, found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """From the windows' spans (start, kind, end, weight) of a text those that are added to base: cut parts are united, forms checked, and of overlapping ones those of greatest total weight chosen."""
    joined: list[list] = []
    for s, kind, e, w in sorted(found):
        same = next((j for j in reversed(joined[-4:]) if j[1] == kind and s < j[2]), None)
        if same:
            same[2], same[3] = max(same[2], e), max(same[3], w)
        else:
            joined.append([s, kind, e, w])
    whole: dict[tuple[int, int, int], float] = {}
    for s, kind, e, w in [*found, *joined]:  # single decodings too, as a union may hold two spans
        if cut := _snap(text, kind, s, e):
            key = cut[0], kind, cut[1]
            whole[key] = max(whole.get(key, 0.0), w)
    taken = sorted((s, e) for s, _, e in base)
    begins = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
    free = []
    for (s, kind, e), w in whole.items():
        at = bisect_right(begins, e - 1)
        if not at or reach[at - 1] <= s:
            free.append((e, s, kind, w))
    free.sort()
    ends, best, choice = [f[0] for f in free], [0.0], []
    for e, s, kind, w in free:  # interval scheduling by ends
        before = bisect_right(ends, s, hi=len(best) - 1)
        choice.append((best[before] + w > best[-1], before))
        best.append(max(best[-1], best[before] + w))
    out, i = [], len(free)
    while i:
        use, before = choice[i - 1]
        if use:
            e, s, kind, w = free[i - 1]
            out.append((s, kind, e, w))
        i = before if use else i - 1
    return sorted(out)


class Tagger:
    def __init__(self, p: dict):
        self.p = p

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """(start, kind, end, weight) of the spans of every window of each text; the weight is the expected number of its characters that are of its kind."""
        out: list[list] = [[] for _ in texts]
        held: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            for s in window_starts(text):
                held.append((i, s))
                if len(held) == BLOCK:
                    self._decode(texts, held, out)
                    held = []
        if held:
            self._decode(texts, held, out)
        return out

    def _decode(self, texts: list[str], held: list[tuple[int, int]], out: list[list]) -> None:
        x = np.zeros((len(held), WINDOW), np.uint8)
        for row, (i, s) in zip(x, held, strict=True):
            cut = texts[i][s : s + WINDOW]
            row[: len(cut)] = codes(cut)
        em, _ = emissions(self.p, x)
        tags, probs = best_tags(self.p, em), marginals(self.p, em)[0]
        for w in np.flatnonzero(tags.any(axis=1)).tolist():
            (i, first), row = held[w], tags[w].tolist()
            room = min(WINDOW, len(texts[i]) - first)
            at = 0
            while at < room:
                kind = (row[at] - 1) // 2
                end = at + 1
                if row[at]:
                    while end < room and row[end] == 2 + 2 * kind:
                        end += 1
                    out[i].append((first + at, kind, first + end, float(probs[at:end, w, [1 + 2 * kind, 2 + 2 * kind]].sum())))
                at = end


def fit(docs: DataFrame, *, id_col: str, text_col: str) -> dict[str, np.ndarray]:
    """The model, from SNIPPETS snippets at most of SAMPLE documents (a quarter more at most), chosen by a hash. An empty table gives a model of drawn spans alone."""
    share = SAMPLE / max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text_col)), F.lit(1 << 31))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, d in zip(b["text"], b["draw"], strict=True):
                rng = random.Random(d)
                marked = window_starts(text)
                starts = rng.sample(marked, min(len(marked), SNIPPETS - 2)) + [rng.randrange(max(1, len(text) - WINDOW)) for _ in range(2)]
                rows += [(d, k, text[s : s + WINDOW].encode("utf-8", "replace").decode()) for k, s in enumerate(starts)]
            yield pd.DataFrame(rows, columns=["draw", "k", "snippet"])

    sample = docs.select(F.col(text_col).alias("text"), draw.alias("draw")).where(F.col("text").isNotNull() & (F.col("draw") < F.lit(min(1 << 31, int(share * (1 << 31)) + 1))))
    got = sample.mapInPandas(cut, "draw bigint, k int, snippet string").orderBy("draw", "k", "snippet").limit(SNIPPETS * SAMPLE * 5 // 4).collect()
    return train([r["snippet"] for r in got])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str = "personal_data", model: dict | None = None) -> DataFrame:
    """Adds to docs the column out, the spans of each text by start, then kind as in KINDS: kind, start and end (code points, end exclusive), whether a pattern has found it, and a score (1 for those). A column of that name is replaced.

    The model is fitted on docs unless it is given. Null and empty texts have no spans. Rows are kept as they are, repeated ones too; equal texts have equal spans.
    """
    model = fit(docs, id_col=id_col, text_col=text_col) if model is None else model
    rest = docs.drop(out)
    column, at = fresh(rest, "_spans"), rest.columns.index(text_col)
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for b in batches:
            found = [[] for _ in range(b.num_rows)]
            texts = [(i, t) for i, t in enumerate(b.column(at).to_pylist()) if t and re.search("[0-9@]", t)]
            for (i, text), spans in zip(texts, tagger.spans([t for _, t in texts]), strict=True):
                base = base_spans(text)
                added = [(s, k, e, False, w / (e - s)) for s, k, e, w in reconcile(text, spans, base)]
                found[i] = [dict(kind=KINDS[k], start=s, end=e, base=is_base, score=min(1.0, w)) for s, k, e, is_base, w in sorted([(s, k, e, True, 1.0) for s, k, e in base] + added)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(one))], names=[*b.schema.names, column])

    schema = T.StructType([*rest.schema.fields, T.StructField(column, T._parse_datatype_string(_SPANS))])
    return rest.mapInArrow(run, schema).withColumnRenamed(column, out)


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    """Base spans of every document by kind, their hash, and all spans with those that the network adds."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("personal_data", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed("personal_data").alias("spans"))
