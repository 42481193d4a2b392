"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes, the last one padded with zeros. A window's bytes are embedded; filters of several widths slide over them; each filter keeps
its maximum; a softmax over the filters gives the language. The text's prediction is the softmax of its windows' logits, averaged by their bytes. Training is
plain numpy on the driver, on all windows of a bounded sample of labelled documents; only the small model travels to the executors.

To predict, embedding and filter are multiplied out once: a filter of width w is w tables from byte to response, so that a convolution is w look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out
from .learning import class_sample, seldom

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
#: The sample that the network is fitted on: labelled documents of each language that is a class, see learning.py (a quarter more at most).
PER_LANGUAGE = 400
#: Steps of training, so many passes over the sample as they make, one at least.
STEPS, BATCH, RATE, SEED = 1500, 64, 4e-3, 11
BLOCK = 128


def windows_of(data: bytes) -> np.ndarray:
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = SEED) -> dict:
    """Fits the network to windows x (n by WINDOW, uint8) of classes y by Adam; a part of the windows is shortened, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.3, (256, EMBED)), "v": np.zeros((len(WIDTHS) * FILTERS, classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        p[f"k{w}"] = rng.normal(0, (EMBED * w) ** -0.5, (EMBED * w, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["e"][0] = 0
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    t = 0
    for _ in range(-(-STEPS * BATCH // len(x)) if len(x) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            xb, yb = x[rows].copy(), y[rows]
            short = rng.random(len(rows)) < 0.3
            ends = np.where(short, rng.integers(12, WINDOW, len(rows)), WINDOW)
            xb[np.arange(WINDOW) >= ends[:, None]] = 0
            g = _gradients(p, xb, yb)
            t += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
            p["e"][0] = 0
    return p


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> dict:
    n, e = len(x), p["e"][x]
    pooled, where, cols = [], [], []
    for w in WIDTHS:
        c = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
        z = c @ p[f"k{w}"]
        at = z.argmax(axis=1)
        where.append(at)
        cols.append(c)
        pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0] + p[f"b{w}"])
    pre = np.concatenate(pooled, axis=1)
    h = np.maximum(pre, 0)
    logits = h @ p["v"] + p["c"]
    d = np.exp(logits - logits.max(axis=1, keepdims=True))
    d /= d.sum(axis=1, keepdims=True)
    d[np.arange(n), y] -= 1
    d /= n
    g = {"v": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
    dh = (d @ p["v"].T) * (pre > 0)
    for i, w in enumerate(WIDTHS):
        dz, at = dh[:, i * FILTERS : (i + 1) * FILTERS], where[i]
        picked = np.take_along_axis(cols[i], at[:, :, None], axis=1)  # document, filter, width * embedding
        g[f"k{w}"] = np.einsum("nf,nfc->cf", dz, picked)
        g[f"b{w}"] = dz.sum(axis=0)
        back = (dz[:, :, None] * p[f"k{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
        for j in range(w):
            np.add.at(g["e"], np.take_along_axis(x, at + j, axis=1), back[:, :, j])
    return g


class Predictor:
    """Logits of windows by look-up tables."""

    def __init__(self, p: dict):
        self.tables = {w: [np.ascontiguousarray(p["e"] @ p[f"k{w}"][j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(w)] for w in WIDTHS}
        self.bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])
        self.v, self.c = p["v"], p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.c)), np.float32)
        for at in range(0, len(x), BLOCK):
            b = x[at : at + BLOCK]
            pooled = []
            for w, tables in self.tables.items():
                n = WINDOW - w + 1
                z = tables[0].take(b[:, :n], axis=0)
                for j in range(1, w):
                    z += tables[j].take(b[:, j : j + n], axis=0)
                pooled.append(z.max(axis=1))
            out[at : at + BLOCK] = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.v + self.c
        return out


def fit(docs: DataFrame, *, text_col: str, lang_col: str, key: list[str]) -> tuple[list[str], dict]:
    """Languages and parameters, from the rows of docs that have a text with a letter and a language. No such row: no language.

    PER_LANGUAGE documents (a quarter more at most) of each of the learning.CLASSES most frequent languages are used, each with all windows of its text; texts over learning.LONG bytes are drawn the less often the longer they are.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, text, draw in zip(b["lang"], b["text"], b["draw"], strict=True):
                if has_letter(text):
                    rows.append((lang, windows_of(text.encode("utf-8", "surrogatepass")).tobytes(), draw))
            yield pd.DataFrame(rows, columns=["lang", "windows", "draw"])

    learn = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    sample, bound = class_sample(learn, "lang", [f"_k{i}" for i in range(len(key))] + ["text"], per_class=PER_LANGUAGE)
    sample = sample.where(seldom(F.col("_draw"), F.col("text")))
    rows = sample.select("lang", "text", F.col("_draw").alias("draw")).mapInPandas(cut, "lang string, windows binary, draw bigint").orderBy("draw", "lang", "windows").limit(bound).collect()
    langs = sorted({r["lang"] for r in rows})
    parts = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in rows]
    x = np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.uint8)
    y = np.repeat([langs.index(r["lang"]) for r in rows], [len(q) for q in parts]).astype(int)
    return langs, train(x, y, len(langs))


def predict_udf(langs: list[str], params: dict):
    predictor = Predictor(params)

    def predict(texts: pd.Series) -> pd.DataFrame:
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if langs and t and has_letter(t)]
        at = 0
        while at < len(known):  # some texts at a time, a very long one alone
            group, size = [], 0
            while at < len(known) and (not group or size + len(texts.iloc[known[at]]) < 1 << 20):
                size += len(texts.iloc[known[at]])
                group.append(known[at])
                at += 1
            data = [texts.iloc[i].encode("utf-8", "surrogatepass") for i in group]
            parts = [windows_of(d) for d in data]
            first = np.cumsum([0] + [len(w) for w in parts[:-1]])
            logits = predictor.logits(np.concatenate(parts))
            weight = np.concatenate([np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(w))) for d, w in zip(data, parts, strict=True)])
            mean = np.add.reduceat(logits * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
            e = np.exp(mean - mean.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            best = e.argmax(axis=1)
            for i, b, row in zip(group, best, e, strict=True):
                labels[i], scores[i] = langs[b], float(row[b])
        return pd.DataFrame({"lang": labels, "score": np.clip(scores, 0.0, 1.0)})

    return F.pandas_udf(predict, "lang string, score double")


def identify(docs: DataFrame, learn_from: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", out: str = "language") -> DataFrame:
    """Adds the struct column out (lang, score) to docs, predicted from the text alone; a column of that name is replaced.

    lang is one of the languages of learn_from, or und with score 0 if the text is null or has no letter, or if there is nothing to learn from. Empty tables, null ids, repeated rows
    and very long texts are allowed; equal texts get equal results.
    """
    langs, params = fit(learn_from, text_col=text_col, lang_col=lang_col, key=[id_col])
    return docs.withColumn(out, predict_udf(langs, params)(F.col(text_col)))


def keep_identified(docs: DataFrame, learn_from: DataFrame, *, least: float = 0.5, languages: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is told with a score of at least `least`, and is one of `languages` (null: of all that were learned), with all their columns. A null lang_col is filled with that language.

    Texts that are null or have no letter are never told. Where nothing can be learned, as no row has a language and a text with a letter, all rows stay as they are.
    """
    langs, params = fit(learn_from, text_col=text_col, lang_col=lang_col, key=[id_col])
    if not langs:
        return docs
    column = fresh(docs, "_language")
    once = predict_udf(langs, params).asNondeterministic()  # else the filter and the column would each predict
    told = docs.withColumn(column, once(F.col(text_col))).where(F.col(column)["lang"].isin([x for x in langs if languages is None or x in languages]) & (F.col(column)["score"] >= least))
    return told.withColumn(lang_col, F.coalesce(lang_col, F.col(column)["lang"].cast(docs.schema[lang_col].dataType))).drop(column)


def op1_byte_cnn_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; the text and language of held-out rows are never learned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, docs.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
