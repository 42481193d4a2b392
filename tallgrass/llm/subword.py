"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams inside words (over UTF-8 bytes) are hashed into BUCKETS vectors that are learned. A document is the average of its
features' vectors; a softmax over it gives the class. Training is stochastic gradient descent in numpy on the driver, over the whole texts of a bounded sample of labelled documents. As the
softmax of an average is linear up to its end, executors need one number a bucket to score a text.

A word that repeats the word before it forms one and the same pair feature whatever the word is, so that repetition is seen in words that were never seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out
from .learning import class_sample, seldom

BUCKETS, DIM, NGRAMS = 1 << 18, 16, (3, 4)
#: The sample that the classifier is fitted on: labelled rows of each class (a quarter more at most).
PER_CLASS = 1000
#: Passes over the sample; of a small one as many as it takes for so many steps.
EPOCHS, STEPS, RATE, SEED = 8, 8000, 0.4, 5
#: Bytes of text that are hashed at once. A longer text is taken piece by piece, cut where a word has ended.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x00-\x20]")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_REPEAT = 1


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(salt * 0x9E3779B9 & 0xFFFFFFFF)
    return (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def features(data: bytes, first: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Arrays of features and of the byte positions where they begin, for the words, the word pairs and each n-gram length. Words of different texts, which begin at first, make no pair."""
    a = np.frombuffer(data, np.uint8)
    inside = a > 32
    if not inside.any():
        return []
    x = a.astype(np.uint32) + np.uint32(1)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word's hash is the sum of its bytes, each times a multiplier of its place
    place = np.arange(len(a)) - np.repeat(start, end - start).take(np.cumsum(inside) - 1)
    mixed = np.where(inside, x * (np.uint32(2654435761) * (place.astype(np.uint32) * np.uint32(2) + np.uint32(1)) ^ (x << np.uint32(7))), np.uint32(0)).astype(np.uint32)
    word = np.add.reduceat(mixed, start, dtype=np.uint32) if len(start) else np.zeros(0, np.uint32)
    out = [(_bucket(word, 1), start)]
    if len(word) > 1:
        pair = np.where(word[1:] == word[:-1], np.uint32(_REPEAT), word[:-1] * np.uint32(31) + word[1:])
        text = np.searchsorted([0] if first is None else first, start, side="right")
        own = text[1:] == text[:-1]
        out.append((_bucket(pair[own], 2), start[1:][own]))
    gaps = np.concatenate(([0], np.cumsum(~inside)))
    for n in NGRAMS:
        if len(a) >= n:
            h = sum((x[i : len(a) - n + 1 + i] * _MIX[i] for i in range(1, n)), x[: len(a) - n + 1] * _MIX[0])
            whole = gaps[n:] == gaps[: len(a) - n + 1]
            out.append((_bucket(h[whole], 10 + n), np.flatnonzero(whole)))
    return out


def _pieces(data: bytes) -> Iterator[tuple[bytes, int]]:
    """Pieces of a text, each with the number of its first bytes that are the end of the piece before: its last word, so that the pair with it isn't lost. Features that begin there have been counted."""
    begin = at = 0
    while len(data) - at > PIECE and (gap := _GAP.search(data, at + PIECE)):
        cut = gap.start()
        yield data[begin:cut], at - begin
        inside = np.frombuffer(data, np.uint8, cut - begin, begin) > 32
        words = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
        begin, at = begin + int(words[-1]) if len(words) else cut, cut
    yield data[begin:], at - begin


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a whole text, ascending, and how often each occurs."""
    found = [f[at >= known] for piece, known in _pieces((text or "").encode("utf-8", "surrogatepass")) for f, at in features(piece)]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The weight of each bucket for class 1 against class 0, and the bias, from the distinct features and their counts of each document."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, c = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    shares = [(n / max(1, n.sum())).astype(np.float32) for _, n in docs]
    epochs = max(EPOCHS, -(-STEPS // len(docs))) if len(docs) else 0
    steps, at = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate = np.float32(RATE * (1 - at / steps))
            at += 1
            f, share = docs[i][0], shares[i]
            v = share @ e[f]
            z = v @ w + c
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= rate * np.outer(v, p)
            c -= rate * p
            e[f] -= np.outer(share, rate * np.float32(8) * back)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(c[1] - c[0])


def _learn_udf():
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, label, d in zip(b["text"], b["label"], b["draw"], strict=True):
                f, n = text_features(text)
                rows.append((np.concatenate([f, n]).astype("<u4").tobytes(), label, d))
            yield pd.DataFrame(rows, columns=["features", "label", "draw"])

    return learn


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_id: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Bucket weights and bias, from the documents that labels gives a 0 or 1. Without any, all weights are 0. An id that is labelled twice counts twice.

    The sample is drawn from labels: PER_CLASS rows (a quarter more at most) of each class, which are then sent to where the documents are; texts over learning.LONG bytes are drawn the less often the longer they are.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull()).select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("label"))
    sample, bound = class_sample(marked, "label", ["_id"], per_class=PER_CLASS)
    picked = sample.orderBy("_draw", "_id", "label").limit(bound)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id").where(F.col("text").isNull() | seldom(F.col("_draw"), F.col("text"))).select("text", "label", F.col("_draw").alias("draw"))
    got = rows.mapInPandas(_learn_udf(), "features binary, label int, draw bigint").orderBy("draw", "label", "features").limit(bound).collect()
    return train([tuple(np.frombuffer(r["features"], "<u4").reshape(2, -1)) for r in got], np.array([r["label"] for r in got], int))


def score_udf(weights: np.ndarray, bias: float):
    def score(texts: pd.Series) -> pd.Series:
        total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)

        def add(rows: list[int], parts: list[tuple[bytes, int]]) -> None:
            first = np.cumsum([0] + [len(p) + 1 for p, _ in parts])
            known = np.array([k for _, k in parts])
            for f, at in features(b"\n".join(p for p, _ in parts), first):
                row = np.searchsorted(first, at, side="right") - 1
                if known.any():
                    new = at >= (first[:-1] + known)[row]
                    f, row = f[new], row[new]
                total[rows] += np.bincount(row, weights[f], len(rows))
                count[rows] += np.bincount(row, minlength=len(rows))

        rows, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for piece in _pieces((text or "").encode("utf-8", "surrogatepass")):
                if rows and (size + len(piece[0]) > PIECE or rows[-1] == i):
                    add(rows, parts)
                    rows, parts, size = [], [], 0
                rows.append(i)
                parts.append(piece)
                size += len(piece[0])
        if rows:
            add(rows, parts)
        z = bias + total / np.maximum(count, 1)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return F.pandas_udf(score, "double")


def score_quality(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", out: str = "quality_score") -> DataFrame:
    """Adds the column out (0 to 1, higher: class 1 likelier) to docs, from the text alone; a column of that name is replaced.

    Null, empty and blank texts have no features and get the bias alone. With no labelled row in learn_from, all scores are 0.5. Equal texts get equal scores.
    """
    weights, bias = fit(learn_from, labels, id_col=id_col, text_col=text_col, label_id=id_col, label_col=label_col)
    return docs.withColumn(out, score_udf(weights, bias)(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **names: str) -> DataFrame:
    """The rows of docs with a score of at least `least`, with all their columns."""
    column = fresh(docs, "_quality")
    return score_quality(docs, docs, labels, out=column, **names).where(F.col(column) >= least).drop(column)


def op7_subword_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out rows are never learned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    scored = score_quality(docs, docs, labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
