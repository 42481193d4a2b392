"""Periodic runs in texts: stretches of words that repeat with a period.

A run has a smallest period q and a length of at least max(LEAST, 2 q), and can't be extended. Every word of it occurs twice in it at least, so a word that occurs once within a segment can't be in a run and splits the segment;
what is left is counted again, segment by segment, until no segment is split any more. Surviving segments are scanned lag by lag: where words that are q apart are equal for long enough lies a run.

A run of period q matches itself at lag q over step = max(q, LEAST - q) words at least, so one of every step-th places lies in that match. Each lag is therefore looked at in every step-th place only, n log n places for all
lags of a segment, and where the words agree the match is extended to both sides by names of grams whose length doubles. No run is lost.

A text is worked on by itself in Arrow batches: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

LEAST = 12
#: Places that are looked at at once.
BLOCK = 1 << 20


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """The segments (begin, end) of LEAST words or more in which every word occurs twice at least, by recursive splitting. All segments of a level are split at once."""
    kinds = int(ids.max()) + 1 if len(ids) else 1
    begin, end = np.array([0]), np.array([len(ids)])
    while len(begin):
        long = end - begin >= LEAST
        begin, end = begin[long], end[long]
        if not len(begin):
            break
        size = end - begin
        owner = np.repeat(np.arange(len(begin)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
        _, of, count = np.unique(owner * kinds + ids[at], return_inverse=True, return_counts=True)
        stays = count[of] > 1
        if stays.all():
            break
        joined = stays[1:] & stays[:-1] & (owner[1:] == owner[:-1])  # with the word before it
        opens = np.flatnonzero(stays & ~np.concatenate([[False], joined]))
        closes = np.flatnonzero(stays & ~np.concatenate([joined, [False]]))
        begin, end = at[opens], at[closes] + 1
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def grams(ids: np.ndarray) -> list[np.ndarray]:
    """Names of all grams of 1, 2, 4, ... words that equal grams share, as long as one is repeated."""
    out, g = [ids], 1
    while 2 * g <= len(ids):
        names = out[-1].astype(np.int64)
        longer = names[:-g] * (int(names.max()) + 1) + names[g:]
        distinct, names = np.unique(longer, return_inverse=True)
        if len(distinct) == len(names):
            break
        out.append(names.astype(np.int32))
        g *= 2
    return out


def scan(ids: np.ndarray, first: int = 0) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a segment whose first word has the number first."""
    n, names, found = len(ids), grams(ids), {}
    lag = np.arange(1, n // 2 + 1)
    step = np.maximum(lag, LEAST - lag)
    places = -(-(n - lag) // step)
    upto = np.cumsum(places)
    at = 0
    while at < len(lag):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK)))
        q = np.repeat(lag[at:to], places[at:to])
        i = (np.arange(len(q)) - np.repeat(np.cumsum(places[at:to]) - places[at:to], places[at:to])) * np.repeat(step[at:to], places[at:to])
        at = to
        same = ids[i] == ids[i + q]
        i, q = i[same], q[same]
        begin, end = i.copy(), i + q  # the match, begin inclusive, end exclusive at the later of the two places
        for level in reversed(range(len(names))):
            g, name = 1 << level, names[level]
            room = np.flatnonzero(end + g <= n)
            end[room[name[end[room]] == name[end[room] - q[room]]]] += g
            room = np.flatnonzero(begin >= g)
            begin[room[name[begin[room] - g] == name[begin[room] - g + q[room]]]] -= g
        long = np.flatnonzero(end - begin >= np.maximum(LEAST, 2 * q))
        for s, e, period in zip(begin[long].tolist(), end[long].tolist(), q[long].tolist(), strict=True):  # lags ascend: a multiple of the period finds the same stretch later
            found.setdefault((s, e), period)
    return [(first + s, e - s, period) for (s, e), period in found.items()]


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period."""
    return sorted((r for b, e in segments(ids) for r in scan(ids[b:e], b)), key=lambda r: (r[0], r[2]))


def words_of(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of a text in UTF-8, and a number for each that equal words share."""
    words, numbers = (text or "").encode("utf-8", "surrogatepass").split(), {}
    return words, np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if of each run its first period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def planted(n: int, key: object) -> np.ndarray:
    """The number of the original word at each of n places: for one key in ten (by its CRC-32) the words from a place on repeat with a period. A null key plants nothing."""
    at = np.arange(n)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at >= a, a + (at - a) % p, at)


_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _found(id_at: int | None, text_at: int, plant: bool):
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_runs, texts = [], []
            keys = b.column(id_at).to_pylist() if plant else [None] * b.num_rows
            for key, text in zip(keys, b.column(text_at), strict=True):
                words, ids = words_of(text.as_py())
                if plant:
                    order = planted(len(words), key)
                    ids = ids[order]
                found = runs(ids)
                all_runs.append([dict(start=s, length=n, period=q) for s, n, q in found])
                stay = np.flatnonzero(kept(len(words), found))
                texts.append(b" ".join([words[i] for i in (order[stay] if plant else stay)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(all_runs, pa.list_(one)), pa.array(texts, pa.binary()).cast(pa.string())], names=[*b.schema.names, "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str = "runs", collapsed: str = "collapsed", plant: bool = False) -> DataFrame:
    """Adds to docs the columns out, an array of all runs (start, length, period) by start, then period, and collapsed, the words that no run repeats, joined by one space. Columns of these names are replaced.

    Null and empty texts have no runs and collapse to the empty string. With plant, repetitions are planted by the id first (see planted), and both columns tell of the altered text. Rows are kept as they are, repeated ones
    too; equal texts have equal runs.
    """
    rest = docs.drop(out, collapsed)
    a, b = fresh(rest, "_runs"), fresh(rest, "_collapsed")
    schema = T.StructType([*rest.schema.fields, T.StructField(a, T._parse_datatype_string(_RUN)), T.StructField(b, T.StringType())])
    names = rest.columns
    got = rest.mapInArrow(_found(names.index(id_col) if plant else None, names.index(text_col), plant), schema)
    return got.withColumnsRenamed({a: out, b: collapsed})


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document after planted repetitions: their number, the longest, and hashes of all of them and of the text without repeated words; no run: nulls, and the hash of the empty string for the runs."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
    first = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
