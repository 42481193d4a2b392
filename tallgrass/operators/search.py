"""Full-text search by positional postings: every word of a query must occur; the rank weighs fields, occurrences and how near the words stand to each other."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.stemming import porter

#: Places of different fields are so far apart.
FIELD = 1 << 32

#: Asked words that are broadcast; with more of them the words of all documents are shuffled.
BROADCAST_WORDS = 100_000

#: Places that one step of _stretches works on.
PLACES = 1 << 20


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def postings(docs: DataFrame, doc_id: str, fields: dict[str, float], *, stems: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Rows (word, doc, score, places): each word of each document, or its stem, with the sum over the fields of weight x (1 + ln of its occurrences there), and all its places in ascending order.

    fields maps text columns to weights; null texts have no words; rows with one id are one document, whose places may repeat. only (word) keeps the postings of these words or stems, so that no others are grouped; then the distinct words
    of all documents are stemmed once.
    """
    each = [docs.select(F.col(doc_id).alias("doc"), F.lit(i).alias("field"), F.lit(w).alias("weight"), F.posexplode(_words(F.col(c))).alias("at", "word")) for i, (c, w) in enumerate(fields.items())]
    rows = reduce(lambda a, b: a.union(b), each)
    if only is not None:
        wanted = only.select(F.col("word").alias("form")).distinct()
        if stems:
            wanted = rows.select("word").distinct().withColumn("form", porter(F.col("word"))).join(wanted, "form", "left_semi").select("word", "form")
        else:
            wanted = wanted.withColumn("word", F.col("form"))
        wanted = wanted.persist()
        rows = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted, "word").drop("word").withColumnRenamed("form", "word")
    found = rows.groupBy("doc", "word", "field", "weight").agg(F.collect_list(F.col("at").cast("long") + F.col("field").cast("long") * FIELD).alias("places"))
    if stems and only is None:
        found = found.withColumn("word", porter(F.col("word")))
    by_field = found.groupBy("doc", "word", "field", "weight").agg(F.flatten(F.collect_list("places")).alias("places"))
    score = F.sum(F.col("weight") * (1 + F.log(F.size("places").cast("double"))))
    return by_field.groupBy("word", "doc").agg(score.alias("score"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))


def asked_words(queries: DataFrame, query_id: str, text_col: str, *, stems: bool = True) -> DataFrame:
    """Rows (q, word): the distinct words of each query, or their stems."""
    return queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(F.transform(_words(F.col(text_col)), porter if stems else lambda w: w))).alias("word")).distinct()


def stretches(places: np.ndarray, sizes: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """For each row, the length of the shortest stretch that has a place of each of its lists (0: one place). places holds the lists of all rows one after another, sizes the lengths of these lists, all over 0, and lists how many a row has."""
    row = np.repeat(np.repeat(np.arange(len(lists)), lists), sizes)
    of = np.repeat(np.concatenate([np.arange(n) for n in lists]), sizes)
    order = np.lexsort((places, row))
    p, row, of = places[order], row[order], of[order]
    first = np.searchsorted(row, np.arange(len(lists)))
    low, whole, at = p.copy(), np.ones(len(p), bool), np.arange(len(p))
    for j in range(int(lists.max())):
        last = np.maximum.accumulate(np.where(of == j, at, -1))
        needed = lists[row] > j
        known = last >= first[row]
        low = np.where(needed & known, np.minimum(low, p[last]), low)
        whole &= known | ~needed
    return np.minimum.reduceat(np.where(whole, p - low, np.iinfo(np.int64).max), first)


def _stretches(places: pd.Series, sizes: pd.Series) -> pd.Series:
    """The shortest stretch of each row, a block of rows at a time."""
    ends = np.cumsum([len(p) for p in places])
    out, start = [], 0
    while start < len(places):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + PLACES, "right")))
        own, by = places.iloc[start:end], sizes.iloc[start:end]
        out.append(stretches(np.concatenate(own.to_list()).astype(np.int64), np.concatenate(by.to_list()).astype(np.int64), np.array([len(x) for x in by])))
        start = end
    return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))


def match_all(post: DataFrame, queries: DataFrame, query_id: str, text_col: str, *, k: int | None = None, stems: bool = True) -> DataFrame:
    """Rows (query_id, doc, rank, k): the documents that have every distinct word of a query, best first; k of them at most (None: all); ties go to the smaller document. A query without words finds nothing.

    The rank is the sum of the words' scores x (1 + 1 / (1 + s)), s being the other words in the shortest stretch that has all of them. A query's documents begin with the postings of its rarest word, and its other words are looked up
    for these alone, so that no query reads the postings of a frequent word as a whole unless it has only such words.
    """
    asked = asked_words(queries, query_id, text_col, stems=stems)
    common = post.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    known = asked.join(common, "word", "left").groupBy("q").agg(F.count("*").alias("need"), F.count("n").alias("have"), F.min_by("word", F.struct("n", "word")).alias("rarest")).where("need = have").select("q", "need", "rarest")
    first = known.join(post.withColumnRenamed("word", "rarest"), "rarest").select("q", "need", "doc", F.col("rarest").alias("word"), "score", "places")
    others = first.select("q", "need", "doc").join(asked.join(known.select("q", "rarest"), "q").where("word <> rarest").select("q", "word"), "q").join(post, ["word", "doc"])
    met = first.unionByName(others).groupBy("q", "need", "doc").agg(F.collect_list(F.struct("word", "places")).alias("lists"), F.sum("score").alias("score")).where(F.size("lists") == F.col("need"))
    spread = F.pandas_udf(_stretches, "long")(F.flatten("lists.places"), F.transform("lists", lambda x: F.size(x["places"]))) - F.col("need") + 1
    ranked = met.select(F.col("q").alias(query_id), "doc", F.round(F.col("score") * (1 + 1 / (1 + F.greatest(spread, F.lit(0)))), 6).alias("rank"))
    numbered = ranked.withColumn("k", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("rank"), "doc")))
    return numbered if k is None else numbered.where(F.col("k") <= k)
