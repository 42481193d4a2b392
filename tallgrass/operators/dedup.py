"""Rows that stand for a key: first or last writer, best by priority, rows not yet stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh


def first_seen(df: DataFrame, key: str, value: str, order: list[str], *, most: int | None = None) -> DataFrame:
    """Rows (key, values): the distinct values of each key in the order in which they are first seen, the first `most` of them (None: all). Null values are left out; order must tell the rows of a value apart from others'.

    Values are reduced to their first place before they meet, so that a key's list is as long as its distinct values.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value])
    return first.groupBy(key).agg((F.slice(listed, 1, most) if most is not None else listed).alias("values"))


def pick_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in the order, which must tell all rows of a key apart. Null keys are one key."""
    rank = fresh(df, "_rn")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], arrival: list[Column | str]) -> DataFrame:
    """What a store with a unique key adds of new: the first row of each key in order of arrival, if the store has no row with it."""
    return pick_first(new, keys, arrival).join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], arrival: list[Column | str]) -> DataFrame:
    """The store after new has replaced rows of equal keys; of several new rows of a key the last in order of arrival stays."""
    latest = pick_first(new, keys, [F.desc(a) if isinstance(a, str) else a.desc() for a in arrival])
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(latest.select(*existing.columns))


def fill_missing(df: DataFrame, source: DataFrame, keys: list[str], columns: list[str], mark: str) -> DataFrame:
    """Fills nulls of columns from source (one row for each key) and marks the rows that got a value."""
    new = {c: fresh(df, f"_new_{c}", source) for c in columns}
    given = source.select(*keys, *[F.col(c).alias(new[c]) for c in columns])
    got = [F.col(c).isNull() & F.col(new[c]).isNotNull() for c in columns]
    filled = df.join(given, keys, "left")
    any_got = got[0]
    for g in got[1:]:
        any_got = any_got | g
    return filled.select(*[c for c in df.columns if c not in columns], *[F.coalesce(c, new[c]).alias(c) for c in columns], any_got.alias(mark))
