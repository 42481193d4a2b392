"""Windows over ordered records of an entity. Every window is partitioned by the entity, so that no task sees more than one entity's records at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def position(df: DataFrame, keys: list[str], order: list, out: str = "position") -> DataFrame:
    """Numbers an entity's records from 0."""
    return df.withColumn(out, (F.row_number().over(_w(keys, order)) - 1).cast("int"))


def first_occurrence(df: DataFrame, entity: str, item: str, order: list[str]) -> DataFrame:
    """Each entity's distinct items with the order columns of their first record, by aggregation alone."""
    first = F.min(F.struct(*order)).alias("_first")
    return df.groupBy(entity, item).agg(first).select(entity, item, *[F.col(f"_first.{c}").alias(c) for c in order])


def item_states(df: DataFrame, entity: str, item: str, pos: str) -> DataFrame:
    """For each entity, item and record position: whether the item is new there, and whether it is gone at the next record.

    df has one row for each item at each position. new: no earlier record has the item; resolved_next: the entity has a next record, and the item isn't in it.
    """
    by_item, by_entity = Window.partitionBy(entity, item).orderBy(pos), Window.partitionBy(entity)
    last = F.max(pos).over(by_entity)
    return (
        df.select(entity, item, pos).distinct()
        .withColumn("is_new", F.row_number().over(by_item) == 1)
        .withColumn("resolved_next", (F.col(pos) < last) & (F.coalesce(F.lead(pos).over(by_item), F.lit(-1)) != F.col(pos) + 1))
    )


def running_distinct(df: DataFrame, entity: str, item: str, pos: str) -> DataFrame:
    """How many distinct items an entity has had before each position and up to it."""
    first = df.groupBy(entity, item).agg(F.min(pos).alias(pos)).groupBy(entity, pos).agg(F.count("*").alias("n_new"))
    places = df.select(entity, pos).distinct().join(first, [entity, pos], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    upto = F.sum("n_new").over(Window.partitionBy(entity).orderBy(pos))
    return places.withColumn("n_known", upto).withColumn("n_before", upto - F.col("n_new"))


def forward_fill(df: DataFrame, keys: list[str], order: list, value: Column, out: str, back: int | None = None) -> DataFrame:
    """The last non-null value at or before each record, at most `back` records away if that is given."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding if back is None else -back, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, out: str = "island") -> DataFrame:
    """Numbers runs of records; a record where starts is true begins a new one."""
    return df.withColumn(out, F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def spans(df: DataFrame, keys: list[str], order: list, start: str, end: Column, out: str) -> DataFrame:
    """Each record's end: one before the next record's start, not before its own start; the last record's is `end`."""
    return df.withColumn(out, F.greatest(F.col(start), F.coalesce(F.lead(start).over(_w(keys, order)) - 1, end)))


def changed(df: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """Whether a record's value differs from the record's before it; the first record's does."""
    w = _w(keys, order)
    return df.withColumn(out, ~F.lag(value).over(w).eqNullSafe(value) | (F.row_number().over(w) == 1))


def chunks(df: DataFrame, keys: list[str], order: list, size: int, out: str = "chunk") -> DataFrame:
    return df.withColumn(out, F.floor((F.row_number().over(_w(keys, order)) - 1) / size).cast("int"))


def anchors(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The records at which an entity with at least two records is examined: the second, the middle one of all from the second on, and the last."""
    w = _w(keys, order)
    n = F.count("*").over(Window.partitionBy(*keys))
    size = fresh(df, "_n")
    numbered = df.withColumn("position", (F.row_number().over(w) - 1).cast("int")).withColumn(size, n)
    return numbered.where(f"`{size}` >= 2 AND position IN (1, 1 + (`{size}` - 1) div 2, `{size}` - 1)").drop(size)
