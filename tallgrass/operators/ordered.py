"""Row numbers and running sums of groups of any size: a group that holds a third of all rows is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.tables import checkpoint_folder

from .names import fresh


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, *, before: str, total: str) -> DataFrame:
    """df with the sum of value over the rows of a row's group that come before it (0 for the first), and over the whole group. Keys may be null; rows that the order doesn't tell apart come in any order.

    Rows are sorted by ranges of keys and order, summed range by range, and each range gets the sum of those before it: at most one row a range and group. The sorted rows are written to the checkpoint folder.
    """
    checkpoint_folder(df.sparkSession)
    part, own, v = fresh(df, "_part"), fresh(df, "_own"), fresh(df, "_value")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn(v, value).repartitionByRange(ranges, *keys, *order).withColumn(part, F.spark_partition_id()).checkpoint()
    within = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn(own, F.coalesce(F.sum(v).over(within), F.lit(0)))
    names = {k: fresh(df, f"_key{i}") for i, k in enumerate(keys)}
    at, sum_, earlier, all_ = (fresh(df, f"_range_{x}") for x in ("at", "sum", "before", "total"))
    sums = placed.groupBy(part, *keys).agg(F.sum(v).alias(sum_)).select(F.col(part).alias(at), *[F.col(k).alias(n) for k, n in names.items()], sum_)
    group = Window.partitionBy(*names.values())
    offsets = sums.withColumn(earlier, F.coalesce(F.sum(sum_).over(group.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(all_, F.sum(sum_).over(group)).drop(sum_)
    same = F.col(part) == F.col(at)
    for k, n in names.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    found = rows.join(offsets, same)
    return found.select(*[c for c in df.columns if c not in (before, total)], (F.col(own) + F.col(earlier)).alias(before), F.col(all_).alias(total))


def numbered(df: DataFrame, keys: list[str], order: list[str], *, number: str, size: str) -> DataFrame:
    """df with each row's number within its group, from 1, and the group's size (longs)."""
    return running(df, keys, order, F.lit(1).cast("long"), before=number, total=size).withColumn(number, F.col(number) + 1)
