"""Episodes of actions with a budget, a final submission and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def episode_steps(df: DataFrame, keys: list[str], order: list[str], at: str, *, starts: Column, submits: Column, wrong: Column, budget: int = 40, ttl_seconds: int = 7200) -> DataFrame:
    """Each action with its status and the actions that remain after it.

    An action where starts is true opens a new episode of its keys. While the episode is open an action is run until the budget is spent, then spent; a submission ends it, as submitted or, with nothing left, as
    forced; the submission of another task is wrong_tool and costs nothing. Later actions are finished. An episode that is left alone for longer than ttl_seconds is gone, and so are all actions on it and those before any start; actions after an
    episode's end don't renew it. Null flags are false; an action without a time neither renews nor expires; null keys are one key; the order must tell actions apart. The columns of df stay as they are,
    but for status and remaining.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    row = F.struct(*[F.col(c) for c in df.columns if c not in ("status", "remaining")])
    base = df.select(row.alias("row"), F.struct(*keys).alias("key"), F.struct(*order).alias("rank"), F.col(at).cast("timestamp").alias("at"), flag(starts).alias("starts"), flag(submits).alias("submits"), flag(wrong).alias("wrong"))
    opened = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy("key", "episode").orderBy("rank")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    late = lambda since: flag(F.unix_micros("at") - F.unix_micros(since) > ttl_seconds * 1_000_000)
    steps = base.withColumn("episode", opened).withColumn("gone", late(F.last("at", ignorenulls=True).over(before)))
    steps = steps.withColumn("gone", F.max("gone").over(upto)).withColumn("used", F.sum((~(F.col("starts") | F.col("submits") | F.col("wrong"))).cast("int")).over(upto))
    ends = F.col("submits") & ~F.col("starts") & ~F.col("gone")
    steps = steps.withColumn("over", flag(F.max(ends).over(before))).withColumn("ended", F.min(F.when(ends, F.col("at"))).over(before))
    status = (
        F.when(F.col("episode") == 0, "gone").when(F.col("starts"), "started").when(F.col("over"), F.when(late(F.col("ended")), "gone").otherwise("finished")).when(F.col("gone"), "gone")
        .when(F.col("submits"), F.when(F.col("used") >= budget, "forced").otherwise("submitted")).when(F.col("wrong"), "wrong_tool").when(F.col("used") <= budget, "run").otherwise("spent")
    )
    remaining = F.when(~status.isin("gone", "finished"), F.greatest(budget - F.col("used") - F.when(status == "submitted", 1).otherwise(0), F.lit(0)))
    return steps.select("row.*", status.alias("status"), remaining.cast("int").alias("remaining"))


def unfinished(asked: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do: rows of asked whose keys aren't among those stored. Rows with null keys are never stored, so they stay."""
    return asked.join(stored.select(*keys).distinct(), keys, "left_anti")
