"""Relational division: entities that have everything that is required."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covering(have: DataFrame, entity: str, task: str, required: DataFrame) -> DataFrame:
    """Rows (entity, n_required): the entities that have every task of `required` (its column task), by counted semi-joins; all entities if nothing is required. Null entities and tasks and repeated rows don't count.

    The number of required tasks is one count; the tasks themselves stay tables, so both sides may be of any size.
    """
    wanted = required.select(F.col(task).alias("_task")).dropna().distinct()
    n = wanted.count()
    every = have.select(F.col(entity), F.col(task).alias("_task")).where(F.col(entity).isNotNull())
    if not n:
        return every.select(entity).distinct().withColumn("n_required", F.lit(0).cast("long"))
    met = every.where("_task IS NOT NULL").join(wanted, "_task", "left_semi").distinct().groupBy(entity).agg(F.count("*").alias("n_required"))
    return met.where(F.col("n_required") == n)


def below_ceiling(df: DataFrame, entity: str, results: DataFrame, solver: str, score: str, *, least: float = 0.5, solvers: int = 7) -> DataFrame:
    """df without the entities that `solvers` distinct solvers or more have scored at least `least` on; entities without results stay."""
    easy = results.where(F.col(score) >= least).select(entity, solver).dropna().distinct().groupBy(entity).agg(F.count("*").alias("_n")).where(F.col("_n") >= solvers).select(entity)
    return df.join(easy, entity, "left_anti")


def selected(entities: DataFrame, entity: str, size: str, have: DataFrame, task: str, required: DataFrame, *, least: int, most: int, n: int | None = None) -> DataFrame:
    """The rows of entities whose size lies between least and most and that have every required task, largest first (ties: the smaller entity), n of them at most (None: all)."""
    fit = entities.where(F.col(size).between(least, most)).join(covering(have, entity, task, required).select(entity), entity, "left_semi")
    return fit if n is None else fit.orderBy(F.desc(size), entity).limit(n)
