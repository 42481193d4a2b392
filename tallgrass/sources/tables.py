"""Readers of the Parquet tables, by name."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Rows that one task sorts or groups, where a query deals its rows out itself.
ROWS = 250_000


def tasks_for(rows: DataFrame) -> int:
    """The number of tasks in which a table's rows are sorted or grouped: as many as a shuffle has, and more if that would be over ROWS rows a task."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)


class Tables:
    """The tables of one folder; tables["orders"] reads orders.parquet, a file or a folder of files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir, or one of our own where that is unset (tests on one machine)."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()
