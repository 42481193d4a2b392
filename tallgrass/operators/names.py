"""Names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, name: str, *others: DataFrame) -> str:
    """The name, with as many underscores before it as it takes to be none of the tables' columns (upper and lower case alike)."""
    taken = {c.lower() for table in (df, *others) for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
