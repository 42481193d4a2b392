"""Where the query families register their queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallgrass.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function from Tables to a DataFrame."""

    def register(plan: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Tables(spark, sf_dir))

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return plan

    return register


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers Spark SQL over {table} placeholders; the same text is the oracle unless DuckDB needs its own words."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    query(name, re.sub(r"\{(\w+)\}", r"\1", oracle or text))(lambda t: t.spark.sql(text, **{n: t[n] for n in names}))
