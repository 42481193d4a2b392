"""Rows are dealt to tasks of a bounded size at any size of a table, once."""

from __future__ import annotations

import re

import pytest

import __spark_entry__
from tallgrass.sources import tables


@pytest.mark.parametrize(("query", "key", "shuffles"), [("ranking_metrics", "o_custkey", 3), ("report_pages", "l_orderkey", 6), ("conditioned_metrics", "item", 2)])
def test_tasks_follow_the_rows(spark, sf, monkeypatch, query, key, shuffles):
    monkeypatch.setattr(tables, "ROWS", 500)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    df = __spark_entry__.queries()[query](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
    assert (key, str(lines // 500 + 1)) in dealt
    assert plan.count("Exchange hashpartitioning") <= shuffles
