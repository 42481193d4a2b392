"""Charts of a few patients, written out."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallgrass.functions import access
from tallgrass.operators import chart

DAY = datetime.date
ENCOUNTERS = [(1, "p", DAY(2024, 1, 1), "x"), (2, "p", DAY(2024, 3, 1), "y"), (3, "p", DAY(2024, 3, 1), "z"), (4, "p", None, "w"), (5, "q", DAY(2024, 1, 5), None), (6, None, DAY(2024, 1, 6), "v")]
SECTIONS = [(10, 3, "medications", 1, " a \n\n b"), (11, 3, "medications", 2, " c \n\n d"), (12, 3, "allergies", 3, ""), (13, 3, None, 0, "hidden"), (14, 5, "labs", 1, None), (15, 6, "labs", 1, "no patient"), (16, 99, "labs", 1, "no encounter"), (17, 1, "imaging", 1, "old")]


def tables(spark):
    e = spark.createDataFrame(ENCOUNTERS, "encounter int, patient string, date date, note string")
    return e, spark.createDataFrame(SECTIONS, "section int, encounter int, kind string, place int, text string")


def test_summary(spark):
    e, s = tables(spark)
    patients = spark.createDataFrame([("p", "P", 1), ("q", "Q", 2), ("r", None, 3)], "patient string, name string, recent int")
    problems = spark.createDataFrame([("p", "flu"), ("p", "asthma"), ("p", "flu"), ("q", None), (None, "x")], "patient string, problem string")
    got = {r["patient"]: r for r in chart.summary(patients, e, s, problems, recent=3, details=("note",)).collect()}
    assert [(x["encounter"], x["note"]) for x in got["p"]["recent"]] == [(3, "z"), (2, "y"), (1, "x")]
    assert (got["p"]["medications"], got["p"]["allergies"], got["p"]["problems"]) == (["c", "d"], [], ["asthma", "flu"])
    assert got["q"]["medications"] == got["q"]["problems"] == [] and got["r"]["recent"] == [] and len(got["q"]["recent"]) == 1
    hidden = chart.summary(patients, e, s, problems, may=access.may_read("clerk", F.col("kind"), {"clerk": ("allergies",)})).where("patient = 'p'").first()
    assert hidden["medications"] == [] and len(hidden["recent"]) == 4
    none = chart.summary(patients, e.limit(0), s.limit(0), problems.limit(0)).collect()
    assert len(none) == 3 and all(r["recent"] == [] for r in none)


def test_detail_and_roles(spark):
    e, s = tables(spark)
    grants = {"clerk": ("allergies", "labs"), "head": None}
    got = {r["encounter"]: ([x["section"] for x in r["sections"]], r["n_hidden"]) for r in chart.detail(e, s, may=access.may_read("clerk", F.col("kind"), grants)).collect()}
    assert got == {1: ([], 1), 2: ([], 0), 3: ([12], 3), 4: ([], 0), 5: ([14], 0), 6: ([15], 0)}
    for role in ("head", "stranger", None):
        assert [x["section"] for x in chart.detail(e, s, may=access.may_read(role, F.col("kind"), grants)).where("encounter = 3").first()["sections"]] == [13, 10, 11, 12]


def test_resources_and_results(spark):
    e, s = tables(spark)
    may = access.may_read("clerk", F.col("kind"), {"clerk": ("labs",)})
    ids = lambda df: sorted(r["section"] for r in df.collect())
    assert ids(chart.resources(e, s, "DiagnosticReport")) == [14, 17] and ids(chart.resources(e, s, "DiagnosticReport", may=may)) == [14] and ids(chart.resources(e, s, "DiagnosticReport", category="RAD")) == [17]
    assert ids(chart.resources(e, s, "DocumentReference", category="labs")) == [14] and ids(chart.resources(e, s, "DocumentReference", may=may)) == [14]
    assert ids(chart.resources(e, s, "MedicationRequest", may=may)) == [10, 11] and ids(chart.resources(e, s, "AllergyIntolerance", may=may)) == [12]
    orders = spark.createDataFrame([(1,), (1,), (7,)], "encounter int")
    assert [(r["section"], r["has_order"]) for r in chart.results(e, s, "imaging", orders=orders).collect()] == [(17, True)]
    assert [(r["section"], r["has_order"]) for r in chart.results(e, s, "labs", orders=orders).collect()] == [(14, False)]


def test_pages(spark):
    rows = spark.createDataFrame([("a", i, 7) for i in range(5)] + [(None, 9, 7), (None, 8, 7)], "k string, id int, total int")
    got = sorted((r["k"] or "", r["id"], r["number"], r["total"]) for r in chart.page(rows, ["k"], ["id"], offset=1, count=2).collect())
    assert got == [("", 9, 2, 2), ("a", 1, 2, 5), ("a", 2, 3, 5)]
    assert "WindowGroupLimit" in chart.page(rows, ["k"], ["id"])._jdf.queryExecution().toString()


def test_observations(spark):
    e = spark.createDataFrame([("p", [1, 2]), ("p", [2, None]), (None, [1]), ("q", None)], "patient string, questions array<int>")
    mentions = spark.createDataFrame([(1, 1, "f"), (2, 2, "f"), (3, 2, "g"), (4, None, "f"), (5, 1, "unknown")], "mention int, question int, finding string")
    findings = spark.createDataFrame([("f", "lab", 0), ("g", "sign", 0)], "finding string, kind string, mention int")
    assert sorted(map(tuple, chart.observations(e, mentions, findings).select("patient", "finding", "mention", "kind").collect())) == [("p", "f", 1, "lab"), ("p", "g", 3, "sign")]
    assert [r["finding"] for r in chart.observations(e, mentions, findings, kinds=F.col("kind") == "sign").collect()] == ["g"]


def test_condition_search_groups_in_bounded_tasks(spark, sf, monkeypatch):
    from tallgrass.plans import catalogue, chart

    monkeypatch.setattr(chart, "ROWS", 1000)
    plan = catalogue.QUERIES["condition_search"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count() // 1000 + 1
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(o_custkey" in line]
    assert n > 4 and len(exchanges) == 1 and f", {n})" in exchanges[0] and "REPARTITION_BY_NUM" in exchanges[0]
