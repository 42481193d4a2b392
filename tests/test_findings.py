"""What texts name, on written-out cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import values
from tallgrass.operators import findings, metrics

LISTS = "summary string, wanted array<string>, new array<string>, resolved array<string>, off_target array<string>, future array<string>"


@pytest.mark.parametrize(("finding", "text", "want"), [
    ("fever", "no fever", True), ("fever", "no fever, but later fever of 39", False), ("fever", "No rash but fever", False), ("fever", "denies chills; fever", False), ("fever", "nothing said", False), ("Fever ", "absent FEVER", True),
    ("fever", "without chills, rash, sweats, weight loss or fever", False), ("a\\Eb", "no a\\Eb", True), ("", "no fever", False), (None, "no fever", False), ("fever", None, False), ("aa", "no aaaa", True),
])
def test_only_denied(spark, finding, text, want):
    df = spark.createDataFrame([(finding, text)], "f string, t string")
    assert df.select(values.only_denied(F.col("f"), F.col("t"))).first()[0] is want


def test_visit_scores(spark):
    rows = [
        ("Acute cough with high fever today.", ["acute cough", "rash", "acute cough"], ["fever"], None, ["old fracture", "fever"], []),
        (None, ["cough"], [None, ""], [], ["x"], ["y"]), ("one two", [], [], [], [], []),
    ]
    each = findings.current_visit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {LISTS}"), ["id"])
    got = {r["id"]: tuple(r)[1:] for r in each.collect()}
    assert got[0] == (2 / 3, 1.0, None, 0.5, None, 0.5, 6) and got[1] == (0.0, None, None, 0.0, 0.0, 0.0, 0) and got[2] == (None,) * 6 + (2,)
    m = findings.current_visit_means(each).first()
    assert m["n"] == 3 and abs(m["recall"] - 1 / 3) < 1e-9 and m["delta_resolved"] == 0.0 and m["off_target_rate"] == 0.25 and abs(m["selection_f1"] - 2 * (1 / 3) * 0.75 / (1 / 3 + 0.75)) < 1e-9
    assert findings.current_visit_means(each.where("id < 0")).first()["selection_f1"] == 0.0


def test_found_by_phrase_or_value_feeds_conditioned_metrics(spark):
    texts = spark.createDataFrame([("a", "Chronic cough, no fever, and seen on the ward today. Sodium 150 (135 - 145)"), ("b", None), ("a", "fever returned")], "item string, text string")
    gold = spark.createDataFrame([(i, t, True, f) for i, t, f in [("a", "primary", "cough, chronic"), ("a", "relevant", "hypernatremia"), ("a", "excluded", "fever"), ("a", "primary", "hyponatremia"), ("b", "primary", "fever"), ("a", "primary", None)]], "item string, tier string, critical boolean, finding string")
    found = findings.found_in(texts, gold)
    assert sorted(map(tuple, found.collect())) == [("a", "cough, chronic", "phrase"), ("a", "fever", "phrase"), ("a", "hypernatremia", "value")]
    items = spark.createDataFrame([("a", True, False), ("b", True, False)], "item string, involved boolean, abstained boolean")
    one = metrics.conditioned(items, gold.where("finding IS NOT NULL"), found).first()
    assert one["primary_recall_complete"] == 0.25 and one["leakage_rate"] == 1.0


def test_imaging_scores(spark):
    dx = "array<struct<code:string,name:string>>"
    rows = [
        (1, "Rule out PE", "rule out pneumonia", [("i26.9", "Pulmonary embolism"), ("", "flu")], [("I269", "PE"), ("J10", "influenza flu syndrome"), (None, None), ("Z1", "other")], ["Left effusion", "mass"], ["EFFUSION mass", "nodule", ""]),
        (2, None, "x", None, [("A", "a")], None, ["q"]), (3, "x", "x", [("A", "a")], None, [], None),
    ]
    df = spark.createDataFrame(rows, f"id int, question string, ref_question string, differential {dx}, ref_differential {dx}, findings array<string>, ref_findings array<string>")
    got = {r["id"]: tuple(r)[1:] for r in findings.imaging(df, ["id"]).collect()}
    assert got == {1: (2 / 3, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (1.0, None, None)}


def test_latency(spark):
    df = spark.createDataFrame([(0.8, 3000.0), (0.8, 0.0), (0.8, None)], "s double, ms double")
    assert [r[0] for r in df.select(metrics.latency_adjusted(F.col("s"), F.col("ms"))).collect()] == [0.4, 0.8, 0.8]


def test_findings_are_judged_once_and_by_many_tasks(spark):
    gold = spark.range(50).select(F.col("id").alias("item"), F.explode(F.array(F.lit("chronic cough"), F.lit("fever"), F.lit(" "), F.lit(None))).alias("finding"))
    texts = spark.range(60).select((F.col("id") % 30).alias("item"), F.when(F.col("id") < 30, "No fever but chronic cough.").when(F.col("id") < 40, "Fever").alias("text"))
    found = findings.found_in(texts, gold)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_intersect") == 1 and "Broadcast" not in plan and "REPARTITION_BY_NUM" in plan
    want = [(i, "chronic cough", "phrase") for i in range(30)] + [(i, "fever", "phrase") for i in range(10)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
