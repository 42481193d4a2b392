"""Classified errors on literal cases."""

from __future__ import annotations

from tallgrass.operators import errors


def test_first_code(spark):
    frame = lambda rows: spark.createDataFrame(rows, "item int, code string")
    valid = spark.createDataFrame([("E11.9", False), ("E11.2", False), ("E11", True), ("I10", False), ("J45", False), ("Z00", False)], "code string, is_header boolean")
    right = frame([(i, "E11.9") for i in range(1, 11)] + [(11, None), (12, "")])
    given = frame([(1, "e119"), (2, "I10"), (3, "E11.2"), (4, "E11"), (5, "X99"), (6, "J45"), (7, ""), (9, "Z00"), (10, "Y1"), (11, "I10")])
    got = errors.first_code(given, right, valid, alternatives=frame([(9, "Z00")]), distractors=frame([(6, "J45"), (10, "Y1"), (3, "E11.2")])).collect()
    assert sorted((r.item, r.category, r.subtype) for r in got) == [
        (2, "reasoning_error", "wrong_diagnosis"), (3, "coding_error", "wrong_specificity"), (4, "coding_error", "parent_code"), (5, "coding_error", "nonexistent_code"), (6, "reasoning_error", "related_differential"),
        (7, "schema_mismatch", "missing_required_key"), (8, "parse_failure", "wrong_structure"), (10, "coding_error", "nonexistent_code"), (10, "reasoning_error", "related_differential"),
    ]


def test_grades(spark):
    ranked = spark.createDataFrame([(1, i, f"p{i}", g) for i, g in enumerate([3, 4, 0, None, 1, 3])] + [(2, 0, "p0", 3), (1, 9, None, 0)], "item int, place int, passage string, grade int")
    judged = spark.createDataFrame([(1, "p0", 0), (1, "p1", 3), (1, "p2", 3), (1, "p3", 4), (1, "p5", -1)], "item int, passage string, grade int")
    got = sorted((r.subtype, r.number, r.detail, r.n_all) for r in errors.grades(ranked, judged, caps={"grade_inflation": 1}).collect())
    assert got == [("grade_deflation", 1, "p2", 2), ("grade_deflation", 2, "p3", 2), ("grade_inflation", 1, "p0", 2), ("wrong_key_name", 1, "p4", 1)]


def test_problem_lists(spark):
    frame = lambda rows: spark.createDataFrame(rows, "item int, place int, code string, course string")
    right = frame([(1, 0, "E11.9", "acute"), (1, 1, "I10", "chronic"), (3, 0, "I10", "chronic")])
    given = frame([(1, 0, "E11.2", "stable"), (1, 1, "J45", "acute"), (1, 2, "X99", None), (2, 0, "I10", "acute")])
    valid = spark.createDataFrame([("E11.2", "diabetes"), ("E11.9", "diabetes"), ("I10", "hypertension"), ("J45", "Asthma")], "code string, name string")
    texts = spark.createDataFrame([(1, "history of ASTHMA")], "item int, text string")
    got = sorted((r.item, r.category, r.subtype, r.detail) for r in errors.problem_lists(given, right, valid, texts).collect())
    assert got == [
        (1, "coding_error", "nonexistent_code", "X99"), (1, "hallucination", "hallucination", "X99"), (1, "omission", "omission", "I10"), (1, "reasoning_error", "acuity_misclass", "E119:chronic:acute"), (1, "reasoning_error", "wrong_diagnosis", "J45"),
    ]
