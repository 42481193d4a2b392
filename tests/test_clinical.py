"""Literal facts about the functions on notes and codes."""

import datetime

from pyspark.sql import functions as F

from tallgrass.functions import clinical as c
from tallgrass.functions import similarity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_demographics(spark):
    assert one(spark, c.age_years(F.lit("A 45-year-old woman"))) == 45 and one(spark, c.age_years(F.lit("a 6-month-old boy"))) == 0.5
    assert one(spark, c.age_years(F.lit("A newborn girl"))) == 0 and one(spark, c.age_years(F.lit("no age"))) is None
    assert one(spark, c.sex(F.lit("A 45-year-old woman and his"))) == "F" and one(spark, c.sex(F.lit("the man"))) == "M" and one(spark, c.sex(F.lit("x"))) is None


def test_choices_and_globs(spark):
    assert [tuple(x) for x in one(spark, c.answer_choices(F.lit("Which?\nA. Heart B) Lung\nC. Liver")))] == [("A", "Heart"), ("B", "Lung"), ("C", "Liver")]
    assert one(spark, c.glob_like(F.lit("cardio_1.apkg"), ["x*", "cardio_?.apkg"])) and not one(spark, c.glob_like(F.lit("cardiox1.apkg"), ["cardio_?.apkg"])) and not one(spark, c.glob_like(F.lit("a"), []))


def test_codes(spark):
    assert one(spark, c.dotted(F.lit("e11 9"))) == "E11.9" and one(spark, c.dotted(F.lit("i10"))) == "I10" and one(spark, c.category(F.lit("s72.001a"))) == "S72"
    assert one(spark, c.name_variants(F.lit("History of anemia, chronic (Hb: 9)"))) == ["history of anemia, chronic (hb: 9)", "history of anemia, chronic", "anemia, chronic (hb: 9)", "history of anemia"]


def test_words(spark):
    assert one(spark, c.expanded_tokens(F.lit("r/o SBO, s/p MI"))) == "rule out small bowel obstruction status post myocardial infarction".split()
    assert [one(spark, c.stem(F.lit(w))) for w in ("babies", "rashes", "nodules", "mass", "gas")] == ["babi", "rash", "nodul", "mass", "gas"]  # es alone gives babi, shorter than baby


def test_notes(spark):
    note = "HPI: x\nPROBLEM LIST:\n- Asthma\n* asthma.\n- HTN\n\nPLAN: y"
    assert one(spark, c.problem_lines(F.lit(note))) == ["Asthma", "HTN"]
    assert one(spark, c.safe_command(F.lit("sqlite3 a.db 'select 1' | head"), ["sqlite3", "head"])) and not one(spark, c.safe_command(F.lit("sqlite3 a.db 'DROP TABLE x'"), ["sqlite3"])) and not one(spark, c.safe_command(F.lit("ls | rm x"), ["ls"]))
    assert one(spark, c.planned_date(F.lit(14))) == datetime.date(2021, 3, 15)
    kept = spark.sql("SELECT array(named_struct('t', 'plan', 'v', 1), named_struct('t', 'hpi', 'v', 2), named_struct('t', CAST(NULL AS STRING), 'v', 3)) AS s").select(c.prune_sections(F.col("s"), "t", ["plan"]).alias("s")).first().s
    assert [x.v for x in kept] == [2, 3]


def test_json_repair():
    assert similarity.salvage_json('Sure: {"a": {"b": 1}, "k": [1, 2,]} and {"x": 1}', ["k"]) == '{"a": {"b": 1}, "k": [1, 2]}'
    assert similarity.salvage_json("```json\n{'k': 'v'}\n```", ["k"]) == '{"k": "v"}'
    assert similarity.salvage_json('{"k": "brace } in text"}', ["k"]) == '{"k": "brace } in text"}' and similarity.salvage_json("nothing", ["k"]) is None and similarity.salvage_json('{"k": 1', ["k"]) == '{"k": 1}'
