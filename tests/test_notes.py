"""Literal facts about note rewrites, and snapped words against brute force."""

import difflib
import random

from pyspark.sql import functions as F

from tallgrass.functions import notes, similarity
from tallgrass.operators import notes as rows
from tallgrass.operators import resolve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_fragments(spark):
    mend = lambda x, sex="F", **k: one(spark, notes.repaired_fragment(F.lit(x), F.lit(sex), **k))
    assert mend("over two months. and has been noncompliant. Then more.") == "She has been noncompliant. Then more."
    assert mend("over two months.") == "Over two months." and mend("and her abdomen is soft") == "Her abdomen is soft" and mend("and took pills", "M") == "He took pills"
    assert mend("and then So it is") == "It is" and mend("and then Its end") == "Its end" and mend("Whole. over it. has") == "Whole. over it. has" and mend("  ") == "" and mend(None) == ""
    assert mend("in spring. on monday. arrives late", "M") == "He arrives late"
    assert mend("aspirin daily\n\nHome Medications:\n- a", medications=True) == "She takes aspirin daily.\n\nHome Medications:\n- a"
    assert mend("and took aspirin.\nHome Medications:\n- a", "M", medications=True) == "He took aspirin.\n\nHome Medications:\n- a"


def test_medications(spark):
    mend = lambda x: one(spark, notes.reconciled_medications(F.lit(x)))
    assert mend("She takes no medications.\n\nHome Medications:\n- a 5 mg") == "Home Medications:\n- a 5 mg"
    assert mend("Pain is mild. He takes no medications.\nHome Medications:\n* b") == "Pain is mild.\n\nHome Medications:\n* b"
    for same in ("She takes no medications.", "She takes no medications.\nHome Medications:\nnone", "She takes no aspirin.\nHome Medications:\n- a", ""):
        assert mend(same) == same
    assert mend(None) == ""


def test_history(spark):
    mend = lambda x: one(spark, notes.cleaned_history(F.lit(x)))
    head = "Active Problem List:\n- a\n- b"
    assert mend(head + "\n\nHer past medical history is unremarkable, and she had an uncomplicated pregnancy and vaginal delivery.") == head + "\n\nShe had an uncomplicated pregnancy and vaginal delivery."
    assert mend(head + "\n\nShe has no medical history. of the leg. Left arm. She was treated") == head + "\n\nShe was treated."
    assert mend(head + "\n\n") == head and mend("She has no medical history.") == "She has no medical history." and mend(None) == ""


def test_fill(spark):
    prior = F.array(F.struct(F.lit("Gout").alias("name"), F.lit("2020-01-15").alias("date")), F.struct(F.lit("gout").alias("name"), F.lit("2021-01-15").alias("date")))
    assert one(spark, notes.cumulative_history(F.lit("Well."), prior, F.array(F.lit("GOUT"), F.lit("Asthma")))) == "Active Problem List:\n- Gout (diagnosed 2020-01-15)\n- Asthma\n\nWell."
    assert one(spark, notes.cumulative_history(F.lit(None).cast("string"), F.lit(None).cast("array<struct<name:string,date:string>>"), F.lit(None).cast("array<string>"))) == ""
    assert one(spark, notes.aged(F.lit("A 45-year-old, 3 years"), F.lit(45), F.lit(25))) == "A 47-year-old, 3 years" and one(spark, notes.aged(F.lit("A man"), F.lit(45), F.lit(25))) == "A man"
    assert one(spark, notes.social_history(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("none"), F.lit(""))) == "Alcohol: none."
    assert one(spark, notes.without_lines(F.lit("a\n 12 \npg. 3\n[TABLE]\nb 12"), [r"\d+", r"pg\.\s*\d+", r"\[.*"], ["[TABLE]"])) == "a\n[TABLE]\nb 12"


def test_assembled_and_characters(spark):
    df = spark.createDataFrame([(1, "plan", "p"), (1, "assessment", "a"), (1, "assessment", "b"), (1, "hpi", ""), (2, "plan", "p"), (2, "hpi", "h"), (None, "x", None)], "k int, s string, t string")
    got = dict(rows.assembled(df, "k", "s", "t", {"hpi": "HPI", "assessment": "ASSESSMENT", "plan": "PLAN"}, merged=("assessment", "plan"), merged_header="ASSESSMENT AND PLAN").collect())
    assert got == {1: "ASSESSMENT AND PLAN:\na\n\np", 2: "HPI:\nh\n\nPLAN:\np", None: ""}
    df = spark.createDataFrame([(1, 0.0, 4.0, "a"), (1, 5.0, 9.0, "b"), (1, 12.0, 16.0, "c")], "line int, x0 double, x1 double, c string")
    assert rows.joined_characters(df, ["line"], "x0", "x1", "c").collect() == [(1, "ab c")]
    assert rows.joined_characters(df.limit(0), ["line"], "x0", "x1", "c").collect() == []


def test_category_sets(spark):
    asked = spark.createDataFrame([(1, "Chronic Foo Bar (2019)"), (1, "mi"), (2, "foo bar baz"), (3, None), (3, "quux")], "k int, c string")
    names = spark.createDataFrame([("foo bar", "F02"), ("Foo bar", "F01"), ("mi", "X01")], "name string, category string")
    got = sorted(map(tuple, resolve.category_sets(asked, "k", "c", [(r"\bmi\b", ["I21", "I25"])], names).collect()))
    assert got == [(1, "F01", "exact"), (1, "F02", "exact"), (1, "I21", "alias"), (1, "I25", "alias"), (2, "F01", "fuzzy")]


def test_snapped_equals_brute_force(spark):
    rnd = random.Random(3)
    known = sorted({"".join(rnd.choices("abce", k=rnd.randint(4, 12))) for _ in range(300)})
    edited = []
    for w in known:
        x = list(w)
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(x))
            x[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "ce"])
            x = x or ["a"]
        edited.append("".join(x))
    want = {}
    for w in {*edited} - {*known}:
        near = [v for v in known if len(w) >= 6 and v[0] == w[0] and abs(len(v) - len(w)) <= 2]
        if found := difflib.get_close_matches(w, near, n=1, cutoff=0.86):
            want[w] = found[0]
    frame = lambda x: spark.createDataFrame([(w,) for w in [*x, None]], "word string")
    got = resolve.snapped(frame(edited), frame(known), "word").collect()
    assert {r.word: r.snapped for r in got} == want and len(got) == len(want) > 30
    assert all(abs(similarity.ratio(r.snapped, r.word) - r.ratio) < 1e-12 for r in got)
