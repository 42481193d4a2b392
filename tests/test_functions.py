"""Literal facts about the column functions and generic operators."""

import math

from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators import dedup, metrics, pairs, timeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_strip_html(spark):
    assert one(spark, text.strip_html(F.lit("<p>a &amp;lt; b</p><br/> c [sound:x.mp3]<b>d</b>"))) == "a < b\n\nc d"


def test_cloze(spark):
    assert one(spark, text.cloze_text(F.lit("{{c1::Heart::organ}} pumps {{c2::blood}}"))) == "Heart pumps blood"


def test_tokens_and_ngrams(spark):
    assert one(spark, text.tokens(F.lit("An ICD-10 code, of 250"))) == ["icd", "code", "250"]
    assert one(spark, text.ngrams(F.split(F.lit("a b c"), " "), 2)) == ["a b", "b c"]
    assert one(spark, text.ngrams(F.split(F.lit("a b c"), " "), 4)) == []


def test_phrase_and_similarity(spark):
    assert one(spark, text.phrase_in(F.lit("chronic kidney disease"), F.lit("stage 3 chronic kidney disease noted")))
    assert not one(spark, text.phrase_in(F.lit("pulmonary embolism"), F.lit("patient has a sore throat")))
    assert one(spark, text.similarity(F.lit("red widget"), F.lit("red widget"))) == 1.0


def test_sentences_and_abstention(spark):
    assert one(spark, text.sentences(F.lit("First sentence here. No. Another one is long!"))) == ["First sentence here.", "Another one is long!"]
    assert one(spark, text.abstains(F.lit("I can say nothing")))
    assert one(spark, text.abstains(F.lit("There is no involvement of this kind in the chart that could be told for the patient today")))


def test_upsert_and_ignore(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 3)], "k int, v string, seq int")
    assert sorted(r[:2] for r in dedup.upsert(old, new, ["k"], ["seq"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(r[:2] for r in dedup.insert_ignore(old, new, ["k"], ["seq"]).collect()) == [(3, "e")]


def test_anchor_positions(spark):
    rows = [(n, i) for n in (1, 2, 3, 4, 7, 10) for i in range(n)]
    got = {}
    for r in timeline.anchors(spark.createDataFrame(rows, "p int, o int"), ["p"], ["o"]).collect():
        got.setdefault(r.p, []).append(r.position)
    assert {k: sorted(v) for k, v in got.items()} == {2: [1], 3: [1, 2], 4: [1, 2, 3], 7: [1, 4, 6], 10: [1, 5, 9]}


def test_item_states(spark):
    df = spark.createDataFrame([("p", "A", 0), ("p", "B", 0), ("p", "B", 1), ("p", "C", 1)], "e string, i string, pos int")
    got = {(r.i, r.pos): (r.is_new, r.resolved_next) for r in timeline.item_states(df, "e", "i", "pos").collect()}
    assert got == {("A", 0): (True, True), ("B", 0): (True, False), ("B", 1): (False, False), ("C", 1): (True, False)}


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 2, 3), (1, "c", 3, 2), (2, "d", 1, 0)], "item int, passage string, rank int, grade int")
    got = {r["item"]: r for r in metrics.ranking_metrics(df, "item", k=10).collect()}
    dcg, ideal = 7 / math.log2(3) + 3 / 2, 7 + 3 / math.log2(3)
    assert got[1].ndcg10 == round(dcg / ideal, 6)
    assert (got[1].map10, got[1].recall10, got[1].precision10, got[1].mrr) == (round((1 / 2 + 2 / 3) / 2, 6), 1.0, round(2 / 3, 6), 0.5)
    assert (got[2].ndcg10, got[2].map10, got[2].mrr) == (0.0, 0.0, 0.0)


def test_weighted_overlap(spark):
    df = spark.createDataFrame([("a", "f", 1.0), ("a", "g", 2.0), ("b", "f", 2.0), ("b", "h", 1.0)], "i string, f string, w double")
    assert pairs.weighted_overlap(df, "i", "f", F.col("w")).collect() == [("a", "b", 1.0 / 5.0)]


def test_phrase_counts_equal_phrase_in(spark):
    docs = spark.createDataFrame([(1, "Large RING, hot bolt"), (2, "largering of bolts"), (3, None), (4, ""), (5, "ring ring large x9y")], "id int, body string")
    phrases = spark.createDataFrame([("large ring",), ("hot bolt",), ("",), ("x9",), ("Ring of large bolts",)], "p string")
    each = docs.crossJoin(phrases).groupBy("id").agg(F.sum(F.when(text.phrase_in(F.col("p"), F.col("body")), 1).otherwise(0)).alias("n"))
    for block in (1, 500):
        got = text.phrase_counts(docs, "id", "body", phrases, "p", block=block)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+") == 2
