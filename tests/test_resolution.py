"""Literal facts and brute force about cascades, hierarchies, nested records, clusters and conditioned metrics."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tallgrass.functions import clinical, nested, text
from tallgrass.operators import graph, metrics, pairs, resolve, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_singular_forms(spark):
    words = ["stones", "biopsies", "nephrolithiases", "masses", "gas", "glass", "babies", "ies"]
    assert {w: one(spark, clinical.stem(F.lit(w))) for w in words} == {w: min(forms(w), key=lambda f: (len(f), f)) for w in words}


def forms(w):
    out = {w}
    for ending, instead in (("ies", "y"), ("ses", "sis"), ("es", ""), ("s", "")):
        if len(w) > 4 and w.endswith(ending):
            out.add(w[: -len(ending)] + instead)
    return out


def test_nested_records(spark):
    df = spark.sql("SELECT array(named_struct('k', 1, 'f', true), named_struct('k', 2, 'f', CAST(NULL AS BOOLEAN)), named_struct('k', 3, 'f', false)) AS s, array(1, 2) AS a UNION ALL SELECT NULL, NULL")
    got = [tuple(r) for r in df.select(nested.without_flagged(F.col("s"), "f").alias("x"), nested.allowed_only(F.col("s"), "k", F.col("a")).alias("y")).collect()]
    assert [x.k for x in got[0][0]] == [2, 3] and [x.k for x in got[0][1]] == [1, 2] and got[1] == (None, None)
    for written, want in (('["a", 3]', ["a", "3"]), ("a, b ,,", ["a", "b"]), ('"a b"', ["a b"]), ("7", ["7"]), ("[broken, 1", ["[broken", "1"]), ("", [])):
        assert one(spark, nested.loose_list(F.lit(written))) == want
    assert one(spark, nested.loose_list(F.lit(None).cast("string"))) == []


def test_note_fields(spark):
    r = one(spark, nested.question_split(F.lit("A man comes in. Is he well? He coughs. What is the next best step?")))
    assert (r.vignette, r.question) == ("A man comes in. Is he well? He coughs.", "What is the next best step?")
    assert one(spark, nested.question_split(F.lit("No question here."))).question is None
    assert one(spark, nested.tag_value(F.array(F.lit("x"), F.lit("#A::b_c::d")), "#a")) == "b c" and one(spark, nested.tag_value(F.array(F.lit("x")), "#a")) is None
    assert one(spark, text.denied(F.lit("fever"), F.lit("Patient denies fever."))) and one(spark, text.denied(F.lit("chest pain"), F.lit("r/o chest pain")))
    assert not one(spark, text.denied(F.lit("fever"), F.lit("no cough, fever today"))) and not one(spark, text.denied(F.lit("fever"), F.lit("well")))


def test_cascade_and_fuzzy(spark):
    words = ["".join(x) for x in itertools.product(["red ", "blue ", "cold "], ["widget", "gadget", "bolt", "bolts x"])]
    rng = np.random.default_rng(1)
    asked = [w[:i] + w[i + 1 :] for w in words for i in rng.integers(0, len(w), 4)] + words[:3] + ["zzz", None, ""]
    frame = lambda xs: spark.createDataFrame([(x, f"c{i}") for i, x in enumerate(xs)], "name string, code string")
    got = {r["name"]: (r.match, round(r.score, 9)) for r in resolve.fuzzy_best(frame(asked), frame(words), "name").collect()}
    grams = lambda s: {("  " + s + " ")[i : i + 3] for i in range(max(1, len(s) + 1))}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    want = {}
    for a in {x for x in asked if x is not None}:
        best = min(words, key=lambda w: (-alike(a, w), w))
        if alike(a, best) >= 0.7:
            want[a] = (best, round(alike(a, best), 9))
    assert got == want
    stages = {"exact": frame(["red widget"])}
    got = {r["name"]: (r.code, r.method) for r in resolve.cascade(frame(["red widget", "blue gadgets", "zzz", None]), "name", stages, fuzzy=frame(words)).collect()}
    assert got == {"red widget": ("c0", "exact"), "blue gadgets": ("c5", "fuzzy"), "zzz": (None, "none")}


def test_concepts(spark):
    inventory = spark.createDataFrame([(1, "kidney stone"), (2, "stones"), (3, "kidney"), (4, "gallstone"), (5, " ")], "concept int, name string")
    docs = spark.createDataFrame([(1, "Stones in the left kidney."), (2, "one stone"), (3, None), (4, "gallstones; kidneys")], "id int, t string")
    assert sorted(map(tuple, resolve.concepts(docs, "id", "t", inventory).collect())) == [(1, 1), (2, 2), (4, 3), (4, 4)]
    assert resolve.concepts(docs.limit(0), "id", "t", inventory).count() == 0
    assert (2, 2) not in set(map(tuple, resolve.concepts(docs, "id", "t", inventory, max_df=1).collect()))


def test_hierarchies(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(30, 31), (31, 30), (None, 1), (5, 5)], "c int, p int")
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(edges, "c", "p").collect()}
    assert got == {(i, j): i - j for i in range(21) for j in range(i)} | {(30, 31): 1, (31, 30): 1}
    closure = graph.ancestors(edges, "c", "p")
    present = spark.createDataFrame([(3,), (20,), (20,)], "i int")
    under = {tuple(r) for r in graph.subsumed(present, closure, "i", most=1).collect()}
    assert under == {(j, 20) for j in range(3, 20)} and graph.subsumed(present, closure, "i", most=None).count() == 23


def test_corrections(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, v string")
    fixes = spark.createDataFrame([(1, "b"), (2, "x"), (3, "x"), (4, "d"), (9, "q"), (4, None)], "k int, v string")
    assert sorted(map(tuple, resolve.corrected(store, fixes, "k", "v").collect())) == [(1, "a", "conflict"), (2, "x", "applied"), (3, "c", "conflict"), (4, "d", "kept")]


def test_clusters_by_rounds_equal_the_sequential_ones(spark):
    rng = np.random.default_rng(8)
    sets = {int(i): sorted({int(x) for x in rng.integers(0, 60, rng.integers(0, 5))}) for i in range(1, 81)}
    near = {i: {j for j in sets if j != i and set(sets[i]) & set(sets[j])} for i in sets}
    free, want = set(sets), {}
    for seed in sorted(sets, key=lambda i: (-len(near[i]), i)):
        if seed in free:
            taken = [seed, *sorted(near[seed] & free, key=lambda j: (-len(set(sets[seed]) & set(sets[j])), j))[:3]]
            free -= set(taken)
            want |= {i: seed for i in taken}
    links = [(a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a != b and set(sets[a]) & set(sets[b])]
    nodes = spark.createDataFrame([(i,) for i in [*sets, 1, None]], "i int")
    got = {r.i: r.cluster for r in graph.greedy_clusters(nodes, spark.createDataFrame(links, "a int, b int, w int"), "i", most=4).collect()}
    assert got == want
    assert graph.greedy_clusters(nodes.limit(0), spark.createDataFrame([], "a int, b int, w int"), "i").count() == 0


def test_near_pairs(spark):
    rows = [(k, i, float(v)) for i, (k, v) in enumerate(zip([1, 2] * 20, np.random.default_rng(2).uniform(-50, 50, 40), strict=True))] + [(1, 99, None)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 7}
    assert {tuple(r) for r in pairs.near_pairs(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v", 7).collect()} == want


def conditioned(spark, items, gold, found):
    return metrics.conditioned(spark.createDataFrame(items, "item int, involved boolean, abstained boolean"), spark.createDataFrame(gold, "item int, tier string, critical boolean, finding string"), spark.createDataFrame(found, "item int, finding string")).first()


def test_conditioned_metrics(spark):
    gold = [(1, "primary", True, "aki"), (1, "relevant", True, "dm"), (1, "excluded", False, "af")]
    r = conditioned(spark, [(1, True, False)], gold, [(1, "aki"), (1, "dm")])
    assert (r.n_involved, r.n_absent, r.primary_recall_critical, r.relevant_recall_critical, r.leakage_rate, r.conditioned_f1) == (1, 0, 1.0, 1.0, 0.0, 1.0)
    r = conditioned(spark, [(1, True, False)], gold, [(1, "aki"), (1, "dm"), (1, "af")])
    assert (r.primary_recall_critical, r.leakage_rate, r.conditioned_f1) == (1.0, 1.0, 0.0)
    absent = [(1, False, True), (2, False, False)]
    r = conditioned(spark, absent, [(1, "excluded", False, "af"), (2, "excluded", False, "af")], [(2, "af")])
    assert (r.n_involved, r.n_absent, r.abstention_accuracy, r.absent_leakage_rate) == (0, 2, 0.5, 0.5)


def test_clusters_hold_an_item_once_and_links_of_the_free_alone(spark, monkeypatch):
    links = [(a, a + 1, 1) for a in range(1, 12)] + [(1, 1, 5), (4, 4, 2), (2, 3, 1)]
    pairs = spark.createDataFrame(links + [(b, a, w) for a, b, w in links if a != b], "a int, b int, w int")
    kept, checkpoint = [], type(pairs).checkpoint
    monkeypatch.setattr(type(pairs), "checkpoint", lambda df, *a: kept.append(checkpoint(df, *a)) or kept[-1])
    rows = graph.greedy_clusters(spark.range(1, 15).withColumnRenamed("id", "i"), pairs, "i", most=2).collect()
    assert sorted(r.i for r in rows) == list(range(1, 15))
    n_rounds = sum(df.columns == ["item", "cluster"] for df in kept)
    assert n_rounds > 1 and len(kept) == 3 + 2 * n_rounds
    sizes = [df.count() for df in kept if {"a", "b", "na"} <= set(df.columns)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 0
