"""Stems, containment, values, exact p-values, running numbers, tiers and selection against plain rules."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import stemming, values
from tallgrass.operators import containment, ordered, selection, stats, tiers


def test_published_stems(spark):
    """Words of the algorithm's publication with their stems after all steps."""
    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
    hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
    vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
    triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
    defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
    probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil a a is is""".split()
    rows = list(zip(pairs[::2], pairs[1::2], strict=True))
    got = spark.createDataFrame(rows, "w string, s string").select("w", stemming.porter(F.col("w")).alias("got"), "s").collect()
    assert [(r.w, r.got) for r in got] == [(r.w, r.s) for r in got]
    assert spark.range(1).select(stemming.summary_words(F.lit("The Connections, connected; cat")).alias("w")).first().w == ["the", "connect", "connect", "cat"]


def test_containment_equals_all_pairs(spark):
    rng = random.Random(3)
    sets = lambda n, k: [(i, [rng.choice(["the", "a", *map(str, range(30))]) for _ in range(rng.randint(0, k))]) for i in range(n)]
    small, large = sets(40, 9), sets(40, 30)
    small[3] = (3, None)
    frame = lambda rows: spark.createDataFrame(rows, "i int, w array<string>")
    for least in (0.15, 0.5, 0.8, 1.0):
        got = containment.containment_join(frame(small), "i", frame(large).withColumnRenamed("i", "j"), "j", "w", least=least).collect()
        want = [(i, j, len(set(a) & set(b)) / len(set(a))) for i, a in small for j, b in large if a and b and len(set(a) & set(b)) >= least * len(set(a)) - 1e-9]
        assert sorted(map(tuple, got)) == sorted(want)


def test_grounding_and_omissions(spark):
    said = "The patient has fever today. Completely invented words stand here! Ok."
    rate = lambda a, b: spark.range(1).select(containment.ungrounded_rate(F.lit(a), F.lit(b)).alias("r")).first().r
    assert rate(said, "patient with a fever") == 0.5 and rate("", "x") == 0.0 and rate(None, "x") == 0.0 and rate("one sentence without source", None) == 1.0
    texts = spark.createDataFrame([(1, "has Fever and cough"), (2, None), (3, "x"), (1, "pain")], "k int, t string")
    wanted = spark.createDataFrame([(1, "fever"), (1, "pain"), (1, "rash"), (2, "a"), (1, "fever"), (1, None)], "k int, f string")
    got = {r.k: (r.n_wanted, r.omitted and round(r.omitted, 6)) for r in containment.omission_rates(texts, wanted, "k", "t", "f").collect()}
    assert got == {1: (3, 0.333333), 2: (1, 1.0), 3: (0, None)}


@pytest.mark.parametrize(("finding", "text", "agrees"), [
    ("Elevated ACTH level", "ACTH 200 pg/mL (normal 10-60)", True), ("Elevated ACTH level", "ACTH 30 (low)", False), ("Elevated ACTH level", "ACTH 30 pg/mL (10-60)", False), ("Hyponatremia", "sodium 128 (135 to 145)", True),
    ("Hyponatremia", "no low sodium", False), ("Hyponatremia", "denies salt craving. Much later in the text the sodium was low", True), ("Low potassium", "K+ 2.9, ref 3.5 – 5.0", True), ("Low potassium", "potassium replaced", False),
    ("Hypertension", "sodium low", False), ("Elevated glucose", "blood sugar raised", True), ("Elevated glucose", None, False), (None, "sodium low", False), ("Low sodium", "sodium 140 (135-145) ... " + "x" * 60 + " sodium reduced", True), ("high bun", "bunion high", False),
])
def test_values_agree(spark, finding, text, agrees):
    assert spark.range(1).select(values.value_agrees(F.lit(finding).cast("string"), F.lit(text).cast("string")).alias("a")).first().a is agrees


def plain_direction(window: str) -> str | None:
    words = set(re.findall("[a-z]+", window))
    if words & set(values.HIGH):
        return "high"
    if words & set(values.LOW):
        return "low"
    if m := re.search(values.RANGE, window):
        for n in re.finditer(values.NUMBER, window):
            if not m.start() <= n.start() < m.end():
                v = float(n.group())
                return "low" if v < float(m.group(1)) else "high" if v > float(m.group(2)) else "normal"
    return None


def test_reported_equals_a_scan(spark):
    rng = random.Random(6)
    pieces = ["sodium", "na+", " ", " 12 ", "3-9", "(4 to 8)", "no ", "low", "raised", "x", ", ", "denied ", "banana+", "sodiumx"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 18))) for _ in range(300)]
    pattern = values._any_of(values.ANALYTES["sodium"])
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", values.reported(F.col("t"), F.lit(pattern)).alias("r")).collect()
    plain = re.compile(r"(?<![a-z])(?:sodium|na\+)(?![a-z])")
    for r in got:
        low = texts[r.i]
        want = [plain_direction(low[m.start() : m.end() + 60]) for m in plain.finditer(low) if not any(d in low[max(0, m.start() - 25) : m.start()] for d in values.DENIALS)]
        assert r.r == want, low


def test_exact_p_values(spark):
    rng, rows = random.Random(9), []
    for g in range(12):
        rows += [(g, float(rng.choice([-3, -2, -1, 0, 1, 2, 4, 5])), 0.0) for _ in range(g + 1)]
    got = {r.g: r.p for r in stats.wilcoxon(spark.createDataFrame(rows, "g int, a double, b double"), "g", "a", "b").collect()}
    for g, p in got.items():
        d = [a for k, a, _ in rows if k == g and a]
        size = sorted(map(abs, d))
        rank = [(size.index(abs(x)) + 1 + size.index(abs(x)) + size.count(abs(x))) / 2 for x in d]
        least = min(sum(r for r, x in zip(rank, d, strict=True) if x > 0), sum(r for r, x in zip(rank, d, strict=True) if x < 0))
        ways = sum(sum(r for r, s in zip(rank, signs, strict=True) if s) <= least for signs in itertools.product([0, 1], repeat=len(d)))
        assert p == pytest.approx(min(1.0, 2 * ways / 2 ** len(d)), abs=1e-12)
    far = stats.wilcoxon(spark.createDataFrame([(1, float(x), 0.0) for x in range(-34, 46) if x], "g int, a double, b double"), "g", "a", "b").first()
    near = stats.wilcoxon(spark.createDataFrame([(1, float(x), 0.0) for x in range(-34, 46) if x], "g int, a double, b double"), "g", "a", "b", exact=100).first()
    assert far.p == pytest.approx(near.p, rel=0.05) and 0.01 < far.p < 0.3


def test_running_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.random(), rng.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, _part double, _key0 int")
    got = ordered.running(df, ["k"], ["_part"], F.col("_key0"), before="b", total="t").collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.k]
        assert r.t == sum(x[2] for x in mine) and r.b == sum(x[2] for x in mine if x[1] < r._part)
    assert sorted(r.n for r in ordered.numbered(df, [], ["_part"], number="n", size="s").collect()) == list(range(1, 501))
    assert ordered.numbered(df.limit(0), ["k"], ["_part"], number="n", size="s").count() == 0


def test_tiers_equal_the_grid(spark):
    rng = np.random.default_rng(5)
    owners = sorted({(int(e), int(f), int(c)) for e, f, c in zip(rng.integers(0, 12, 400), rng.integers(0, 40, 400), rng.integers(0, 9, 400), strict=True) if e != 3 or c < 2})
    home = [(c, f"s{c % 5}") for c in range(8)] + [(1, "s3"), (2, "gone")]
    gold, neutral = [(0, 1), (2, 4), (7, 0)], [(3, 5), (0, 2), (8, 1)]
    fields = [f"s{i}" for i in range(6)] + ["z"]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = tiers.tiers(frame([*owners, owners[0], (1, None, 2)], "entity int, finding int, condition int"), frame(home, "condition int, field string"), frame(gold, "a int, b int"), frame(neutral, "a int, b int"), frame([(f,) for f in fields], "field string"), most=4, excluded=3, absent=2)
    near = lambda links, c: {b for a, b in links if a == c} | {a for a, b in links if b == c}
    want = []
    for e in {o[0] for o in owners}:
        mine = [o for o in owners if o[0] == e]
        here, findings = {o[2] for o in mine}, sorted({o[1] for o in mine})
        involved = {f for c, f in home if c in here and f in fields}
        for field in involved:
            at = {c for c in here if (c, field) in home}
            lists = {t: [] for t in tiers.TIERS}
            for f in findings:
                own = {o[2] for o in mine if o[1] == f}
                tier = "primary" if own & at else "relevant" if any(near(gold, c) & at for c in own) else "neutral" if any(near(neutral, c) & at for c in own) else "excluded"
                lists[tier].append(f)
            want += [(e, field, "involved", t, k + 1, f) for t, fs in lists.items() for k, f in enumerate(fs[: 3 if t == "excluded" else 4])]
        want += [(e, field, "absent", "excluded", k + 1, f) for field in [f for f in fields if f not in involved][:2] for k, f in enumerate(findings[:3])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("rows", [0, 12, 2_000])
def test_tiers_of_small_and_large_entities(spark, monkeypatch, rows):
    """Entities that are worked on whole, that are spread over ranges, and both."""
    monkeypatch.setattr(tiers, "ENTITY_ROWS", rows)
    frame = spark.createDataFrame
    owners = [(e, (7 * i) % 23, (i * i + e) % 5) for e in range(6) for i in range(4 + 3 * e)]
    home, links = frame([(c, f"s{c % 3}") for c in range(5)], "condition int, field string"), frame([(0, 1), (2, 4)], "a int, b int")
    df = tiers.tiers(frame(owners, "entity int, finding int, condition int"), home, links, frame([(1, 3)], "a int, b int"), frame([(f"s{i}",) for i in range(5)], "field string"), most=3, excluded=2)
    seen = sorted(map(tuple, df.collect()))
    for e, f, involvement, tier, rank, finding in seen:
        mine = [o for o in owners if o[0] == e]
        at = {o[2] for o in mine if f"s{o[2] % 3}" == f}
        link = {"relevant": {(0, 1), (1, 0), (2, 4), (4, 2)}, "neutral": {(1, 3), (3, 1)}}
        tier_of = lambda x: next((t for t, found in [("primary", {o[2] for o in mine if o[1] == x} & at), *[(t, {o[2] for o in mine if o[1] == x for b in at if (o[2], b) in s}) for t, s in link.items()]] if found), "excluded")  # noqa: B023, E731
        held = sorted({o[1] for o in mine if involvement == "absent" or tier_of(o[1]) == tier})
        assert (involvement == "involved") == bool(at) and held[rank - 1] == finding
    assert {(e, i) for e, _, i, *_ in seen} == {(e, i) for e in range(6) for i in ("involved", "absent")}


def test_tiers_shuffle_ordinary_entities_once(spark):
    """No place of a finding is joined, so that no grid is shuffled or written to disk."""
    frame = spark.createDataFrame
    links = frame([(0, 1)], "a int, b int")
    df = tiers.tiers(frame([(1, 2, 0), (1, 3, 1)], "entity int, finding int, condition int"), frame([(0, "s")], "condition int, field string"), links, links, frame([("s",)], "field string"))
    assert "place" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_selection(spark):
    have = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (3, "c"), (None, "a"), (4, None)], "e int, task string")
    need = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "task string")
    assert sorted(r.e for r in selection.covering(have, "e", "task", need).collect()) == [1, 3]
    assert sorted(r.e for r in selection.covering(have, "e", "task", need.limit(0)).collect()) == [1, 2, 3, 4]
    sizes = spark.createDataFrame([(1, 2), (2, 2), (3, 9), (4, 3)], "e int, n int")
    assert [r.e for r in selection.selected(sizes, "e", "n", have, "task", need, least=2, most=8, n=1).collect()] == [1]
    scores = spark.createDataFrame([(1, f"m{i}", 0.5 if i < 3 else 0.1) for i in range(9)], "e int, m string, s double")
    assert sorted(r.e for r in selection.below_ceiling(sizes, "e", scores, "m", "s", solvers=3).collect()) == [2, 3, 4]
    assert selection.below_ceiling(sizes, "e", scores, "m", "s", solvers=4).count() == 4


def test_small_text_functions(spark):
    from tallgrass.functions import clinical, text

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.cloze_text(F.lit("{{c1::a::h}} [[oc2::Normal pressure::(most likely)]] [[oc3::b]] [[x]]"))) == "a Normal pressure b [[x]]"
    assert one(text.media_names(F.lit('<img src="b.png"> [sound:a.mp3] <IMG alt=x src=\'c.jpg\'>[sound:d.ogg]'))) == ["a.mp3", "d.ogg", "b.png", "c.jpg"]
    assert one(text.title_words(F.lit("GI  BLEED & copd"), ("GI",))) == "GI Bleed & Copd"
    assert one(clinical.birth_year(F.lit(0))) is None and one(clinical.birth_year(F.lit(30))) == 1994
    assert one(clinical.status(F.lit("Former smoker, 20 pack-years"), clinical.SMOKING)) == "former" and one(clinical.status(F.lit("drinks 3 beers per day"), clinical.DRINKING)) == "heavy"
    assert one(clinical.origin(F.lit("a native american man"))) == "native american" and one(clinical.origin(F.lit("a man"))) is None


def test_codes_ids_and_first_seen(spark):
    from tallgrass.operators import dedup, resolve

    valid = spark.createDataFrame([("E11.9", False), ("E11", True), ("E119.8", True), ("I10", False)], "code string, is_header boolean")
    codes = spark.createDataFrame([("E11.98",), ("e11 9",), ("E1198",), ("I109",), ("Z99",), ("E1",), (None,), ("I10",)], "c string")
    got = {r.c: r.nearest for r in resolve.nearest_codes(codes, "c", valid).collect()}
    assert got == {"E11.98": "E119", "e11 9": "E11", "E1198": "E119", "I109": "I10", "Z99": None, "E1": None, "I10": "I10"}
    known = spark.createDataFrame([("ees_1",), ("fc_2",), ("3",), ("ees_3",)], "id string")
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("x_3",), ("9",), ("x_8",), (None,)], "i string")
    assert {r.i: r.known_id for r in resolve.known_ids(ids, "i", known).collect()} == {"1": "ees_1", "2": "fc_2", "3": "3", "x_3": "3", "9": "9", "x_8": "x_8"}
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "b", 5), (1, None, 0), (1, "c", 1), (2, "a", 1)], "k int, v string, t int")
    assert {r.k: r["values"] for r in dedup.first_seen(rows, "k", "v", ["t"], most=2).collect()} == {1: ["c", "b"], 2: ["a"]}


def test_holders_sets_are_made_once(spark):
    from tallgrass.operators import containment

    held = spark.createDataFrame([(1, ["a", "b", "c", None, "a"]), (2, []), (3, None), (4, ["z"])], "x int, items array<string>")
    holders = spark.createDataFrame([(1, "a b q r"), (2, "c b a a"), (3, None), (4, ""), (None, "a b c")], "y int, line string").select("y", F.split("line", " ").alias("items"))
    found = containment.containment_join(held, "x", holders, "y", "items", least=0.6)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.x, r.y, round(r.share, 6)) for r in found.collect()) == [(1, 1, 0.666667), (1, 2, 1.0)]
