"""Concepts in texts by phrases: names whose words stand near each other, curated patterns with prefixes, and concepts that absorb others.

Names are found from their rarest word alone, by one join of equality, and checked on the text's own words; patterns are matched with the distinct words of all texts, not with the texts. Nothing is kept per pair of names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import clinical
from tallgrass.functions.text import bound
from tallgrass.sources.tables import checkpoint_folder

from . import resolve

#: Marks a curated concept's name.
CURATED = "C:"


def content_words(c: Column, *, short: dict[str, str] | None = None, slashed: dict[str, str] | None = None, stop: list[str] | None = None) -> Column:
    """The words of a text in order, in their shortest singular form, without stop words and single characters; slashed and short forms are written out first. A null text has none."""
    known = clinical.written_out(F.coalesce(c, F.lit("")), short=short or {}, slashed=slashed or {})
    kept = F.filter(known, lambda w: (F.length(w) > 1) & (~w.isin(stop) if stop else F.lit(True)))
    return F.transform(kept, clinical_stem)


def clinical_stem(w: Column) -> Column:
    return clinical.stem(w)


def near(tokens: Column, words: Column) -> Column:
    """Whether some place of the longest of the words (ties: the alphabetically last) has all the others within size(words) + 1 places. A single word has only to be there."""
    reach = F.size(words) + 1
    anchor = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    first = lambda i: F.greatest(i - reach, F.lit(0))
    around = lambda i: F.slice(tokens, first(i) + 1, i + reach + 1 - first(i))
    places = bound(anchor, lambda a: F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda i: F.get(tokens, i) == a))
    return F.when(F.size(words) == 1, F.array_contains(tokens, F.element_at(words, 1))).otherwise(F.exists(places, lambda i: F.size(F.array_except(words, around(i))) == 0))


def pattern_hits(texts: DataFrame, key: str, tokens: str, patterns: DataFrame) -> DataFrame:
    """Rows (key, concept, evidence): the concepts one of whose patterns a text has, with the words that show the first such pattern: for each part the first word that fits.

    patterns has concept, number (their order) and pattern: parts with spaces between, of which one with * at its end fits words that begin with its shortest singular form, any other words with a singular form in common. Keys are unique in texts.
    """
    parts = patterns.select("concept", "number", F.filter(F.split("pattern", " +"), lambda p: p != "").alias("p")).where("size(p) > 0").select("concept", "number", F.size("p").alias("need"), F.posexplode("p").alias("part", "text"))
    loose = F.endswith("text", F.lit("*"))
    exact = parts.where(~loose).withColumn("form", F.explode(clinical.singular_forms(F.col("text")))).select("concept", "number", "need", "part", "form")
    prefix = parts.where(loose).withColumn("form", clinical.stem(F.regexp_replace("text", r"\*$", ""))).select("concept", "number", "need", "part", "form")
    # of a word's places the first counts, and distinct words keep the order of these, so that nothing is grouped before words meet parts
    each = texts.select(key, F.array_distinct(tokens).alias("_w"))
    held = each.select(key, F.posexplode("_w").alias("at", "word"))
    vocabulary = held.select("word").distinct()
    whole = vocabulary.withColumn("form", F.explode(clinical.singular_forms(F.col("word")))).join(exact, "form")
    begun = vocabulary.withColumn("form", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.left("word", n)))).join(prefix, "form")
    fitting = whole.unionByName(begun).drop("form").distinct()
    # both groups' keys begin with the text's, so rows are dealt out once
    met = held.join(fitting, "word").select(key, "concept", "number", "need", "part", "at").repartition(key)
    shown = met.groupBy(key, "concept", "number", "need", "part").agg(F.min("at").alias("at"))
    lists = shown.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("concept", "number", "need", "part", "at"))).alias("_p")).join(each, key)
    # parts of a pattern lie side by side: it is whole if the last one stands where it should
    same = lambda x, y: x["concept"].eqNullSafe(y["concept"]) & x["number"].eqNullSafe(y["number"]) & (x["need"] == y["need"])
    ends = F.transform("_p", lambda x, i: F.when((x["part"] == 0) & F.coalesce(same(x, F.get("_p", i + x["need"] - 1)), F.lit(False)), F.struct(x["concept"].alias("concept"), i.alias("i"), x["need"].alias("need"))))
    first = bound(F.filter(ends, lambda x: x.isNotNull()), lambda w: F.filter(w, lambda x, j: (j == 0) | ~F.get(w, j - 1)["concept"].eqNullSafe(x["concept"])))
    words = lambda x: F.array_distinct(F.transform(F.slice("_p", x["i"] + 1, x["need"]), lambda p: F.get("_w", p["at"])))
    found = lists.select(key, F.explode(F.transform(first, lambda x: F.struct(x["concept"].alias("concept"), words(x).alias("evidence")))).alias("x"))
    return found.select(key, "x.concept", "x.evidence")


def name_forms(inventory: DataFrame, words: Callable[[Column], Column], *, most: int | None = 60, longest: int = 6) -> DataFrame:
    """Rows (concept, words): the distinct sets of content words of an inventory's names (concept, name); of equal sets the smallest concept counts. Sets of one word under four characters or of more than `longest` words tell nothing, nor do
    single words that more than `most` sets hold (None: all do)."""
    each = inventory.select("concept", F.sort_array(F.array_distinct(words(F.col("name")))).alias("words"))
    fit = each.where((F.size("words").between(1, longest)) & ((F.size("words") > 1) | (F.length(F.get("words", F.lit(0))) >= 4)))
    forms = fit.groupBy("words").agg(F.min("concept").alias("concept"))
    if most is None:
        return forms
    heavy = forms.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.array("w").alias("words"))
    return forms.join(heavy, "words", "left_anti")


def concepts(
    docs: DataFrame, id_col: str, text_col: str, inventory: DataFrame, patterns: DataFrame, *, generic: list[str] | None = None, words: Callable[[Column], Column] = content_words, most: int | None = 60, snap: bool = False,
) -> DataFrame:
    """Rows (id_col, concept): what a text names, of an inventory (concept, name; string concepts) and of curated patterns (concept, number, pattern), whose concepts are marked by CURATED.

    A name counts where its words stand near each other; a name that shows exactly one curated concept that isn't generic is that concept. Of the inventory's concepts those whose words are among those of another one are dropped, and
    those whose words a curated one has too. With snap, words of six letters or more that no name has become the most similar name's word (see resolve.snapped). Null texts and texts without content words name nothing; rows
    with one id are judged one by one.
    """
    checkpoint_folder(docs.sparkSession)
    # words are made once, and kept: each use would make them again, and once more for every condition on them
    texts = docs.select(F.monotonically_increasing_id().alias("_key"), F.col(id_col).alias("_id"), words(F.col(text_col)).alias("tokens")).checkpoint().where("size(tokens) > 0")
    all_forms = name_forms(inventory, words, most=None).select(F.col("concept").cast("string").alias("concept"), "words").withColumn("_form", F.md5(F.array_join("words", " ")))
    shown = pattern_hits(all_forms.select("_form", "words"), "_form", "words", patterns.where(~F.col("concept").isin(generic)) if generic else patterns)
    single = shown.groupBy("_form").agg(F.count("*").alias("n"), F.min("concept").alias("curated")).where("n = 1").select("_form", F.concat(F.lit(CURATED), "curated").alias("curated"))
    absorbed = all_forms.join(single, "_form", "left").groupBy("concept").agg(F.max("curated").alias("curated"))
    forms = name_forms(inventory, words, most=most).select(F.col("concept").cast("string").alias("concept"), "words")
    if snap:
        texts = _snapped(texts, forms)
    held = texts.select("_key", F.explode(F.array_distinct("tokens")).alias("w"))
    common = held.groupBy("w").agg(F.count("*").alias("n"))
    rarest = forms.select("concept", "words", F.explode("words").alias("w")).join(common, "w", "left").groupBy("concept", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("r"))
    likely = held.join(rarest.select("concept", "words", F.col("r.w").alias("w")), "w").groupBy("_key").agg(F.collect_list(F.struct("concept", "words")).alias("likely"))
    names = texts.select("_key", "tokens").join(likely, "_key").select("_key", F.explode(bound(F.col("tokens"), lambda t: F.filter("likely", lambda f: F.forall(f["words"], lambda w: F.array_contains(t, w)) & near(t, f["words"])))).alias("f"))
    found = names.select("_key", F.col("f.concept").alias("concept"), F.col("f.words").alias("evidence")).join(absorbed, "concept", "left").select("_key", F.coalesce("curated", "concept").alias("concept"), "evidence")
    shown = pattern_hits(texts, "_key", "tokens", patterns).withColumn("concept", F.concat(F.lit(CURATED), "concept"))
    sets = found.unionByName(shown).groupBy("_key", "concept").agg(F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("e"))
    every = sets.groupBy("_key").agg(F.collect_list(F.struct("concept", "e")).alias("all"))
    curated = lambda x: F.startswith(x["concept"], F.lit(CURATED))
    within = lambda x, y: F.forall(x["e"], lambda w: F.array_contains(y["e"], w))
    lesser = lambda x: F.exists("all", lambda y: ((F.size(x["e"]) < F.size(y["e"])) | (curated(y) & (F.size(x["e"]) == F.size(y["e"])))) & within(x, y))
    kept = every.select("_key", F.explode(F.filter("all", lambda x: curated(x) | ~lesser(x))).alias("x")).select("_key", F.col("x.concept").alias("concept"))
    return texts.select("_id", "_key").join(kept, "_key").select(F.col("_id").alias(id_col), "concept").distinct()


def _snapped(texts: DataFrame, forms: DataFrame) -> DataFrame:
    vocabulary = forms.select(F.explode("words").alias("w")).distinct()
    each = texts.select("_id", "_key", F.posexplode("tokens").alias("at", "w"))
    near_words = resolve.snapped(each.select("w").distinct(), vocabulary, "w")
    mended = each.join(near_words, "w", "left").select("_id", "_key", F.struct("at", F.coalesce("snapped", "w").alias("w")).alias("t"))
    return mended.groupBy("_id", "_key").agg(F.sort_array(F.collect_list("t")).alias("t")).select("_id", "_key", F.col("t.w").alias("tokens"))


def agreement(pairs: DataFrame, id_col: str, predicted: str, reference: str, find: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Rows (id_col, n_pred, n_ref, precision, recall, f1) of each pair of texts (unique ids), on the sets of concepts that find(docs, id, text) gives; an empty set's share is 0. find is asked once for all texts
    of both sides, whose ids are structs."""
    side = lambda name, text: F.struct(F.struct(F.col(id_col).alias("id"), F.lit(name).alias("side")).alias("_of"), F.col(text).alias("_text"))
    docs = pairs.select(F.explode(F.array(side("p", predicted), side("r", reference))).alias("x")).select("x.*")
    sides = find(docs, "_of", "_text").groupBy(F.col("_of.id").alias(id_col), "concept").agg(*[F.max(F.when(F.col("_of.side") == n, 1)).alias(n) for n in ("p", "r")])
    both = sides.groupBy(id_col).agg(F.count("p").alias("n_pred"), F.count("r").alias("n_ref"), F.count(F.col("p") + F.col("r")).alias("n"))
    share = lambda of: F.when(F.coalesce(of, F.lit(0)) > 0, F.col("n") / of).otherwise(0.0)
    rated = pairs.select(id_col).join(both, id_col, "left").select(id_col, F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("n_ref", F.lit(0)).alias("n_ref"), share(F.col("n_pred")).alias("precision"), share(F.col("n_ref")).alias("recall"))
    total = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
