"""Names to codes by cascades of look-ups with a fuzzy last step, concepts in texts, audits and corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import clinical, similarity, text

#: What is dropped from a condition before it is compared: a fixed value.
QUALIFIERS = r"\(.*?\)|\bhistory of\b|\bhx of\b|\bstatus post\b|\bs/p\b|\bresolved\b|\bhealed\b|\btreated\b|\bwell.controlled\b|\bpoorly.controlled\b|\bmoderate\b|\bmild\b|\bsevere\b|\brecurrent\b|\bchronic\b|\bessential\b|\bprimary\b|\bsecondary to\b.*$"
#: Least share of matching characters and length of a word that is snapped: fixed values.
SNAP_RATIO, SNAP_LENGTH = 0.86, 6


def fuzzy_best(names: DataFrame, known: DataFrame, name: str, *, least: float = 0.7, parts: Callable[[Column], Column] = text.char_ngrams) -> DataFrame:
    """Rows (name, match, score): for each name the known name whose set of parts (trigrams) has the greatest Jaccard similarity, `least` at least; ties go to the alphabetically first.

    Two sets that reach `least` share one of the rarest size - ceil(least * size) + 1 of either, so only these are joined, by equality; no pair that counts is lost.
    """
    def grams(df: DataFrame) -> DataFrame:
        return df.select(F.col(name).alias("text")).where("text IS NOT NULL").distinct().withColumn("grams", parts(F.col("text")))

    asked, given = grams(names), grams(known)
    common = given.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, alias: str) -> DataFrame:
        each = df.select("text", "grams", F.explode("grams").alias("g")).join(common, "g", "left")
        ranked = each.groupBy("text", "grams").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("r"))
        first = F.size("grams") - F.ceil(F.size("grams") * least - 1e-9).cast("int") + 1
        return ranked.select(F.col("text").alias(alias), F.col("grams").alias(f"{alias}_grams"), F.explode(F.slice("r", F.lit(1), first)).alias("x")).select(alias, f"{alias}_grams", "x.g")

    pairs = rare(asked, "a").join(rare(given, "b"), "g").drop("g").distinct()
    scored = pairs.withColumn("score", text.jaccard(F.col("a_grams"), F.col("b_grams"))).where(F.col("score") >= least)
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b"))).alias("x"))
    return best.select(F.col("a").alias(name), F.col("x.b").alias("match"), (-F.col("x.s")).alias("score"))


def cascade(names: DataFrame, name: str, stages: dict[str, DataFrame], *, fuzzy: DataFrame | None = None, least: float = 0.7, none: str = "none") -> DataFrame:
    """Rows (name, code, method) for each distinct name: the code of the first stage that has the name, else of the most similar name of fuzzy, and which step gave it.

    Stages and fuzzy have the name column and code; of several codes of a name the smallest counts. A name that nothing has gets a null code and the method `none`. Null names are left out.
    """
    out = names.select(name).where(F.col(name).isNotNull()).distinct()
    code, method = F.lit(None), F.lit(None)
    for i, (label, table) in enumerate(stages.items()):
        out = out.join(table.groupBy(name).agg(F.min("code").alias(f"_c{i}")), name, "left")
        code, method = F.coalesce(code, F.col(f"_c{i}")), F.coalesce(method, F.when(F.col(f"_c{i}").isNotNull(), label))
    out = out.select(name, code.alias("code"), method.alias("method"))
    if fuzzy is not None:
        near = fuzzy_best(out.where("code IS NULL"), fuzzy, name, least=least).join(fuzzy.groupBy(F.col(name).alias("match")).agg(F.min("code").alias("_near")), "match")
        out = out.join(near.select(name, "_near"), name, "left")
        out = out.select(name, F.coalesce("code", "_near").alias("code"), F.coalesce("method", F.when(F.col("_near").isNotNull(), "fuzzy")).alias("method"))
    return out.withColumn("method", F.coalesce("method", F.lit(none)))


def concepts(docs: DataFrame, id_col: str, text_col: str, inventory: DataFrame, *, max_df: int | None = None) -> DataFrame:
    """Rows (id_col, concept): the concepts of an inventory (concept, name) all of whose words a text holds; of concepts whose words are among those of another one found, only that one counts.

    Two words are alike if they share a singular form. A concept of one word that more than max_df texts hold tells nothing and is left out (None: none is). Texts and names without words hold nothing.

    Texts meet a name by the name's rarest word alone; the other words are looked up in the text's own forms. Of what a text holds, lesser concepts are found within the text.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    all_forms = lambda w: F.array_distinct(F.flatten(F.transform(w, clinical.singular_forms)))
    named = inventory.select("concept", words(F.col("name")).alias("words")).where("size(words) > 0")
    listed = named.select("concept", F.sort_array("words").alias("words")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), all_forms(words(F.col(text_col))).alias("forms")).where("size(forms) > 0")
    held = texts.select("_id", F.explode("forms").alias("form")).groupBy("_id", "form").agg(F.lit(1).alias("_one"))
    common = held.groupBy("form").agg(F.count("*").alias("n"))
    each = listed.select("concept", "words", F.explode("words").alias("word")).withColumn("form", F.explode(clinical.singular_forms(F.col("word"))))
    cost = each.join(common, "form", "left").groupBy("concept", "words", "word").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_list("form").alias("forms"))
    rare = cost.groupBy("concept", "words").agg(F.min_by("forms", F.struct("n", "word")).alias("forms")).select("concept", "words", F.explode("forms").alias("form"))
    likely = held.join(rare, "form").groupBy("_id").agg(F.collect_set(F.struct("concept", "words")).alias("likely"))
    merged = held.groupBy("_id").agg(F.collect_list("form").alias("forms")).join(likely, "_id")
    holds = lambda forms, c: F.forall(c["words"], lambda w: F.arrays_overlap(forms, clinical.singular_forms(w)))
    found = merged.select("_id", F.filter("likely", lambda c: holds(F.col("forms"), c)).alias("all")).where("size(all) > 0")
    if max_df is not None:
        heavy = found.select("_id", F.explode("all").alias("c")).where("size(c.words) = 1").groupBy("c.concept").agg(F.count_distinct("_id").alias("n")).where(F.col("n") > max_df)
        single = found.select("_id", F.explode("all").alias("c")).join(heavy.select(F.col("concept").alias("_heavy")), F.col("c.concept") == F.col("_heavy"), "left_anti")
        found = single.groupBy("_id").agg(F.collect_list("c").alias("all"))
    lesser = lambda c: F.exists("all", lambda o: (F.size(c["words"]) < F.size(o["words"])) & F.forall(c["words"], lambda w: F.arrays_overlap(clinical.singular_forms(w), all_forms(o["words"]))))
    kept = found.select("_id", F.explode(F.filter("all", lambda c: ~lesser(c))).alias("c"))
    return kept.select(F.col("_id").alias(id_col), F.col("c.concept").alias("concept")).distinct()


def nearest_codes(codes: DataFrame, code: str, valid: DataFrame) -> DataFrame:
    """Rows (code, nearest) for each distinct code: the longest of its beginnings of four characters or more, shorter than itself, that is a valid code and no header; else its first three characters, if they are a code of any kind; else null.

    Codes are compared without dots and spaces, in upper case; one of fewer than three characters has no nearest. valid has code and is_header. Beginnings are joined by equality.
    """
    plain = lambda c: F.upper(F.regexp_replace(c, "[. ]", ""))
    asked = codes.select(F.col(code).alias("_code")).where("_code IS NOT NULL").distinct().withColumn("_plain", plain(F.col("_code")))
    known = valid.select(plain(F.col("code")).alias("_part"), F.coalesce("is_header", F.lit(False)).alias("_header")).where("_part <> ''").groupBy("_part").agg(F.min("_header").alias("_header"))
    n = F.length("_plain")
    parts = asked.where(n >= 3).withColumn("_n", F.explode(F.sequence(F.lit(3), F.greatest(n - 1, F.lit(3))))).withColumn("_part", F.left("_plain", F.col("_n")))
    fit = parts.join(known, "_part").where((F.col("_n") == 3) | ~F.col("_header")).groupBy("_code").agg(F.max_by("_part", "_n").alias("nearest"))
    return asked.join(fit, "_code", "left").select(F.col("_code").alias(code), "nearest")


def known_ids(ids: DataFrame, column: str, known: DataFrame, *, prefixes: tuple[str, ...] = ("ees_", "fc_")) -> DataFrame:
    """Rows (column, known_id) for each distinct id: the id itself if it is among known (its column id), else the first prefix and the id, else what follows the id's first underscore; the id as it is if none is known."""
    own = F.col("_id")
    forms = F.array(own, *[F.concat(F.lit(p), own) for p in prefixes], F.when(F.contains(own, F.lit("_")), F.regexp_replace(own, "^[^_]*_", "")))
    each = ids.select(F.col(column).cast("string").alias("_id")).where("_id IS NOT NULL").distinct().select("_id", F.posexplode(forms).alias("_k", "_form"))
    found = each.join(known.select(F.col("id").cast("string").alias("_form")).distinct(), "_form").groupBy("_id").agg(F.min_by("_form", "_k").alias("_found"))
    return each.select("_id").distinct().join(found, "_id", "left").select(F.col("_id").alias(column), F.coalesce("_found", "_id").alias("known_id"))


def corrected(store: DataFrame, fixes: DataFrame, key: str, value: str) -> DataFrame:
    """The store (key, value; values unique) after fixes (key, value), with status: kept, applied, or conflict where another key holds the value or a smaller key asks for it; then the old value stays."""
    asked = fixes.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_new"))
    wanted = store.join(asked, key).where(~F.col("_new").eqNullSafe(F.col(value))).select(key, "_new")
    held = store.select(F.col(value).alias("_new")).distinct().withColumn("_held", F.lit(True))
    first = wanted.groupBy("_new").agg(F.min(key).alias("_first"))
    judged = wanted.join(held, "_new", "left").join(first, "_new").select(key, "_new", (F.col("_held").isNull() & (F.col("_first") == F.col(key))).alias("_fits"))
    out = store.join(judged, key, "left")
    status = F.when(F.col("_fits").isNull(), "kept").when(F.col("_fits"), "applied").otherwise("conflict")
    return out.select(key, F.when(F.col("_fits"), F.col("_new")).otherwise(F.col(value)).alias(value), status.alias("status"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a hash of seed and key (ties: the key): a sample that a rerun repeats."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def ordered_by(df: DataFrame, keys: dict[str, str], asked: str, tie: str) -> DataFrame:
    """df in the order that a parameter names: one of keys, with - before it for descending; any other sorts by the tie key alone."""
    column = keys.get(asked.removeprefix("-"))
    order = [] if column is None else [F.desc_nulls_last(column) if asked.startswith("-") else F.asc_nulls_last(column)]
    return df.orderBy(*order, tie)


def latest(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n last rows of each key in an order that tells its rows apart, with k from 1."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))).where(F.col("k") <= n)


def plain_condition(c: Column) -> Column:
    """A condition in lower case without qualifiers and marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), QUALIFIERS, " "), "[^a-z0-9/ ]", " "))


def category_sets(conditions: DataFrame, key: str, condition: str, rules: list[tuple[str, list[str]]], names: DataFrame, *, least: float = 0.6) -> DataFrame:
    """Rows (key, category, method): the categories of each key's conditions.

    A condition that fits patterns of the rules (alias) gets all their categories; any other those of the names (name, category) that are equal to it without qualifiers (exact), else those of the name with the most
    similar set of words (fuzzy: Jaccard `least` at least, ties to the alphabetically first name; of its categories the smallest). One condition is judged once, however many keys have it. Null conditions give nothing.
    """
    asked = conditions.select(F.col(condition).alias("condition")).where("condition IS NOT NULL").distinct()
    hits = [F.when(F.lower("condition").rlike(p), F.array(*[F.lit(c) for c in cats])).otherwise(F.array().cast("array<string>")) for p, cats in rules]
    alias = F.array_distinct(F.flatten(F.array(*hits))) if hits else F.array().cast("array<string>")
    judged = asked.select("condition", plain_condition(F.col("condition")).alias("name"), alias.alias("alias"))
    listed = names.select(plain_condition(F.col("name")).alias("name"), "category").where("name <> ''").distinct()
    by_rule = judged.select("condition", F.explode("alias").alias("category"), F.lit("alias").alias("method"))
    left = judged.where((F.size("alias") == 0) & (F.col("name") != "")).select("condition", "name")
    exact = left.join(listed, "name").select("condition", "category", F.lit("exact").alias("method"))
    near = fuzzy_best(left.join(listed, "name", "left_anti"), listed, "name", least=least, parts=lambda c: F.array_distinct(text.words(c)))
    fuzzy = left.join(near, "name").join(listed.groupBy(F.col("name").alias("match")).agg(F.min("category").alias("category")), "match").select("condition", "category", F.lit("fuzzy").alias("method"))
    found = by_rule.union(exact).union(fuzzy)
    return conditions.select(key, F.col(condition).alias("condition")).distinct().join(found, "condition").select(key, "category", "method").distinct()


def snapped(words: DataFrame, vocabulary: DataFrame, word: str) -> DataFrame:
    """Rows (word, snapped, ratio) for the words of SNAP_LENGTH characters or more outside of the vocabulary that have a near word in it: the same first letter, a length that differs by two at most and the greatest ratio of matching characters,
    SNAP_RATIO at least; ties go to the alphabetically last. Words are compared as they are; null words are left out.

    In such a pair, of n and m characters, at most `loose` = (1 - SNAP_RATIO) (n + m) characters are unmatched, and as many modulo 2 as n + m. So of loose + 1 pieces of the known word one stands unchanged in the other word, shifted by at
    most `loose`: words are joined by such pieces, by equality, and the ratio decides; no word that counts is lost.
    """
    n, m, i = F.col("n"), F.col("m"), F.col("i")
    most = F.floor((1 - SNAP_RATIO) * (n + m) + 1e-9).cast("int")
    loose = most - F.abs((most - n - m) % 2)
    begins, stops = F.floor(i * m / (F.col("loose") + 1)).cast("int"), F.floor((i + 1) * m / (F.col("loose") + 1)).cast("int")

    def pieces(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """Each word with its pieces' numbers for every length that the other word may have."""
        w = df.select(F.col(word).alias(name)).where(F.col(word) != "").distinct()
        sized = w.withColumn(own, F.length(name)).withColumn(other, F.explode(F.sequence(F.col(own) - 2, F.col(own) + 2)))
        fits = sized.where((n >= SNAP_LENGTH) & (m > 0)).withColumn("loose", loose).where(F.col("loose") >= F.abs(n - m))
        return fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("loose")))).withColumn("first", F.substring(name, 1, 1)).withColumn("begins", begins).withColumn("length", stops - begins)

    unknown = words.join(vocabulary.select(word).distinct(), word, "left_anti")
    left = pieces(unknown, "a", "n", "m").withColumn("at", F.explode(F.sequence(F.col("begins") - F.col("loose"), F.col("begins") + F.col("loose"))))
    left = left.where((F.col("at") >= 0) & (F.col("at") + F.col("length") <= n)).select("a", "first", "n", "m", "i", F.substr("a", F.col("at") + 1, F.col("length")).alias("piece")).distinct()
    right = pieces(vocabulary, "b", "m", "n").select("b", "first", "n", "m", "i", F.substr("b", F.col("begins") + 1, F.col("length")).alias("piece"))
    likely = left.join(right, ["first", "n", "m", "i", "piece"]).select("a", "b").distinct()
    scored = likely.select("a", "b", similarity.column(similarity.ratio, "double")("b", "a").alias("ratio")).where(F.col("ratio") >= SNAP_RATIO)
    best = scored.groupBy("a").agg(F.max(F.struct("ratio", "b")).alias("x"))
    return best.select(F.col("a").alias(word), F.col("x.b").alias("snapped"), F.col("x.ratio").alias("ratio"))
