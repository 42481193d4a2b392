"""What is wrong with a prediction: rows (item, category, subtype, number, detail), the first few of each kind, and how many there are of it in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import problems

KEYS = ("item", "category", "subtype")


def capped(rows: DataFrame, order: list[str], caps: dict[str, int], *, otherwise: int = 5) -> DataFrame:
    """Rows (item, category, subtype, number, detail, n_all): of the rows of an item and subtype the first in the order, as many as caps has for the subtype; n_all counts them all."""
    kind = Window.partitionBy(*KEYS)
    most = F.coalesce(*[F.when(F.col("subtype") == s, n) for s, n in caps.items()], F.lit(otherwise))
    counted = rows.withColumn("number", F.row_number().over(kind.orderBy(*order))).withColumn("n_all", F.count("*").over(kind))
    return counted.where(F.col("number") <= most).select(*KEYS, "number", "detail", "n_all")


def _kind(category: str, subtype: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(subtype).alias("subtype"))


def first_code(predicted: DataFrame, truth: DataFrame, valid: DataFrame, *, alternatives: DataFrame | None = None, distractors: DataFrame | None = None) -> DataFrame:
    """The errors of each item's first predicted code. All tables but valid (code, is_header) have item and code; predicted and truth one row an item (a right code that is null or empty judges nothing).

    No row or code: parse_failure or schema_mismatch. A code that is right or an alternative has no error. Else: a code that isn't valid is nonexistent, a header a parent code; a valid other code of the right category is of the wrong
    specificity; a distractor is a related differential; and what has no other error is a wrong diagnosis. A code that doesn't exist, or is a header, may be a distractor besides.
    """
    code = lambda df, name: df.select("item", problems.plain(F.col("code")).alias(name))
    asked = code(truth, "right").where("right <> '' AND item IS NOT NULL").dropDuplicates(["item"])
    given = predicted.select("item", F.lit(True).alias("there"), problems.plain(F.col("code")).alias("top")).dropDuplicates(["item"])
    known = valid.select(problems.plain(F.col("code")).alias("top"), F.coalesce("is_header", F.lit(False)).alias("header")).groupBy("top").agg(F.min("header").alias("header"))
    listed = lambda df, name: code(df, "top").where("top <> ''").distinct().withColumn(name, F.lit(True))
    rows = asked.join(given, "item", "left").join(known, "top", "left")
    for df, name in ((alternatives, "also"), (distractors, "lure")):
        rows = rows.join(listed(df, name), ["item", "top"], "left") if df is not None else rows.withColumn(name, F.lit(None).cast("boolean"))
    right = (F.col("top") == F.col("right")) | F.col("also").isNotNull()
    missing, parent = F.col("header").isNull(), F.coalesce("header", F.lit(False))
    near = ~missing & ~parent & (F.left("top", F.lit(3)) == F.left("right", F.lit(3)))
    lure = F.col("lure").isNotNull() & (F.col("top") != F.col("right")) & ~near
    found = F.array_compact(F.array(
        F.when(missing, _kind("coding_error", "nonexistent_code")), F.when(parent, _kind("coding_error", "parent_code")), F.when(near, _kind("coding_error", "wrong_specificity")),
        F.when(lure, _kind("reasoning_error", "related_differential")), F.when(~missing & ~parent & ~near & ~lure, _kind("reasoning_error", "wrong_diagnosis")),
    ))
    kinds = F.when(F.col("there").isNull(), F.array(_kind("parse_failure", "wrong_structure"))).when(F.col("top") == "", F.array(_kind("schema_mismatch", "missing_required_key"))).when(right, F.array().cast("array<struct<category:string,subtype:string>>")).otherwise(found)
    return rows.select("item", F.explode(kinds).alias("k"), "top").select("item", "k.category", "k.subtype", F.lit(1).alias("number"), F.coalesce("top", F.lit("")).alias("detail"), F.lit(1).cast("long").alias("n_all"))


def grades(rankings: DataFrame, judged: DataFrame, *, caps: dict[str, int] | None = None) -> DataFrame:
    """The errors of ranked passages (item, place, passage, grade) against judgements (item, passage, grade), of items that have any: passages that aren't judged, grades of 3 or more for what is worth nothing (inflation), and of nothing
    for what is worth 3 or more (deflation). Null grades are 0; an unjudged passage is worth nothing."""
    known = judged.groupBy("item", "passage").agg(F.max("grade").alias("worth"))
    rows = rankings.join(known.select("item").distinct(), "item", "left_semi").join(known, ["item", "passage"], "left")
    worth, given = F.coalesce("worth", F.lit(0)), F.coalesce("grade", F.lit(0))
    found = F.array_compact(F.array(
        F.when(F.col("worth").isNull() & (F.coalesce(F.col("passage").cast("string"), F.lit("")) != ""), _kind("schema_mismatch", "wrong_key_name")),
        F.when((given >= 3) & (worth <= 0), _kind("reasoning_error", "grade_inflation")).when((given <= 0) & (worth >= 3), _kind("reasoning_error", "grade_deflation")),
    ))
    each = rows.select("item", "place", F.explode(found).alias("k"), F.col("passage").cast("string").alias("detail")).select("item", "place", "k.*", "detail")
    return capped(each, ["place", "detail"], caps or {"wrong_key_name": 3})


def problem_lists(given: DataFrame, truth: DataFrame, valid: DataFrame, texts: DataFrame, *, caps: dict[str, int] | None = None) -> DataFrame:
    """The errors of problem lists: given and truth have item, place, code and course (see problems.matched), valid code and name, texts item and text (one row an item). Items without right codes are not judged.

    A code that valid doesn't have is nonexistent; a pair whose courses differ is misclassified; a right code without a pair is omitted; a given one without a pair is a wrong diagnosis if the text holds its name, else a hallucination.
    """
    names = valid.select(problems.plain(F.col("code")).alias("code"), "name").groupBy("code").agg(F.min("name").alias("name"))
    sides = {n: df.select("item", "place", problems.plain(F.col("code")).alias("code"), problems.course(F.col("course")).alias("course")) for n, df in (("t", truth), ("g", given))}
    judged = sides["t"].select("item").distinct()
    g, t = sides["g"].join(judged, "item", "left_semi"), sides["t"]
    pairs = problems.matched(truth, given, "item")
    last = lambda df, n: df.groupBy("item", F.col("code").alias(f"{n}_code")).agg(F.max_by("course", "place").alias(f"{n}_course"))
    told = pairs.join(last(t, "t"), ["item", "t_code"]).join(last(g, "g"), ["item", "g_code"]).where("t_course <> g_course")
    row = lambda df, category, subtype, place, detail: df.select("item", F.lit(category).alias("category"), F.lit(subtype).alias("subtype"), F.col(place).cast("long").alias("place"), detail.alias("detail"))
    unknown = g.where("code <> ''").join(names, "code", "left_anti")
    omitted = t.join(pairs.select("item", F.col("t_place").alias("place")), ["item", "place"], "left_anti").join(g.select("item").distinct(), "item", "left_semi")
    spare = g.join(pairs.select("item", F.col("g_place").alias("place")), ["item", "place"], "left_anti").join(names, "code", "left").join(texts.select("item", F.lower("text").alias("text")), "item", "left")
    named = F.coalesce(F.contains("text", F.lower("name")) & (F.col("name") != ""), F.lit(False))
    every = [
        row(unknown, "coding_error", "nonexistent_code", "place", F.col("code")), row(told, "reasoning_error", "acuity_misclass", "t_place", F.concat_ws(":", "t_code", "g_course", "t_course")),
        row(omitted, "omission", "omission", "place", F.col("code")), row(spare.where(named), "reasoning_error", "wrong_diagnosis", "place", F.col("code")), row(spare.where(~named), "hallucination", "hallucination", "place", F.col("code")),
    ]
    rows = every[0]
    for e in every[1:]:
        rows = rows.unionByName(e)
    return capped(rows, ["place", "detail"], caps or {"nonexistent_code": 3})
