"""Problem lists against the right ones: codes are matched one to one, and weighed by how severe they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories and first letters of severe codes, and the weights of severe, moderate and routine ones: fixed values.
SEVERE_CATEGORIES = ("A41", "E87", "I21", "I26", "I60", "I61", "I63", "J96", "K72", "N17", "T78")
SEVERE_LETTERS = ("A", "B", "C", "D", "I", "J", "S", "T")
WEIGHTS = (3.0, 2.0, 1.0)
#: Names of courses, and the one that each stands for: fixed values.
COURSES = {
    "acute": "acute", "chronic": "chronic", "acute_on_chronic": "acute_on_chronic", "subacute": "acute", "resolving": "acute", "stable": "chronic", "exacerbation": "acute_on_chronic", "flare": "acute_on_chronic",
    "acute on chronic": "acute_on_chronic", "acute-on-chronic": "acute_on_chronic",
}


def plain(code: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(code, F.lit("")), "[. ]", ""))


def severity(code: Column, course: Column) -> Column:
    """The weight of a plain code: severe by its category, or if it is active (acute, acute on chronic) and has a severe letter; moderate if one of both holds; else routine."""
    active, grave = F.coalesce(course.isin("acute", "acute_on_chronic"), F.lit(False)), F.left(code, F.lit(1)).isin(*SEVERE_LETTERS)
    severe, moderate, routine = WEIGHTS
    return F.when(F.left(code, F.lit(3)).isin(*SEVERE_CATEGORIES) | (active & grave), severe).when(active | grave, moderate).otherwise(routine)


def course(c: Column) -> Column:
    """The course that a name stands for; null for any other name."""
    known = F.create_map(*[F.lit(x) for e in COURSES.items() for x in e])
    return F.try_element_at(known, F.trim(F.lower(c)))


def _common(a: Column, b: Column) -> Column:
    """The length of the common beginning of two texts."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: (F.left(a, i) == F.left(b, i)) & (i <= F.least(F.length(a), F.length(b)))))


def matched(truth: DataFrame, given: DataFrame, item: str) -> DataFrame:
    """Rows (item, t_place, t_code, g_place, g_code): the pairs when each right code in turn takes an equal code, and then each one left one of its category (injuries: of its first five characters) with the longest common beginning
    (ties: the earliest), every code once.

    Both tables have item, place (unique within an item) and code; codes are compared plain. Codes meet by item and code, then by item and category; an item's codes of one category are one array.
    """
    side = lambda df, s: df.select(F.col(item).alias("item"), F.lit(s).alias("side"), F.col("place").cast("long").alias("place"), plain(F.col("code")).alias("code")).where("item IS NOT NULL")
    every = side(truth, 0).union(side(given, 1))
    places = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("place"))))
    equal = every.groupBy("item", "code").agg(places(0).alias("t"), places(1).alias("g")).withColumn("n", F.least(F.size("t"), F.size("g")))
    exact = equal.select("item", F.col("code").alias("t_code"), F.col("code").alias("g_code"), F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.col("n")).alias("t"), F.slice("g", F.lit(1), F.col("n")).alias("g"))).alias("p"))
    rest = lambda name: F.transform(F.slice(name, F.col("n") + 1, F.size(name)), lambda p: F.struct(p.alias("place"), F.col("code").alias("code")))
    key = F.when(F.left("code", F.lit(1)).isin("S", "T"), F.left("code", F.lit(5))).otherwise(F.left("code", F.lit(3)))
    left = equal.select("item", key.alias("key"), rest("t").alias("t"), rest("g").alias("g")).groupBy("item", "key").agg(F.sort_array(F.flatten(F.collect_list("t"))).alias("t"), F.sort_array(F.flatten(F.collect_list("g"))).alias("g")).where("size(t) > 0 AND size(g) > 0")

    def step(acc: Column, t: Column) -> Column:
        best = F.array_max(F.transform(acc["left"], lambda g: F.struct(_common(g["code"], t["code"]).alias("n"), (-g["place"]).alias("order"), g["code"].alias("code"))))
        pair = F.struct(t["place"].alias("t_place"), t["code"].alias("t_code"), (-best["order"]).alias("g_place"), best["code"].alias("g_code"))
        return F.struct(F.filter(acc["left"], lambda g: ~F.coalesce(g["place"] == -best["order"], F.lit(False))).alias("left"), F.when(best.isNotNull(), F.concat(acc["pairs"], F.array(pair))).otherwise(acc["pairs"]).alias("pairs"))

    none = F.array().cast("array<struct<t_place:bigint,t_code:string,g_place:bigint,g_code:string>>")
    near = left.select("item", F.explode(F.aggregate("t", F.struct(F.col("g").alias("left"), none.alias("pairs")), step, lambda acc: acc["pairs"])).alias("p")).select("item", "p.*")
    pairs = exact.select("item", F.col("p.t").alias("t_place"), "t_code", F.col("p.g").alias("g_place"), "g_code").unionByName(near)
    return pairs.withColumnRenamed("item", item)


def scores(truth: DataFrame, given: DataFrame, item: str, *, neutral: DataFrame | None = None) -> DataFrame:
    """Rows for each item with a given code: n_true, n_given, n_matched, recall, precision, f1, weighted_recall, precision_neutral, n_neutral, specificity, n_courses and n_right_courses.

    truth and given have item, place, code and course. neutral (item, category) lists categories that are no mistake: unmatched given codes of them aren't counted in precision_neutral, which is null if nothing else is left. specificity is the
    mean share of characters that a pair has in common (1 where the right code is an unspecified one; null without pairs). Of several courses of a code the one of the last place counts. Without right codes recall is 1.
    """
    t, g = (df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), "place", plain(F.col("code")).alias("code"), course(F.col("course")).alias("course")) for df in (truth, given))
    last = lambda df, name: df.groupBy("item", F.col("code").alias(f"{name}_code")).agg(F.max_by("course", "place").alias(f"{name}_course"))
    pairs = matched(truth, given, item).withColumnRenamed(item, "item").join(last(t, "t"), ["item", "t_code"]).join(last(g, "g"), ["item", "g_code"])
    full = F.when((F.length("t_code") >= 4) & (F.substring("t_code", 4, 1) == "9"), 1.0).otherwise(_common(F.col("t_code"), F.col("g_code")) / F.greatest(F.length("t_code"), F.length("g_code"), F.lit(1)))
    told = F.col("t_course").isNotNull() & F.col("g_course").isNotNull()
    hits = pairs.groupBy("item").agg(F.count("*").alias("n_matched"), F.sum(severity(F.col("t_code"), F.col("t_course"))).alias("w"), F.avg(full).alias("specificity"), F.count_if(told).alias("n_courses"), F.count_if(told & (F.col("t_course") == F.col("g_course"))).alias("n_right_courses"))
    right = t.groupBy("item").agg(F.count("*").alias("n_true"), F.sum(severity(F.col("code"), F.col("course"))).alias("total"))
    out = g.groupBy("item").agg(F.count("*").alias("n_given")).join(right, "item", "left").join(hits, "item", "left")
    if neutral is not None:
        spare = g.join(pairs.select("item", F.col("g_place").alias("place")), ["item", "place"], "left_anti").withColumn("category", F.left("code", F.lit(3)))
        out = out.join(spare.join(neutral.select(F.col(item).alias("item"), "category").distinct(), ["item", "category"], "left_semi").groupBy("item").agg(F.count("*").alias("n_neutral")), "item", "left")
    else:
        out = out.withColumn("n_neutral", F.lit(0))
    out = out.na.fill(0, ["n_true", "n_matched", "n_neutral", "n_courses", "n_right_courses"]).na.fill(0.0, ["w", "total"])
    recall = F.when(F.col("n_true") > 0, F.col("n_matched") / F.col("n_true")).otherwise(1.0)
    precision = F.col("n_matched") / F.col("n_given")
    return out.select(
        F.col("item").alias(item), "n_true", "n_given", "n_matched", recall.alias("recall"), precision.alias("precision"), F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0).alias("f1"),
        F.when(F.col("n_true") > 0, F.col("w") / F.col("total")).otherwise(1.0).alias("weighted_recall"), (F.col("n_matched") / F.nullif(F.col("n_given") - F.col("n_neutral"), F.lit(0))).alias("precision_neutral"),
        F.col("n_neutral").cast("long").alias("n_neutral"), "specificity", "n_courses", "n_right_courses",
    )


def summary(each: DataFrame) -> DataFrame:
    """One row of means over items of scores: recall, precision, precision_neutral (over items that have one; else precision), weighted_recall, specificity and course_accuracy, the harmonic means f1, weighted_f1, f1_neutral and
    weighted_f1_neutral, n_neutral and n_scored. A mean over nothing is 0."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    one = each.agg(
        mean("recall").alias("recall"), mean("precision").alias("precision"), F.coalesce(F.avg("precision_neutral"), F.avg("precision"), F.lit(0.0)).alias("precision_neutral"), mean("weighted_recall").alias("weighted_recall"),
        mean("specificity").alias("specificity"), F.coalesce(F.sum("n_right_courses") / F.nullif(F.sum("n_courses"), F.lit(0)), F.lit(0.0)).alias("course_accuracy"), F.coalesce(F.sum("n_neutral"), F.lit(0)).alias("n_neutral"), F.count("*").alias("n_scored"),
    )
    both = lambda a, b: F.when(F.col(a) + F.col(b) > 0, 2 * F.col(a) * F.col(b) / (F.col(a) + F.col(b))).otherwise(0.0)
    return one.withColumns({"f1": both("recall", "precision"), "weighted_f1": both("weighted_recall", "precision"), "f1_neutral": both("recall", "precision_neutral"), "weighted_f1_neutral": both("weighted_recall", "precision_neutral")})
