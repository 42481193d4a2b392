"""Column functions on arrays of structs, loosely written lists, tags and note fields. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def without_flagged(items: Column, flag: str) -> Column:
    """An array of structs without those whose flag is true; a null flag keeps its item, a null array stays null."""
    return F.filter(items, lambda x: ~F.coalesce(x[flag], F.lit(False)))


def allowed_only(items: Column, key: str, allowed: Column) -> Column:
    """An array of structs without those whose key isn't among the allowed; with null allowed none is."""
    return F.filter(items, lambda x: F.coalesce(F.array_contains(allowed, x[key]), F.lit(False)))


def loose_list(c: Column) -> Column:
    """A list that is written as a JSON list, as one JSON value or as text with commas, as an array of strings without blanks and empty entries; empty for null."""
    trimmed = F.trim(c)
    listed = F.when(trimmed.startswith("["), F.from_json(trimmed, "array<string>"))
    one = F.when(trimmed.rlike(r'^".*"$') & ~F.contains(trimmed, F.lit(",")), F.array(F.regexp_replace(trimmed, r'^"|"$', "")))
    parts = F.coalesce(listed, one, F.split(trimmed, ","), F.array().cast("array<string>"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def nan_to_null(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def tag_value(tags: Column, prefix: str, level: int = 1) -> Column:
    """Of the first tag below a prefix (levels are parted by ::) the level after it, with _ as blanks; null without one."""
    below = F.filter(tags, lambda t: F.startswith(F.lower(t), F.lit(prefix.lower() + "::")))
    parts = F.split(F.get(below, F.lit(0)), "::")
    return F.replace(F.get(parts, F.lit(len(prefix.split("::")) + level - 1)), F.lit("_"), F.lit(" "))


def first_field(fields: dict[str, Column], least: int = 1) -> Column:
    """struct<name, value> of the first field, in order, whose trimmed text has at least `least` characters; null without one."""
    found = [F.when(F.length(F.trim(c)) >= least, F.struct(F.lit(n).alias("name"), F.trim(c).alias("value"))) for n, c in fields.items()]
    return F.coalesce(*found)


def question_split(c: Column) -> Column:
    """struct<vignette, question>: the last sentence that ends with ? and has between 11 and 499 characters, and what stands before it; question null without one."""
    found = F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.endswith(s, F.lit("?")) & (F.length(s) > 10) & (F.length(s) < 500))
    before = lambda x: F.length(x["t"]) - F.length(F.call_function("substring_index", x["t"], x["q"], F.lit(-1))) - F.length(x["q"])
    return bound(
        F.struct(F.trim(c).alias("t"), F.try_element_at(found, F.lit(-1)).alias("q")),
        lambda x: F.struct(F.when(x["q"].isNull(), x["t"]).otherwise(F.trim(F.substr(x["t"], F.lit(1), before(x)))).alias("vignette"), x["q"].alias("question")),
    )


def card_kind(model: Column, text: Column, known: dict[str, str]) -> Column:
    """A kind by the first known part of the model's name, else by the text: vignette (an age), occlusion, cloze, or basic."""
    named = reduce(lambda w, e: F.coalesce(w, F.when(F.contains(F.lower(model), F.lit(e[0])), F.lit(e[1]))), known.items(), F.lit(None).cast("string"))
    told = F.when(text.rlike(r"(?i)\b\d+[- ]?(year|month|week|day)s?[- ]old\b"), "vignette").when(F.contains(F.lower(model), F.lit("occlusion")), "occlusion").when(text.rlike(r"\{\{c\d+::"), "cloze").otherwise("basic")
    return F.coalesce(named, told)
