"""Values in texts and what they say about an analyte: the direction by a word, or by a reference range beside the value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Words that tell a direction: fixed values.
HIGH = ("elevated", "increased", "raised", "high", "elevation", "elevations")
LOW = ("decreased", "reduced", "low", "depressed", "suppressed", "deficiency", "deficient", "diminished")
#: What denies a mention that follows within BEFORE characters: fixed values.
DENIALS = ("no ", "not ", "without ", "denies ", "denied ", "negative for ", "absence of ", "absent ", "ruled out", "r/o ", "free of ", "no evidence of ", "resolution of ", "resolved")
#: Characters before a mention in which a denial counts, and after it in which its value is looked for: fixed values.
BEFORE, AFTER = 25, 60
#: Analytes and their names in texts: fixed values.
ANALYTES = {
    "sodium": ("sodium", "na+"), "potassium": ("potassium", "k+"), "calcium": ("calcium",), "magnesium": ("magnesium",), "phosphate": ("phosphate", "phosphorus"), "glucose": ("glucose", "blood sugar", "blood glucose"),
    "creatinine": ("creatinine",), "bun": ("bun", "urea nitrogen"), "cortisol": ("cortisol",), "acth": ("acth", "adrenocorticotropic", "adrenocorticotropin"), "tsh": ("tsh", "thyroid stimulating hormone", "thyrotropin"),
    "t4": ("thyroxine", "free t4", "ft4"), "hemoglobin": ("hemoglobin", "hgb"), "hematocrit": ("hematocrit", "hct"), "wbc": ("wbc", "white blood cell", "leukocyte"), "platelet": ("platelet", "plt"), "troponin": ("troponin",),
    "bnp": ("bnp", "natriuretic peptide", "nt-probnp"), "lactate": ("lactate", "lactic acid"), "bilirubin": ("bilirubin",), "albumin": ("albumin",), "ferritin": ("ferritin",), "b12": ("b12", "cobalamin"),
    "pth": ("pth", "parathyroid hormone"), "ck": ("creatine kinase",), "ast": ("ast", "aspartate aminotransferase"), "alt": ("alt", "alanine aminotransferase"),
}
#: Findings that name an analyte and a direction in one word: fixed values.
NAMED = {
    "hyperkalemia": ("potassium", "high"), "hypokalemia": ("potassium", "low"), "hypernatremia": ("sodium", "high"), "hyponatremia": ("sodium", "low"), "hypercalcemia": ("calcium", "high"), "hypocalcemia": ("calcium", "low"),
    "hyperglycemia": ("glucose", "high"), "hypoglycemia": ("glucose", "low"), "hypermagnesemia": ("magnesium", "high"), "hypomagnesemia": ("magnesium", "low"), "hyperphosphatemia": ("phosphate", "high"),
    "hypophosphatemia": ("phosphate", "low"), "hyperbilirubinemia": ("bilirubin", "high"), "hyperlactatemia": ("lactate", "high"),
}
NUMBER = r"-?\d+(?:\.\d+)?"
RANGE = r"(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)"


def _any_of(names: tuple[str, ...]) -> str:
    return "(?<![a-z])(?:" + "|".join(rf"\Q{n}\E" for n in names) + ")(?![a-z])"


def _has_word(low: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(low, F.lit("([a-z]+)"), 1), F.array(*[F.lit(w) for w in words]))


def expected(finding: Column) -> Column:
    """The analyte and direction (high or low) that a finding speaks of, as a struct: by its one-word name, else by the first analyte of the list that it names beside a word that tells a direction. Null without both."""
    low = F.lower(finding)
    told = lambda analyte, direction: F.struct(F.lit(analyte).alias("analyte"), direction.alias("direction"))
    out = None
    for name, (analyte, direction) in NAMED.items():
        hit = F.contains(low, F.lit(name))
        out = F.when(hit, told(analyte, F.lit(direction))) if out is None else out.when(hit, told(analyte, F.lit(direction)))
    way = F.when(_has_word(low, HIGH), "high").when(_has_word(low, LOW), "low")
    for analyte, names in ANALYTES.items():
        out = out.when(way.isNotNull() & low.rlike(_any_of(names)), told(analyte, way))
    return out


def direction(window: Column) -> Column:
    """What a piece of text in lower case says of a value: high or low by a word, else by its first range, with which the first number outside of it is compared (normal if it lies within); null without either."""
    edge = lambda k: F.regexp_extract(window, RANGE, k).try_cast("double")
    rest = F.regexp_extract(window, f"(?s)^(.*?){RANGE}(.*)$", 1), F.regexp_extract(window, f"(?s)^(.*?){RANGE}(.*)$", 4)
    first = [F.regexp_extract(r, f"({NUMBER})", 1).try_cast("double") for r in rest]
    value = F.coalesce(*first)
    return F.when(_has_word(window, HIGH), "high").when(_has_word(window, LOW), "low").when(edge(1).isNotNull() & value.isNotNull(), F.when(value < edge(1), "low").when(value > edge(2), "high").otherwise("normal"))


def reported(text: Column, pattern: Column) -> Column:
    """The directions that a text reports at the matches of a pattern (a regular expression without groups, on lower case), one for each match that no denial stands before, in order; null for one that says nothing."""
    def mentions(low: Column) -> Column:
        between, said = F.split(low, pattern), F.regexp_extract_all(low, F.concat(F.lit("("), pattern, F.lit(")")), 1)

        def judged(parts: Column) -> Column:
            piece = lambda k: F.concat(F.coalesce(F.get(said, k - 1), F.lit("")), F.get(parts, k))
            before = lambda i: F.right(F.array_join(F.transform(F.sequence(F.greatest(i - BEFORE // 2, F.lit(0)), i), piece), ""), F.lit(BEFORE))
            after = lambda i: F.left(F.array_join(F.transform(F.sequence(i + 1, F.least(i + 1 + AFTER // 2, F.size(said))), piece), ""), F.length(F.get(said, i)) + AFTER)
            each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(said) - 1, F.lit(0))), lambda i: F.struct(before(i).alias("before"), after(i).alias("after")))
            clear = F.filter(each, lambda m: ~reduce(lambda a, d: a | F.contains(m["before"], F.lit(d)), DENIALS, F.lit(False)))
            return F.when(F.size(said) > 0, F.transform(clear, lambda m: direction(m["after"]))).otherwise(F.array().cast("array<string>"))

        return bound(between, judged)

    return bound(F.lower(F.coalesce(text, F.lit(""))), mentions)


def value_agrees(finding: Column, text: Column) -> Column:
    """Whether a text reports a finding's analyte in the finding's direction, by a word or by a value and its range; false if the finding speaks of no analyte."""
    patterns = F.create_map(*[F.lit(x) for name, names in ANALYTES.items() for x in (name, _any_of(names))])
    agrees = lambda asked: F.array_contains(reported(text, F.try_element_at(patterns, asked["analyte"])), asked["direction"])
    return F.coalesce(bound(expected(finding), agrees), F.lit(False))


#: Characters before a mention that may deny it, and what ends a clause: fixed values.
DENIED_WITHIN, CLAUSE_END = 30, r"(?s)^.*(?: but | however |;|\. )"


def only_denied(finding: Column, text: Column) -> Column:
    """Whether a text holds a finding, in whatever case, and each mention follows a denial within DENIED_WITHIN characters of its clause; false without a mention."""

    def mentions(phrase: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

        def judged(parts: Column) -> Column:
            # As each piece and mention has a character at least, so many pieces cover what stands before a mention.
            first = lambda i: F.greatest(i - DENIED_WITHIN, F.lit(1))
            before = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.right(F.call_function("array_join", F.slice(parts, first(i), i - first(i) + 1), phrase), F.lit(DENIED_WITHIN)))
            denied = lambda p: bound(F.regexp_replace(p, CLAUSE_END, ""), lambda q: reduce(lambda a, d: a | F.contains(q, F.lit(d)), DENIALS, F.lit(False)))
            return (F.size(parts) > 1) & F.forall(before, denied)

        return (phrase != "") & bound(F.split(F.lower(F.coalesce(text, F.lit(""))), quoted), judged)

    return F.coalesce(bound(F.lower(F.trim(finding)), mentions), F.lit(False))
