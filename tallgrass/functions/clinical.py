"""Column functions for notes and codes: demographics, answer choices, name variants, globs, stems and rewrites. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import shortforms
from .text import bound

#: Units of an age and how many of them make a year, in the order in which they are looked for: fixed values.
AGE_UNITS = ((r"(\d+)[- ]?(?:years?|y/?o)\b", 1.0), (r"(\d+)[- ]?months?[- ]old", 12.0), (r"(\d+)[- ]?weeks?[- ]old", 52.0), (r"(\d+)[- ]?days?[- ]old", 365.0))
#: Endings of plurals of words with more than four characters, and what stands in their place: fixed values.
PLURALS = (("ies", "y"), ("ses", "sis"), ("es", ""), ("s", ""))


def age_years(c: Column) -> Column:
    """The first age of the first unit that occurs, in years; 0 for a newborn; null without an age."""
    found = [F.regexp_extract(c, f"(?i){p}", 1).try_cast("double") / per for p, per in AGE_UNITS]
    return F.coalesce(*found, F.when(c.rlike(r"(?i)\bnewborn\b"), F.lit(0.0)))


def sex(c: Column) -> Column:
    """F or M by the first word that tells; null without one."""
    word = F.lower(F.regexp_extract(c, r"(?i)\b(woman|female|girl|she|her|man|male|boy|he|his)\b", 1))
    return F.when(word.isin("woman", "female", "girl", "she", "her"), "F").when(word != "", "M")


#: Words for origin, and patterns of smoking and drinking in the order in which they are looked for: fixed values.
ORIGINS = r"(?i)\b(African[\s-]?American|Caucasian|Hispanic|Latino|Latina|Asian|White|Black|Native[\s-]?American|Pacific[\s-]?Islander)\b"
SMOKING = (
    ("never", r"(?i)\b(?:never\s+smok|non[\s-]?smok|nonsmoker|does\s+not\s+smoke|denies\s+(?:any\s+)?(?:tobacco|smok))"), ("former", r"(?i)\b(?:quit\s+smok|former\s+smok|stopped\s+smok|ex[\s-]?smoker)"),
    ("current", r"(?i)\b(?:smokes?\s+\d|pack[\s-]?year|packs?\s+(?:per|a)\s+day|current(?:ly)?\s+smok|active\s+smok)"),
)
DRINKING = (
    ("none", r"(?i)\b(?:does\s+not\s+(?:drink|consume)\s+alcohol|denies\s+(?:any\s+)?alcohol|no\s+alcohol|teetotal|abstinent)"),
    ("heavy", r"(?i)\b(?:heavy\s+(?:drink|alcohol)|alcohol(?:ic|ism)?|drinks?\s+\d+\s+(?:beers?|glasses?|bottles?|drinks?)\s+(?:per|a|every)\s+day|alcohol\s+(?:abuse|depend))"),
)


def origin(c: Column) -> Column:
    """The first word for an origin, as it is written; null without one."""
    return F.nullif(F.regexp_extract(c, ORIGINS, 1), F.lit(""))


def status(c: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first pattern that a text has; null without one."""
    return F.coalesce(*[F.when(c.rlike(p), name) for name, p in patterns])


def birth_year(age: Column, now: int = 2024) -> Column:
    """The year of birth at an age in whole years; null at age 0, which stands for an unknown one."""
    return F.when(age > 0, now - age)


def of_category(kind: Column, asked: str | None, categories: dict[str, tuple[str, ...]]) -> Column:
    """Whether a kind belongs to the category that is asked for; true for every row if none is asked for, or one that isn't in the list."""
    return kind.isin(*categories[asked]) if asked in categories else F.lit(True)


def answer_choices(c: Column) -> Column:
    """Choices that begin with a letter and . or ) as an array of struct<letter, text>."""
    letters = F.regexp_extract_all(c, F.lit(r"(?:^|\s)([A-H])[.)]\s"), 1)
    texts = F.filter(F.split(c, r"(?:^|\s)[A-H][.)]\s"), lambda t: F.trim(t) != "")
    return bound(texts, lambda t: F.transform(letters, lambda x, i: F.struct(x.alias("letter"), F.trim(F.get(t, F.size(t) - F.size(letters) + i)).alias("text"))))


def glob_like(c: Column, globs: list[str]) -> Column:
    """Whether the text fits one of the globs, where * stands for any run of characters and ? for one."""
    fits = [c.like(g.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")) for g in globs]
    return reduce(lambda a, b: a | b, fits, F.lit(False))


def category(code: Column) -> Column:
    """The three characters before the dot of a code."""
    return F.substring(F.upper(F.regexp_replace(code, "[. ]", "")), 1, 3)


def dotted(code: Column) -> Column:
    flat = F.upper(F.regexp_replace(code, "[. ]", ""))
    return F.when(F.length(flat) > 3, F.concat(F.substring(flat, 1, 3), F.lit("."), F.substring(flat, 4, 100))).otherwise(flat)


def name_variants(c: Column, least: int = 3) -> Column:
    """The name; without a value in brackets or after a colon; without a leading "history of"; without a trailing comma part: distinct, in this order, of at least `least` characters."""
    base = F.trim(F.lower(c))
    forms = [base, F.trim(F.regexp_replace(base, r"\s*[(\[].*[)\]]\s*$|:\s.*$", "")), F.regexp_replace(base, r"^(personal |family )?history of ", ""), F.trim(F.regexp_replace(base, r",[^,]*$", ""))]
    return F.filter(F.array_distinct(F.array(*forms)), lambda v: F.length(v) >= least)


def singular_forms(word: Column) -> Column:
    """The word and what is left of it by every ending that fits."""
    forms = [F.when((F.length(word) > 4) & word.endswith(e), F.concat(F.substr(word, F.lit(1), F.length(word) - len(e)), F.lit(r))) for e, r in PLURALS]
    return F.filter(F.array(word, *forms), lambda f: f.isNotNull())


def stem(word: Column) -> Column:
    """The shortest singular form of a word, the alphabetically first of several."""
    return F.array_min(F.transform(singular_forms(word), lambda f: F.struct(F.length(f).alias("n"), f.alias("form"))))["form"]


def written_out(c: Column, *, short: dict[str, str], slashed: dict[str, str]) -> Column:
    """The runs of ASCII letters and digits of a text in lower case, with slashed forms replaced wherever they stand, hyphens as spaces, and each word that is a short form replaced by its words (by none, if it stands for nothing)."""
    spaced = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(f" {e[1]} ")), slashed.items(), F.lower(c))
    runs = lambda x: F.regexp_extract_all(x, F.lit("([a-z0-9]+)"), 1)
    if not short:
        return runs(spaced)
    known = F.create_map(*[F.lit(x) for e in short.items() for x in e])
    return runs(F.array_join(F.transform(runs(spaced), lambda w: F.coalesce(F.try_element_at(known, w), w)), " "))


def expanded_tokens(c: Column, *, short: dict[str, str] | None = None, slashed: dict[str, str] | None = None) -> Column:
    """written_out with the given lists, or else all of shortforms."""
    return written_out(c, short=shortforms.CLINICAL | shortforms.IMAGING if short is None else short, slashed=shortforms.SLASHED if slashed is None else slashed)


def problem_lines(note: Column, header: str = "PROBLEM LIST") -> Column:
    """The distinct bullets under a header, up to the next empty line; bullets that differ only in case and marks are one."""
    block = F.regexp_extract(note, rf"(?s){header}:?\n(.*?)(?:\n\s*\n|$)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•]\s*", ""))), lambda x: x != "")
    key = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return bound(lines, lambda t: F.filter(t, lambda x, i: F.array_position(F.transform(t, key), key(x)) == i + 1))


def safe_command(c: Column, allowed: list[str]) -> Column:
    """Whether every piped part of a shell command begins with an allowed program and no word writes to a database."""
    programs = F.transform(F.split(c, r"\|+|;|&&"), lambda p: F.regexp_extract(F.trim(p), r"^(\S+)", 1))
    return (F.size(F.array_except(programs, F.array(*[F.lit(a) for a in allowed]))) == 0) & ~c.rlike(r"(?i)\b(insert|update|delete|drop|alter|create|attach)\b")


def prune_sections(sections: Column, field: str, hidden: list[str]) -> Column:
    """An array of structs without those whose field is among the hidden."""
    return F.filter(sections, lambda s: ~F.coalesce(s[field].isin(hidden), F.lit(False)))


def planned_date(months: Column) -> Column:
    """The 15th of the month so many months after January 2020."""
    return F.add_months(F.make_date(F.lit(2020), F.lit(1), F.lit(15)), months.cast("int"))
