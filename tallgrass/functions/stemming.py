"""Porter's suffix stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) as column expressions; it stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Suffixes of steps 2 to 4 and what stands in their place: fixed values of the published algorithm.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# A y that is a vowel is written Y while a word is worked on. The measure of a stem is the number of its changes from vowel to consonant.
VOWEL, CONSONANT = "[aeiouY]", "[^aeiouY]"
ONE, TWO = f"^{CONSONANT}*{VOWEL}+{CONSONANT}", f"^{CONSONANT}*{VOWEL}+{CONSONANT}+{VOWEL}+{CONSONANT}"
SHORT_END = f"{CONSONANT}{VOWEL}[^aeiouYwxy]$"


def _ended(w: Column, rules: list[tuple[str, Column]], otherwise: Column) -> Column:
    """The result of the longest suffix of w that a rule has; rules hold (suffix, result)."""
    out = None
    for suffix, result in sorted(rules, key=lambda r: -len(r[0])):
        out = F.when(w.endswith(suffix), result) if out is None else out.when(w.endswith(suffix), result)
    return out.otherwise(otherwise)


def _cut(w: Column, suffix: str) -> Column:
    return F.left(w, F.length(w) - len(suffix))


def _replaced(rules: tuple, least: str):
    """A step that replaces the longest suffix of a word if what is before it has the measure; then no shorter suffix is tried."""
    return lambda w: _ended(w, [(s, F.when(_cut(w, s).rlike(least), F.concat(_cut(w, s), F.lit(r))).otherwise(w)) for s, r in rules], w)


def _plurals(w: Column) -> Column:
    return _ended(w, [("sses", _cut(w, "es")), ("ies", _cut(w, "es")), ("ss", w), ("s", _cut(w, "s"))], w)


def _restored(stem: Column) -> Column:
    """What is left of a word without -ed or -ing."""
    double = stem.rlike(rf"({CONSONANT})\1$") & ~stem.rlike("[lsz]$")
    return F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(double, _cut(stem, "x")).when(stem.rlike(ONE) & ~stem.rlike(TWO) & stem.rlike(SHORT_END), F.concat(stem, F.lit("e"))).otherwise(stem)


def _participles(w: Column) -> Column:
    bare = lambda s: F.when(_cut(w, s).rlike(VOWEL), bound(_cut(w, s), _restored)).otherwise(w)
    return _ended(w, [("eed", F.when(_cut(w, "eed").rlike(ONE), _cut(w, "d")).otherwise(w)), ("ed", bare("ed")), ("ing", bare("ing"))], w)


def _final_y(w: Column) -> Column:
    return F.when(w.rlike("[yY]$") & _cut(w, "y").rlike(VOWEL), F.concat(_cut(w, "y"), F.lit("i"))).otherwise(w)


def _dropped(w: Column) -> Column:
    rules = [(s, _cut(w, "ion" if s in ("sion", "tion") else s), _cut(w, s)) for s in STEP4]
    return _ended(w, [(s, F.when((rest if s in ("sion", "tion") else before).rlike(TWO), rest).otherwise(w)) for s, rest, before in rules], w)


def _final_e(w: Column) -> Column:
    stem = _cut(w, "e")
    return F.when(w.endswith("e") & (stem.rlike(TWO) | (stem.rlike(ONE) & ~stem.rlike(SHORT_END))), stem).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(TWO), _cut(w, "l")).otherwise(w)


def porter(word: Column) -> Column:
    """The stem of a word in lower case; words of one or two characters stay. Null stays null."""
    out = F.regexp_replace(F.regexp_replace(word, "(?<=[^aeiouy])y", "Y"), "(?<=(?:^|[aeiou])y)y", "Y")
    for step in (_plurals, _participles, _final_y, _replaced(STEP2, ONE), _replaced(STEP3, ONE), _dropped, _final_e, _final_l):
        out = bound(out, step)
    return F.when(F.length(word) <= 2, word).otherwise(F.lower(out))


def summary_words(c: Column) -> Column:
    """The runs of ASCII letters and digits of a text in lower case, those of more than three characters stemmed, as summaries are compared; a null text has none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.transform(runs, lambda w: F.when(F.length(w) > 3, porter(w)).otherwise(w))
