"""Column functions that mend, fill and clean clinical notes. All of them stay inside the JVM; null texts count as empty unless stated. `\\s` is ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Patterns of the source's notes: fixed values.
PMH_VERBS = (
    r"\b(?:is|are|was|were|has|have|had|does|do|did|reports?|denies|includes?|included|notes?|notable|significant|presents?|underwent|received|takes?|took|remains?|reveals?|shows?|carries|complains?|"
    r"endorses?|describes?|states?|admits?|suffers?|developed|diagnosed|treated|managed|hospitalized|follows?)\b"
)
PMH_DENIALS = (
    r"\bno (?:past )?(?:medical )?history\b|\bno (?:known )?(?:chronic )?(?:medical )?(?:conditions|comorbidities|problems)\b|\bdenies any (?:past )?(?:medical )?history\b|"
    r"\bunremarkable (?:past )?medical history\b|\b(?:past )?medical history is unremarkable\b|\bno significant (?:past )?medical history\b"
)
ORPHAN_VERBS = (
    r"is|are|was|were|has|have|had|does|do|did|presents?|reports?|denies|complains?|underwent|received|takes?|took|returns?|comes?|came|arrives?|states?|notes?|admits?|endorses?|"
    r"describes?|reveals?|shows?|demonstrates?"
)
ORPHAN_LEADINS = r"over|during|after|before|for|in|on|at|with|without|since|about|approximately|following|prior"
MED_DENIALS = (
    r"(?:and |but )?(?:s?he |the patient |patient )?(?:currently )?(?:is )?(?:takes?|taking|on|receiving|uses?)? ?no (?:home |regular |daily |scheduled |current |prescription |chronic )?"
    r"medications?\b[^.]*\.?|(?:s?he |the patient )?(?:denies|reports) (?:any |taking )?(?:current |home )?medications?\b[^.]*\.?|"
    r"\bnot (?:currently )?(?:taking|on) any (?:medications?|meds)\b[^.]*\.?|\bno known medications?\b[^.]*\.?"
)
CONJUNCTIONS = r"and|but|or|so|yet|then|also"
CLAUSE_BOUND = r",\s+(?:and|but)\s+|\s+(?:and|but)\s+(?=(?:s?he|the patient|her|his)\b)"
PROBLEMS, HOME_MEDS = "Active Problem List:", "Home Medications:"
#: A lead-in of so many characters or more is a sentence of its own.
LEADIN = 70


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentences(c: Column) -> Column:
    """Pieces that end with a full stop, an exclamation or a question mark and white space."""
    return F.split(c, r"(?<=[.!?])\s+")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def ended(c: Column, marks: str = ".!?") -> Column:
    """With a full stop, unless the text ends with one of the marks."""
    return F.when(c.rlike(f"[{marks}]$"), c).otherwise(F.concat(c, F.lit(".")))


def opening(c: Column) -> Column:
    """Without the conjunctions that lead it."""
    return F.regexp_replace(c, rf"(?i)^(?:(?:{CONJUNCTIONS})\s+)+", "")


def _lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def _parted(c: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first mark, and after it."""
    head = F.substring_index(c, mark, 1)
    return head, F.substr(c, F.length(head) + len(mark) + 1)


def tidy(c: Column) -> Column:
    """No blanks before a line end, no more than one empty line in a row, none at the ends."""
    return stripped(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def reconciled_medications(c: Column) -> Column:
    """Drops a claim of no medications that stands before a list of home medications with at least one bullet; the rest of the section stays."""

    def mend(x: Column) -> Column:
        head, tail = _parted(x, HOME_MEDS)
        claim = x.contains(HOME_MEDS) & tail.rlike(r"(?m)^\s*[-*]\s*\S") & head.rlike(f"(?i){MED_DENIALS}")
        rest = head
        for pattern, put in ((f"(?i){MED_DENIALS}", ""), (r"\s{2,}", " "), (r"\s+([.,;])", "$1"), (r"(?i)(?:^|(?<=\.))\s*(?:and|but)\s+", " "), (r"\.\s*\.", ".")):
            rest = F.regexp_replace(rest, pattern, put)
        rest = F.regexp_replace(stripped(rest), r"^[.,;]$", "")
        kept = F.when(rest == "", "").otherwise(F.concat(capitalised(ended(rest, ".!?:")), F.lit("\n\n")))
        return F.when(claim, stripped(F.concat(kept, F.lit(HOME_MEDS), tail))).otherwise(x)

    return bound(F.coalesce(c, F.lit("")), mend)


def without_denials(sentence: Column) -> Column:
    """A sentence without the clauses that claim no history; empty if nothing is left."""
    clauses = F.filter(F.transform(F.split(sentence, f"(?i){CLAUSE_BOUND}"), lambda x: F.trim(x, F.lit(" ,;"))), lambda x: (x != "") & ~x.rlike(f"(?i){PMH_DENIALS}"))
    return bound(F.array_join(clauses, ", and "), lambda x: F.when(x == "", "").otherwise(ended(capitalised(x))))


def cleaned_history(c: Column) -> Column:
    """Of what follows the last bullet of a problem list only whole sentences with a verb stay, without claims of no history. Texts without such a list stay as they are."""

    def mend(x: Column) -> Column:
        lines = F.split(x, "\n")
        bullets = F.filter(F.transform(lines, lambda s, i: F.when(F.startswith(F.ltrim(s), F.lit("-")), i)), lambda i: i.isNotNull())
        last = F.array_max(bullets)
        head = stripped(F.array_join(F.slice(lines, F.lit(1), F.coalesce(last, F.lit(0)) + 1), "\n"))
        tail = stripped(F.array_join(F.slice(lines, F.coalesce(last, F.lit(0)) + 2, F.size(lines)), "\n"))
        whole = F.filter(F.transform(sentences(tail), stripped), lambda s: (s != "") & ~_lower(s) & s.rlike(f"(?i){PMH_VERBS}"))
        kept = F.filter(F.transform(whole, lambda s: F.when(s.rlike(f"(?i){PMH_DENIALS}"), without_denials(s)).otherwise(ended(s))), lambda s: s != "")
        body = F.when(F.size(kept) > 0, F.concat(head, F.lit("\n\n"), F.array_join(kept, " "))).otherwise(head)
        return F.when(x.contains(PROBLEMS) & last.isNotNull(), body).otherwise(x)

    return bound(F.coalesce(c, F.lit("")), mend)


def repaired_fragment(c: Column, sex: Column, *, medications: bool = False) -> Column:
    """A text that begins in the middle of a sentence gets its subject back: He for sex M, else She.

    Leading conjunctions go, and so do leading sentences that are but a short lead-in ("over the past months."), unless one is all there is. Then a leading verb gets the subject, any other word a capital.
    Of a medications section only what stands before the home medications is mended, and a missing verb is added. Texts that begin otherwise stay, without white space at the ends.
    """
    subject = F.when(sex == "M", "He").otherwise("She")

    def dead(s: Column) -> Column:
        o = opening(s)
        return _lower(s) & o.rlike(rf"^(?:{ORPHAN_LEADINS})\b") & (F.length(o) < LEADIN)

    def plain(t: Column) -> Column:
        parts = sentences(t)
        skip = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & dead(x)).cast("int")).alias("n"), (s["on"] & dead(x)).alias("on")))["n"]
        rest = F.when(skip > 0, F.array_join(F.slice(parts, skip + 1, F.size(parts)), " ")).otherwise(t)
        return bound(rest, lambda r: F.when(~_lower(r), r).otherwise(bound(opening(r), lambda o: F.when(o.rlike(rf"^(?:{ORPHAN_VERBS})\b"), F.concat(subject, F.lit(" "), o)).otherwise(capitalised(o)))))

    def listed(t: Column) -> Column:
        head, tail = _parted(t, HOME_MEDS)
        said = bound(opening(stripped(head)), lambda h: F.when(~_lower(h), h).otherwise(ended(F.concat(subject, F.when(h.rlike(rf"^(?:{ORPHAN_VERBS})\b"), " ").otherwise(" takes "), h))))
        return stripped(F.concat(said, F.lit(f"\n\n{HOME_MEDS}"), tail))

    def mend(t: Column) -> Column:
        body = F.when(t.contains(HOME_MEDS), listed(t)).otherwise(plain(t)) if medications else plain(t)
        return F.when(_lower(t), body).otherwise(t)

    return bound(stripped(F.coalesce(c, F.lit(""))), mend)


def cumulative_history(source: Column, prior: Column, chronic: Column) -> Column:
    """The history under a list of prior diagnoses (array of struct<name, date>) and chronic conditions (array of strings), each name once (case aside); the source alone without any."""
    items = F.concat(
        F.transform(F.coalesce(prior, F.array().cast("array<struct<name:string,date:string>>")), lambda p: F.struct(F.lower(p["name"]).alias("k"), F.concat(F.lit("- "), p["name"], F.lit(" (diagnosed "), p["date"].cast("string"), F.lit(")")).alias("line"))),
        F.transform(F.coalesce(chronic, F.array().cast("array<string>")), lambda x: F.struct(F.lower(x).alias("k"), F.concat(F.lit("- "), x).alias("line"))),
    )
    first = lambda t: F.transform(F.filter(t, lambda x, i: F.array_position(F.transform(t, lambda y: y["k"]), x["k"]) == i + 1), lambda x: x["line"])
    text = F.coalesce(source, F.lit(""))
    return bound(bound(items, first), lambda lines: F.when(F.size(lines) == 0, text).otherwise(F.concat(F.lit(f"{PROBLEMS}\n"), F.array_join(lines, "\n"), F.lit("\n"), F.when(text == "", "").otherwise(F.concat(F.lit("\n"), text)))))


def merged_medications(source: Column, meds: Column) -> Column:
    """The section with the home medications (array of struct<name, dose>) that it doesn't name yet under a header of their own."""
    text = F.coalesce(source, F.lit(""))
    new = F.filter(F.coalesce(meds, F.array().cast("array<struct<name:string,dose:string>>")), lambda m: (F.coalesce(m["name"], F.lit("")) != "") & ~F.contains(F.lower(text), F.lower(m["name"])))
    lines = F.transform(new, lambda m: F.trim(F.concat(F.lit("- "), m["name"], F.lit(" "), F.coalesce(m["dose"], F.lit("")))))
    return bound(lines, lambda x: F.when(F.size(x) == 0, text).otherwise(F.concat(F.when(text == "", "").otherwise(F.concat(text, F.lit("\n"))), F.lit(f"\n{HOME_MEDS}\n"), F.array_join(x, "\n"))))


def social_history(source: Column, smoking: Column, alcohol: Column, occupation: Column) -> Column:
    """The section, or where it is empty what a profile says; null if it says nothing."""
    said = [F.when(c != "", F.concat(F.lit(f"{name}: "), c)) for name, c in (("Smoking", smoking), ("Alcohol", alcohol), ("Occupation", occupation))]
    filled = F.concat(F.nullif(F.concat_ws(". ", *said), F.lit("")), F.lit("."))
    return F.coalesce(F.nullif(source, F.lit("")), filled)


def allergies(source: Column, items: Column) -> Column:
    """The section, or where it is empty a profile's allergies, or that none are known."""
    listed = F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(items, ", ")).otherwise("No known drug allergies (NKDA)")
    return F.coalesce(F.nullif(source, F.lit("")), listed)


def aged(c: Column, age: Column, months: Column) -> Column:
    """The text with its first age in years replaced by the age so many months later; as it is for zero or fewer months and without an age."""
    later = (age + F.floor(months / 12)).cast("string")
    number = F.regexp_instr(c, F.lit(r"(?i)\d+[- ]?(?:years?|y/?o)\b"))
    digits = F.regexp_extract(F.substr(c, number), r"^\d+", 0)
    return F.when((months > 0) & age.isNotNull() & (number > 0), F.concat(F.substr(c, F.lit(1), number - 1), later, F.substr(c, number + F.length(digits)))).otherwise(c)


def without_lines(c: Column, dropped: list[str], kept: list[str] = ()) -> Column:
    """Without the lines whose trimmed text fits one of the patterns to drop as a whole, unless it is one of the kept."""
    fits = "|".join(f"(?:{p})" for p in dropped)
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: F.trim(x).isin(list(kept)) | ~F.trim(x).rlike(rf"^(?:{fits})$")), "\n")
