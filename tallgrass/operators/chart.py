"""What a chart shows of every patient at once: patients (patient, ...), encounters (encounter, patient, date, ...) and sections (section, encounter, kind, place, text).

Ids are unique in their tables. Encounters of no patient and sections of no encounter show nowhere. What a reader may see is a condition on the sections' kind (see access.may_read); None shows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh

#: Kinds of sections that make a resource (None: any), whether roles limit it, and the categories by which it is asked for: fixed values.
RESOURCES = {
    "DiagnosticReport": (("imaging", "pathology", "labs"), True, {"RAD": "imaging", "SP": "pathology", "LAB": "labs"}),
    "DocumentReference": (None, True, {}),
    "MedicationRequest": (("medications",), False, {}),
    "AllergyIntolerance": (("allergies",), False, {}),
}


def page(rows: DataFrame, keys: list[str], order: list, *, offset: int = 0, count: int = 10) -> DataFrame:
    """A page of each key's rows in order, with number (from 1) and total, the number of the key's rows; a key whose page is empty has no row. Null keys are one key.

    Only the first offset + count rows of a key leave a task that reads them, and the total is counted before the shuffle, so a key may have any number of rows.
    """
    kept = [c for c in rows.columns if c not in ("number", "total")]
    names = {k: fresh(rows, f"_key{i}") for i, k in enumerate(keys)}
    first = rows.select(*kept).withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("number") <= offset + count).where(F.col("number") > offset)
    totals = rows.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(F.count("*").alias("total"))
    same = F.lit(True)
    for k, n in names.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    return first.join(totals, same).select(*kept, "number", "total")


def resources(encounters: DataFrame, sections: DataFrame, resource: str, *, may: Column | None = None, category: str | None = None) -> DataFrame:
    """The sections that make a resource, with patient and date. may limits only the resources that roles limit: medications and allergies are shown to all. A category that isn't known is taken for a kind."""
    kinds, limited, categories = RESOURCES[resource]
    shown = sections if kinds is None else sections.where(F.col("kind").isin(*kinds))
    if limited and may is not None:
        shown = shown.where(may)
    if category:
        shown = shown.where(F.col("kind") == categories.get(category, category))
    dated = encounters.where("patient IS NOT NULL").select("encounter", "patient", "date")
    return dated.join(shown.select("section", "encounter", "kind", "place", "text"), "encounter")


def all_resources(encounters: DataFrame, sections: DataFrame, *, may: Column | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """The sections that make each of RESOURCES, with its name as resource, as `resources` gives them one by one (categories: by resource), but sections meet encounters once, however many resources they make."""
    asked, names = categories or {}, []
    for name, (kinds, limited, known) in RESOURCES.items():
        fits = F.lit(True) if kinds is None else F.col("kind").isin(*kinds)
        if limited and may is not None:
            fits &= may
        if category := asked.get(name):
            fits &= F.col("kind") == known.get(category, category)
        names.append(F.when(fits, F.lit(name)))
    shown = sections.withColumn("_resources", F.array_compact(F.array(*names))).where("size(_resources) > 0")
    dated = encounters.where("patient IS NOT NULL").select("encounter", "patient", "date")
    found = dated.join(shown.select("section", "encounter", "kind", "place", "text", "_resources"), "encounter")
    return found.select(F.explode("_resources").alias("resource"), *[c for c in found.columns if c != "_resources"])


def results(encounters: DataFrame, sections: DataFrame, kind: str, *, orders: DataFrame | None = None) -> DataFrame:
    """The sections of a kind with patient and date, whoever reads; with orders (encounter) also has_order, whether the encounter has one. A section counts once, however many orders there are."""
    found = encounters.where("patient IS NOT NULL").select("encounter", "patient", "date").join(sections.where(F.col("kind") == kind).select("section", "encounter", "text"), "encounter")
    if orders is None:
        return found
    return found.join(orders.select("encounter").distinct().withColumn("has_order", F.lit(True)), "encounter", "left").na.fill(False, ["has_order"])


def detail(encounters: DataFrame, sections: DataFrame, *, may: Column | None = None) -> DataFrame:
    """All encounters' columns with sections, an array of what may be read of each in order of place and id (empty if there is nothing), and n_hidden, how many sections may not be read."""
    seen = F.coalesce(may, F.lit(False)) if may is not None else F.lit(True)
    listed = sections.groupBy("encounter").agg(F.sort_array(F.collect_list(F.when(seen, F.struct("place", "section", "kind", "text")))).alias("sections"), F.count_if(~seen).alias("n_hidden"))
    base = encounters.select(*[c for c in encounters.columns if c not in ("sections", "n_hidden")])
    empty = F.array().cast(listed.schema["sections"].dataType)
    return base.join(listed, "encounter", "left").withColumns({"sections": F.coalesce("sections", empty), "n_hidden": F.coalesce("n_hidden", F.lit(0))})


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def summary(patients: DataFrame, encounters: DataFrame, sections: DataFrame, problems: DataFrame, *, may: Column | None = None, recent: int = 5, details: tuple[str, ...] = ()) -> DataFrame:
    """All patients' columns with recent (their latest encounters, newest first: structs of number, encounter, date and details), problems (their distinct problems, sorted; problems: patient, problem), and medications and allergies,
    the lines of the last such section of the latest encounter. Lists without content are empty.

    Encounters without a date are the oldest; of one date the greater id is the newer. No more than `recent` encounters of a patient leave a task that reads them.
    """
    newest = Window.partitionBy("patient").orderBy(F.desc_nulls_last("date"), F.desc("encounter"))
    top = encounters.where("patient IS NOT NULL").select("patient", "encounter", "date", *details).withColumn("number", F.row_number().over(newest)).where(F.col("number") <= recent)
    told = F.sort_array(F.collect_list(F.struct("number", "encounter", "date", *details)))
    shown = top.groupBy("patient").agg(told.alias("recent"), F.min_by("encounter", "number").alias("encounter"))
    read = sections.where(F.col("kind").isin("medications", "allergies") & (may if may is not None else F.lit(True)))
    last = read.groupBy("encounter").agg(*[F.max(F.when(F.col("kind") == k, F.struct("place", "section", "text"))).alias(k) for k in ("medications", "allergies")])
    given = shown.join(last, "encounter", "left").select("patient", "recent", *[_lines(F.col(f"{k}.text")).alias(k) for k in ("medications", "allergies")])
    listed = problems.select("patient", "problem").where("patient IS NOT NULL AND problem IS NOT NULL").distinct().groupBy("patient").agg(F.sort_array(F.collect_list("problem")).alias("problems"))
    names = ["recent", "medications", "allergies", "problems"]
    out = patients.select(*[c for c in patients.columns if c not in names]).join(given, "patient", "left").join(listed, "patient", "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(out.schema[n].dataType)) for n in names})


def observations(encounters: DataFrame, mentions: DataFrame, findings: DataFrame, *, kinds: Column | None = None) -> DataFrame:
    """Rows (patient, finding, mention and the findings' columns): each patient's distinct findings, from encounters (patient, questions: an array), mentions (mention, question, finding) and findings (finding, kind, ...). Of several
    mentions the smallest id is shown. kinds is a condition on the findings' kind."""
    asked = encounters.where("patient IS NOT NULL").select("patient", F.explode("questions").alias("question")).distinct()
    known = findings if kinds is None else findings.where(kinds)
    found = asked.join(mentions.select("mention", "question", "finding"), "question").groupBy("patient", "finding").agg(F.min("mention").alias("mention"))
    return found.join(known.select(*[c for c in known.columns if c not in ("patient", "mention")]), "finding")
