"""Which findings a written text names, and the scores that follow: rows hold a text and its lists of findings, so all of it is worked out within a row.

A null text is empty, a null list too; null and empty findings are left out, repeated ones count each time. A list without findings has no share, so that means pass over it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import values
from tallgrass.functions.text import bound, phrase_in, tokens

from . import containment, problems


def _filled(findings: Column) -> Column:
    """The findings of an array that say anything."""
    return F.filter(F.coalesce(findings, F.array().cast("array<string>")), lambda f: F.coalesce(F.trim(f) != "", F.lit(False)))


def named(finding: Column, text: Column, text_tokens: Column) -> Column:
    """Whether a text names a finding: it holds it as it is, or most of its tokens."""
    return F.coalesce((finding != "") & (text != "") & phrase_in(finding, text, text_tokens), F.lit(False))


def how_named(finding: Column, text: Column, text_tokens: Column) -> Column:
    """'phrase' if a text names a finding without denying every mention, else 'value' if it reports the finding's analyte in the finding's direction, else null."""
    return F.when(named(finding, text, text_tokens) & ~values.only_denied(finding, text), "phrase").when(values.value_agrees(finding, text), "value")


def share_named(findings: Column, text: Column, *, hit: Callable[[Column, Column, Column], Column] = named) -> Column:
    """The share of a list's findings that a text names; null for a list without any."""
    whole = F.coalesce(text, F.lit(""))
    count = lambda own, known: F.size(F.filter(own, lambda f: hit(f, whole, known))) / F.nullif(F.size(own), F.lit(0))
    return bound(_filled(findings), lambda own: bound(F.array_distinct(tokens(whole)), lambda known: count(own, known)))


def current_visit(rows: DataFrame, keys: list[str], *, source: str | None = None) -> DataFrame:
    """Scores of each text about one visit. rows: the keys, summary, and the lists wanted, new, resolved (that it should name), off_target and future (that it shouldn't); source names the text that it was written from.

    recall and the two deltas are shares of what should be named, off_target and future_leakage of what shouldn't, unwanted that of both lists together; ungrounded is the share of its sentences that the source doesn't support.
    """
    text = F.col("summary")
    both = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("off_target", "future")])
    lists = {"recall": F.col("wanted"), "delta_new": F.col("new"), "delta_resolved": F.col("resolved"), "off_target_rate": F.col("off_target"), "future_leakage": F.col("future"), "unwanted": both}
    loose = {"ungrounded": containment.ungrounded_rate(text, F.col(source))} if source else {}
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return rows.select(*keys, *[share_named(c, text).alias(n) for n, c in lists.items()], words.alias("n_words"), *[c.alias(n) for n, c in loose.items()])


def current_visit_means(each: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means over current_visit()'s rows, for each value of keys: 0 where no row has a share; omission_rate is 1 - recall, and selection_f1 the harmonic mean of recall and 1 - unwanted."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    shares = ["recall", "delta_new", "delta_resolved", "off_target_rate", "future_leakage", "unwanted", "n_words", *(["ungrounded"] if "ungrounded" in each.columns else [])]
    one = each.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *[mean(c) for c in shares])
    precision = 1 - F.col("unwanted")
    f1 = F.coalesce(2 * F.col("recall") * precision / F.nullif(F.col("recall") + precision, F.lit(0.0)), F.lit(0.0))
    return one.withColumns({"omission_rate": 1 - F.col("recall"), "selection_f1": f1}).drop("unwanted")


def found_in(texts: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows (item, finding, how): the distinct findings of gold (item, finding) that the item's text (texts: item, text) names, by phrase or by value, as metrics.conditioned takes them. Findings of an item with several texts may be in any."""
    # short rows that take long to judge: as many tasks as a shuffle has, which adaptive execution doesn't join into few
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = texts.select("item", F.coalesce("text", F.lit("")).alias("text")).repartition(tasks, "item").withColumn("known", F.array_distinct(tokens(F.col("text"))))
    asked = gold.select("item", "finding").where(F.trim("finding") != "").repartition(tasks, "item").distinct()
    how = how_named(F.col("finding"), F.col("text"), F.col("known"))
    # nulls are dropped after the groups are made, as a filter before would judge every row twice
    judged = asked.join(written.hint("merge"), "item").select("item", "finding", how.alias("how"))
    return judged.groupBy("item", "finding").agg(F.min("how").alias("how")).where("how IS NOT NULL")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the distinct words of two texts in lower case; 0 if either has none."""
    x, y = containment.word_set(a), containment.word_set(b)
    both = lambda x, y: F.coalesce(2.0 * F.size(F.array_intersect(x, y)) / F.nullif(F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(x) + F.size(y)), F.lit(0)), F.lit(0.0))
    return bound(x, lambda x: bound(y, lambda y: both(x, y)))


def differential_coverage(predicted: Column, reference: Column) -> Column:
    """The share of the reference's diagnoses (arrays of structs of code and name) that the prediction has: of an equal code, or of a name that holds the other or is held by it. Null for an empty reference."""
    some = lambda c: F.coalesce(c, F.lit(""))

    def same(p: Column, r: Column) -> Column:
        code, name, other = some(problems.plain(r["code"])), F.lower(some(r["name"])), F.lower(some(p["name"]))
        return ((code != "") & (code == some(problems.plain(p["code"])))) | ((name != "") & (other != "") & (F.contains(other, name) | F.contains(name, other)))

    hits = F.filter(reference, lambda r: F.coalesce(F.exists(predicted, lambda p: same(p, r)), F.lit(False)))
    return F.when(F.size(reference) > 0, F.size(hits) / F.size(reference))


def listed_recall(predicted: Column, reference: Column) -> Column:
    """The share of the reference's findings that the prediction's findings, joined by spaces, hold in whatever case; null for an empty reference."""
    said = F.lower(F.array_join(F.coalesce(predicted, F.array().cast("array<string>")), " "))
    held = lambda said, own: F.size(F.filter(own, lambda f: F.contains(said, F.lower(f)))) / F.nullif(F.size(own), F.lit(0))
    return bound(said, lambda said: bound(_filled(reference), lambda own: held(said, own)))


def imaging(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of each pre-read. rows: the keys, question and ref_question, differential and ref_differential (arrays of structs of code and name), findings and ref_findings."""
    c = F.col
    return rows.select(*keys, token_f1(c("question"), c("ref_question")).alias("question_f1"), differential_coverage(c("differential"), c("ref_differential")).alias("differential_coverage"), listed_recall(c("findings"), c("ref_findings")).alias("findings_recall"))
