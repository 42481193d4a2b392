"""How much of a set another set holds: joins by containment, grounding of sentences, omissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import bound, sentences, words
from tallgrass.sources.tables import checkpoint_folder


def word_set(c: Column) -> Column:
    """The distinct words of a text in lower case, split at white space."""
    return F.array_distinct(words(F.lower(F.coalesce(c, F.lit("")))))


def containment_join(held: DataFrame, held_id: str, holders: DataFrame, holder_id: str, items: str, *, least: float) -> DataFrame:
    """Rows (held_id, holder_id, share): every pair in which the holder has a share of at least `least` (over 0) of the other set's items. items is an array in both tables; null and repeated items count once or not at all, an empty set is held by none.

    A holder with that share of a set of n has one of any n - ceil(least n) + 1 of its items, so a set meets holders by so many of its rarest items only, by equality; frequent items are never joined on unless a set has no others.
    Pairs are then counted on the sets. Ids must be unique; both may clash with other columns, which are ignored. What holders have of the held sets' items is written to the checkpoint folder.
    """
    checkpoint_folder(holders.sparkSession)
    of = F.array_distinct(F.array_compact(items))
    small = held.select(F.col(held_id).alias("x"), of.alias("x_set")).where(F.size("x_set") > 0)
    asked = small.select("x", F.explode("x_set").alias("item"))
    # holders' sets are made once; items that no held set has are dropped where they are read, before anything is shuffled
    listed = holders.where(F.col(holder_id).isNotNull()).select(F.col(holder_id).alias("y"), F.explode(of).alias("item")).join(asked.select("item").distinct(), "item", "left_semi")
    large = listed.groupBy("y").agg(F.collect_list("item").alias("y_set")).checkpoint()
    each = large.select("y", F.explode("y_set").alias("item"))
    common = each.groupBy("item").agg(F.count("*").alias("n"))
    ranked = asked.join(common, "item", "left").groupBy("x").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item"))).alias("r"))
    first = F.size("r") - F.ceil(F.size("r") * F.lit(least) - 1e-9).cast("int") + 1
    prefix = ranked.select("x", F.explode(F.filter(F.slice("r", F.lit(1), first), lambda e: e["n"] > 0)).alias("e")).select("x", "e.item")
    likely = prefix.join(each, "item").select("x", "y").distinct()
    both = likely.join(small, "x").join(large, "y").withColumn("share", F.size(F.array_intersect("x_set", "y_set")) / F.size("x_set"))
    return both.where(F.col("share") >= F.lit(least) - 1e-9).select(F.col("x").alias(held_id), F.col("y").alias(holder_id), "share")


def ungrounded_rate(summary: Column, source: Column, *, least: float = 0.15) -> Column:
    """The share of a summary's sentences (over ten characters) of whose distinct words its source has less than `least`; 0 without sentences. Both texts stand in one row, so nothing is shuffled."""
    said = F.transform(sentences(F.coalesce(summary, F.lit(""))), word_set)
    loose = lambda own: F.size(F.filter(said, lambda s: F.size(F.array_intersect(s, own)) < F.lit(least) * F.size(s)))
    return F.when(F.size(said) > 0, bound(word_set(source), loose) / F.size(said)).otherwise(F.lit(0.0))


def omission_rates(texts: DataFrame, wanted: DataFrame, key: str, text_col: str, finding: str, *, found: Column | None = None) -> DataFrame:
    """Rows (key, n_wanted, omitted): how many distinct findings each text should name, and the share of them that it doesn't; null where it should name none.

    found, on the columns of both tables, says whether a text names a finding (default: it holds it, in whatever case). Rows of texts with one key name what any of them names; a null text names nothing.
    """
    hit = F.contains(F.lower(text_col), F.lower(finding)) if found is None else found
    both = texts.select(key, text_col).join(wanted.select(key, finding).where(F.col(finding).isNotNull()).distinct(), key)
    named = both.groupBy(key, finding).agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("_hit"))
    rates = named.groupBy(key).agg(F.count("*").alias("n_wanted"), (1 - F.avg("_hit")).alias("omitted"))
    return texts.select(key).distinct().join(rates, key, "left").select(key, F.coalesce("n_wanted", F.lit(0)).alias("n_wanted"), "omitted")
