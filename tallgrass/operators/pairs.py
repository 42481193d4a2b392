"""Pairs of items that meet in groups, and graphs of typed edges between items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh

#: Items of a feature that are sent as one list.
PIECE = 64


def capped_groups(df: DataFrame, group: str, item: str, least: int, most: int | None) -> DataFrame:
    """Distinct (group, item) rows of the groups that have between least and most items (None: least or more). The cap is part of the operator: an item that nearly all groups share tells nothing."""
    rows = df.select(group, item).distinct()
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n").between(least, F.lit(most)) if most is not None else F.col("_n") >= least).select(group)
    return rows.join(sizes, group, "left_semi")


def item_pairs(df: DataFrame, group: str, item: str, *, least: int = 2, most: int | None = 40) -> DataFrame:
    """How many groups each unordered pair of items shares: a, b (a < b), n_shared. Groups beyond `most` items are left out, so a group gives at most most^2 / 2 pairs; None leaves none out, and a group of n gives n^2 / 2."""
    rows = capped_groups(df, group, item, least, most)
    left, right = rows.select(group, F.col(item).alias("a")), rows.select(group, F.col(item).alias("b"))
    return left.join(right, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def lists_of(rows: DataFrame, feature: str, item: str, values: list[str], *, sizes: DataFrame, piece: int = PIECE, most: int | None) -> DataFrame:
    """Rows (a, values..., list of structs of item and values): each item of a feature with the feature's greater items, whole features of `piece` items or fewer in one list, larger ones in several. sizes has the features with _n, their number of items."""
    whole = most is not None and most <= piece
    about = F.struct(F.col(item).alias("a"), *values)
    dealt = rows.join(sizes, feature).withColumn("_piece", F.lit(0) if whole else F.pmod(F.xxhash64(item), F.ceil(F.col("_n") / piece)))
    each = dealt.groupBy(feature, "_piece").agg(F.sort_array(F.collect_list(about)).alias("_list"))
    own = each.select(F.posexplode("_list").alias("_i", "_x"), "_list").select("_x.*", F.slice("_list", F.col("_i") + 2, F.size("_list")).alias("_list"))
    if whole:
        return own
    other = each.select(feature, F.col("_piece").alias("_other"), F.col("_list").alias("_further"))
    met = each.join(other, feature).where("_piece <> _other").select(F.explode("_list").alias("_x"), "_further").select("_x.*", F.filter("_further", lambda y: y["a"] > F.col("_x.a")).alias("_list"))
    return own.union(met)


def weighted_overlap(df: DataFrame, item: str, feature: str, weight: Column, *, most: int | None = 40, least_score: float = 0.2) -> DataFrame:
    """Fuzzy Jaccard of items over weighted features: sum of shared minima / (sum a + sum b - sum of shared minima).

    A feature's weight for an item is its largest; features of more than `most` items don't count as shared but count in the sums (None: all count).

    An item is sent with the list of those it meets, not pair by pair, and lists are dealt by item, so that its sums are made where they arrive. A sum of minima is no greater than the other item's sum, so most pairs that can't reach
    the score are dropped before they are joined with it; the bound is loosened by negative weights, and isn't used if a weight is null or no number.
    """
    w = df.select(item, feature, weight.alias("_w")).groupBy(item, feature).agg(F.max("_w").alias("_w"))
    below = F.when(F.col("_w").isNull() | F.isnan(F.col("_w").cast("double")), float("-inf")).otherwise(F.least(F.col("_w").cast("double"), F.lit(0.0)))
    totals = w.groupBy(item).agg(F.sum("_w").alias("_t"), F.sum(below).alias("_low"))
    rare = w.where(F.col(feature).isNotNull()).groupBy(feature).agg(F.count("*").alias("_n")).where(F.col("_n").between(2, F.lit(most)) if most is not None else F.col("_n") >= 2)
    known = w.join(totals.select(item, "_t"), item)
    met = lists_of(known, feature, item, ["_w", "_t"], sizes=rare, most=most).where("size(_list) > 0")
    sent = met.select("a", "_t", "_w", F.col("_list.a").alias("b"), F.col("_list._w").alias("w")).repartition("a")
    each = sent.select("a", "_t", "_w", F.inline(F.arrays_zip("b", "w"))).groupBy("a", "b").agg(F.first("_t").alias("ta"), F.sum(F.least("_w", "w")).alias("_s"))
    if least_score > 0:
        low = totals.agg(F.min("_low").alias("_least"))
        under = F.col("ta") + F.col("_least")
        each = each.join(F.broadcast(low)).where((under <= 0) | (F.col("_s") >= (least_score * (1 - 1e-9)) * under - 1e-9) | F.isnan(F.col("_least") - F.col("_least"))).drop("_least")
    both = each.join(totals.select(F.col(item).alias("b"), F.col("_t").alias("tb")), "b")
    return both.withColumn("score", F.col("_s") / (F.col("ta") + F.col("tb") - F.col("_s"))).where(F.col("score") >= least_score).select("a", "b", "score")


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (a, b, kind): that of the best class (smallest), then of the earliest source; edges of a node to itself are dropped. edges: a, b, kind, class, source."""
    return edges.where("a <> b").groupBy("a", "b", "kind").agg(F.min(F.struct("class", "source")).alias("_e")).select("a", "b", "kind", "_e.class", "_e.source")


def prefix_matches(codes: DataFrame, code: str, rules: DataFrame, prefix: str) -> DataFrame:
    """Codes with every rule whose prefix they begin with: each code is exploded into its prefixes, and these are joined by equality."""
    part = fresh(codes, "_p", rules)
    exploded = codes.withColumn(part, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1))), lambda n: F.substring(F.col(code), F.lit(1), n))))
    return exploded.join(rules, F.col(part) == F.col(prefix)).drop(part)


def near_pairs(df: DataFrame, keys: list[str], item: str, value: str, width: float) -> DataFrame:
    """Rows (a, b), a < b: items with equal keys whose values differ by width at most. Null values are near none."""
    band = F.floor(F.col(value) / width)
    left = df.select(*keys, F.col(item).alias("a"), F.col(value).alias("_va"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    right = df.select(*keys, F.col(item).alias("b"), F.col(value).alias("_vb"), band.alias("_band"))
    return left.join(right, [*keys, "_band"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("_va") - F.col("_vb")) <= width)).select("a", "b")
