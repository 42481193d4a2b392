"""Hierarchies and graphs of typed edges: ancestors, subsumption, build order and neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.tables import checkpoint_folder


def ancestors(edges: DataFrame, child: str, parent: str, *, max_depth: int | None = None) -> DataFrame:
    """All pairs (node, ancestor, depth) that chains of edges join, of any length (max_depth: of so many edges at most). Of several paths the shortest counts; cycles end.

    Paths double from round to round: the shortest path of an ancestor farther than 2^k begins with one of exactly 2^k edges, so only these are joined with what is known. A round's new pairs are written to the checkpoint folder, and
    the rounds end when no path has the full length.
    """
    checkpoint_folder(edges.sparkSession)
    known = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).where("node IS NOT NULL AND ancestor IS NOT NULL AND node <> ancestor").distinct().checkpoint()
    full, reach = known, 1
    while not full.isEmpty() and (max_depth is None or reach < max_depth):
        upper = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        longer = full.join(upper, "ancestor").select("node", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).where("node <> ancestor")
        new = longer.groupBy("node", "ancestor").agg(F.min("depth").alias("depth")).join(known, ["node", "ancestor"], "left_anti").checkpoint()
        known, reach = known.union(new), 2 * reach
        full = new.where(F.col("depth") == reach)
    return known if max_depth is None else known.where(F.col("depth") <= max_depth)


def subsumed(present: DataFrame, closure: DataFrame, item: str, *, most: int = 100) -> DataFrame:
    """Rows (ancestor, item): the present items under each ancestor; ancestors of more than `most` items tell nothing and are left out (most=None: none is)."""
    under = present.select(F.col(item).alias("node")).distinct().join(closure, "node").select("ancestor", F.col("node").alias(item)).distinct()
    if most is None:
        return under
    few = under.groupBy("ancestor").agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select("ancestor")
    return under.join(few, "ancestor", "left_semi")


def build_in_order(sources: list[DataFrame]) -> DataFrame:
    """Edges (a, b, kind) with the number of the first source, in the order given, that has them: source. Edges of a node to itself are dropped."""
    each = [s.select("a", "b", "kind", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    return reduce(lambda x, y: x.union(y), each).where("a <> b").groupBy("a", "b", "kind").agg(F.min("source").alias("source"))


def neighbours(edges: DataFrame, seeds: DataFrame, allowed: DataFrame, *, group: str) -> DataFrame:
    """Rows (group, node): nodes that an edge (a, b) joins to one of the group's seeds, and that are among the group's allowed nodes. seeds and allowed have group and node."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    found = seeds.select(group, F.col("node").alias("a")).distinct().join(both, "a").select(group, F.col("b").alias("node")).distinct()
    return found.join(allowed.select(group, "node").distinct(), [group, "node"], "left_semi")


def greedy_clusters(nodes: DataFrame, pairs: DataFrame, item: str, *, most: int = 5) -> DataFrame:
    """Rows (item, cluster). Greedy clusters: the item with the most neighbours that is still free takes its free neighbours in order of weight (ties: the smaller item), up to `most` items, and so on.

    pairs has a, b, w for every two neighbours, in both directions. An item that comes first among all free items within two links would be the next of them to choose, whatever happens elsewhere,
    so all such items choose at once, round by round: each item names the first of itself and its free neighbours, and whom all of them name chooses. Only links between free items go into the next round, with their items' ranks,
    which never change; items that no link is left to are clusters of their own at the end. Null items are left out. Rounds are written to the checkpoint folder.
    """
    checkpoint_folder(nodes.sparkSession)
    edges = pairs.where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w")).checkpoint()
    there = nodes.select(F.col(item).alias("item")).where("item IS NOT NULL").distinct().checkpoint()
    size = there.join(edges.groupBy(F.col("a").alias("item")).agg(F.count("*").alias("n")), "item")
    live = edges.join(size.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b").checkpoint()
    order = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
    rank = lambda n, i: F.struct(F.col(n).alias("n"), (-F.col(i)).alias("first"), F.col(i).alias("item"))
    done = None
    while not live.isEmpty():
        named = live.groupBy("a").agg(F.count("*").alias("n"), F.max(F.greatest(rank("na", "a"), rank("nb", "b"))).alias("best")).select("a", F.col("best.item").alias("item"), F.when(F.col("a") == F.col("best.item"), F.col("n") + 1).alias("need"))
        seeds = named.groupBy("item").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n = need").select("item")
        taken = live.join(seeds.withColumnRenamed("item", "a"), "a", "left_semi").withColumn("_k", order).where(F.col("_k") < most).select(F.col("b").alias("item"), F.col("a").alias("cluster"))
        new = seeds.select("item", F.col("item").alias("cluster")).union(taken).checkpoint()
        if new.isEmpty():
            raise ValueError("pairs must have each pair in both directions")
        done = new if done is None else done.union(new)
        live = live.join(new.select(F.col("item").alias("b")), "b", "left_anti").join(new.select(F.col("item").alias("a")), "a", "left_anti").checkpoint()
    alone = there if done is None else there.join(done.select("item"), "item", "left_anti")
    single = alone.select("item", F.col("item").alias("cluster"))
    return (single if done is None else done.union(single)).withColumnRenamed("item", item)
