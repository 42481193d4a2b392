"""Interval labels of a hierarchy: pre- and post-order numbers, so that "is below" is a comparison of ranges at any depth.

Every node has one tree parent, its smallest; the tour around these trees is a linked list of entries and exits, whose places are found by doubling pointers, in about log2(2 n) rounds of joins. Only nodes with children and roots are in
that list: a node's leaves come right after its entry. Further parents are links: what lies below the child of a link lies below the link's parent too, so such a parent gets the child's interval besides its own.

Tables of nodes are joined by sorting (hint merge): such rows take little room in files and shuffles, so that Spark would broadcast millions of them and fill the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.tables import checkpoint_folder

#: Hash buckets of one parent's children, so that no parent's children meet in one task.
BUCKETS = 64

#: Blocks of ranges that are broadcast; more of them are joined by sorting.
BROADCAST_BLOCKS = 20_000


class Hierarchy:
    """Labels of the nodes of a table of edges (child, parent).

    nodes has node, low and high: x lies in the tree below y exactly if low(y) < low(x) < high(y). links has, for each further parent, the interval (low, high) of its child and the place `at` of the parent, and for
    chains of links what follows from them. Edges with a null end or of a node to itself are dropped, repeated ones count once; a cycle raises an error.
    """

    def __init__(self, edges: DataFrame, child: str, parent: str):
        checkpoint_folder(edges.sparkSession)
        given = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").distinct().checkpoint()
        tree = given.groupBy("child").agg(F.min("parent").alias("parent")).checkpoint()
        self.nodes = _toured(tree, given)
        further = given.join(tree.hint("merge"), ["child", "parent"], "left_anti")
        place = lambda name: self.nodes.select(F.col("node").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
        direct = further.join(place("child").hint("merge"), "child").join(place("parent").hint("merge"), "parent").select(F.col("child_low").alias("low"), F.col("child_high").alias("high"), F.col("parent_low").alias("at"))
        self.links = _chained(direct.distinct().checkpoint())
        if not self.links.where("low <= at AND at < high").isEmpty():
            raise ValueError("the hierarchy has a cycle")

    def label(self, df: DataFrame, column: str, low: str, high: str) -> DataFrame:
        """df with the interval of the node in a column, null if it isn't in the hierarchy."""
        return df.join(self.nodes.select(F.col("node").alias(column), F.col("low").alias(low), F.col("high").alias(high)).hint("merge"), column, "left")

    def below(self, pairs: DataFrame, node: str, ancestor: str, out: str = "below") -> DataFrame:
        """pairs with the boolean out: whether node lies below ancestor, at any depth and by any parents. A node isn't below itself; one that the hierarchy doesn't have is below none."""
        both = self.label(self.label(pairs.select(node, ancestor).distinct(), node, "_x", "_xh"), ancestor, "_y", "_z")
        known = both.select(node, ancestor, "_x", "_y", "_z", ((F.col("_y") < F.col("_x")) & (F.col("_x") < F.col("_z"))).alias("_tree"))
        open_ = known.where("NOT _tree")
        # a node that isn't below in the tree has to enter by a link whose child's interval holds it
        entered = stabbed(self.links, "low", "high", open_, "_x").where((F.col("at") >= F.col("_y")) & (F.col("at") < F.col("_z"))).select(node, ancestor).distinct()
        found = known.where("_tree").select(node, ancestor).union(entered).withColumn(out, F.lit(True))
        same = pairs.join(found.withColumnsRenamed({node: "_a", ancestor: "_b"}).hint("merge"), F.col(node).eqNullSafe(F.col("_a")) & F.col(ancestor).eqNullSafe(F.col("_b")), "left")
        return same.withColumn(out, F.coalesce(out, F.lit(False))).drop("_a", "_b")

    def under(self, items: DataFrame, item: str, tops: DataFrame, top: str) -> DataFrame:
        """Rows (top, item): the distinct items that lie below each of the distinct tops."""
        x = self.label(items.select(item).where(F.col(item).isNotNull()).distinct(), item, "_x", "_xh").where("_x IS NOT NULL").select(item, "_x")
        y = self.label(tops.select(top).where(F.col(top).isNotNull()).distinct(), top, "_y", "_z").where("_y IS NOT NULL").select(top, "_y", "_z").checkpoint()
        own = stabbed(y, "_y", "_z", x, "_x").where("_x > _y").select(top, item)
        through = stabbed(y, "_y", "_z", self.links.select("at").distinct(), "at").select(top, "at")
        held = self.links.select("at", F.col("low").alias("_low"), F.col("high").alias("_high")).join(through.hint("merge"), "at").select(top, "_low", "_high").distinct().checkpoint()
        return own.union(stabbed(held, "_low", "_high", x, "_x").select(top, item)).distinct()


def _toured(tree: DataFrame, given: DataFrame) -> DataFrame:
    """Rows (node, low, high): the places at which the tour around the trees enters and leaves each node."""
    nodes = given.select(F.col("child").alias("node")).union(given.select("parent")).distinct()
    families = tree.select(F.col("parent").alias("node")).distinct().withColumn("family", F.lit(True))
    known = nodes.join(tree.withColumnRenamed("child", "node").hint("merge"), "node", "left").join(families.hint("merge"), "node", "left")
    known = known.select("node", "parent", (F.col("family").isNotNull() | F.col("parent").isNull()).alias("inner")).checkpoint()
    # leaves by their numbers among a parent's: within hash buckets by id, and the buckets in a row
    leaves = known.where("NOT inner").select("node", "parent", F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).alias("bucket"))
    counted = leaves.groupBy("parent", "bucket").agg(F.count("*").alias("n"))
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("parent").orderBy("bucket")) - F.col("n")).select("parent", "bucket", "before")
    numbered = leaves.withColumn("k", F.row_number().over(Window.partitionBy("parent", "bucket").orderBy("node"))).join(before.hint("merge"), ["parent", "bucket"])
    inside = counted.groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n_leaves"))
    # other children in an arbitrary order, likewise
    parents = known.where("inner").select("node", "parent", F.col("parent").isNull().alias("root"), F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).alias("bucket")).join(inside.hint("merge"), "node", "left").na.fill(0, ["n_leaves"]).checkpoint()
    within = Window.partitionBy("root", "parent", "bucket").orderBy("node")
    placed = parents.withColumn("next", F.lead("node").over(within)).withColumn("k", F.row_number().over(within))
    first = placed.where("k = 1").select("root", "parent", "bucket", F.col("node").alias("first"))
    over = Window.partitionBy("root", "parent").orderBy("bucket")
    heads = first.withColumn("after", F.lead("first").over(over)).withColumn("j", F.row_number().over(over))
    turn = heads.select(F.col("root").alias("_r"), F.col("parent").alias("_p"), F.col("bucket").alias("_b"), "after").hint("merge")
    sibling = placed.join(turn, (F.col("root") == F.col("_r")) & F.col("parent").eqNullSafe(F.col("_p")) & (F.col("bucket") == F.col("_b")), "left").select("node", "parent", F.coalesce("next", "after").alias("next"))
    oldest = heads.where("j = 1 AND NOT root").select(F.col("parent").alias("node"), F.col("first").alias("down")).hint("merge")
    # events: entry (0) and exit (1) of a node, each with the event after it and the places until there: an entry's leaves take two each
    event = lambda node, side: F.struct(node.alias("node"), F.lit(side).alias("side"))
    entry = parents.join(oldest, "node", "left").select(event(F.col("node"), 0).alias("e"), F.when(F.col("down").isNotNull(), event(F.col("down"), 0)).otherwise(event(F.col("node"), 1)).alias("to"), (1 + 2 * F.col("n_leaves")).alias("far"))
    leave = sibling.select(event(F.col("node"), 1).alias("e"), F.when(F.col("next").isNotNull(), event(F.col("next"), 0)).when(F.col("parent").isNotNull(), event(F.col("parent"), 1)).alias("to"), F.lit(1).cast("long").alias("far"))
    ranked = entry.union(leave).withColumn("far", F.when(F.col("to").isNull(), 0).otherwise(F.col("far")).cast("long")).checkpoint()
    events, places = ranked.count(), 2 * known.count()
    hops = 1
    while not ranked.where("to IS NOT NULL").isEmpty():
        if hops > 2 * max(1, events):
            raise ValueError("the hierarchy has a cycle")
        ahead = ranked.select(F.col("e").alias("to"), F.col("to").alias("then"), F.col("far").alias("more")).hint("merge")
        ranked = ranked.join(ahead, "to", "left").select("e", F.col("then").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")).checkpoint()
        hops *= 2
    place = F.lit(places) - F.col("far")
    sides = ranked.groupBy(F.col("e.node").alias("node")).agg(F.min(F.when(F.col("e.side") == 0, place)).alias("low"), F.max(F.when(F.col("e.side") == 1, place)).alias("high")).checkpoint()
    low = F.col("low") + 2 * (F.col("before") + F.col("k")) - 1
    ends = numbered.join(sides.select(F.col("node").alias("parent"), "low").hint("merge"), "parent").select("node", low.alias("low"), (low + 1).alias("high"))
    return sides.union(ends).checkpoint()


def _chained(links: DataFrame) -> DataFrame:
    """links (low, high, at) with those that chains of them make: what is below one link's child, whose parent lies in another link's interval, is below that one's parent too."""
    known = new = links
    while not new.isEmpty():
        step = stabbed(links.select(F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("at").alias("_at")), "_low", "_high", new.select("at").distinct(), "at").select("at", "_at").distinct()
        further = new.join(step.hint("merge"), "at").select("low", "high", F.col("_at").alias("at")).distinct()
        new = further.join(known.hint("merge"), ["low", "high", "at"], "left_anti").checkpoint()
        known = known.union(new)
    return known


def stabbed(ranges: DataFrame, low: str, high: str, points: DataFrame, at: str) -> DataFrame:
    """ranges joined with the points of theirs, low <= at < high, all of which are not negative whole numbers below 2^48.

    A range is the union of at most two aligned blocks of each size 2^k, and a point lies in one block of each size: both are joined by equality of blocks, so that work grows with the rows and the result, however long the ranges are. ranges are read twice, the points' largest is found first; points are dealt into blocks of those sizes alone that ranges have.
    """
    size = F.col("_k")
    most = points.agg(F.max(at)).first()[0]
    levels = max(1, (int(most) + 1).bit_length()) if most is not None else 1
    unit = F.pow(F.lit(2.0), size).cast("long")
    up, down = F.ceil(F.col(low) / unit).cast("long"), F.floor(F.least(F.col(high), F.lit(1 << levels)) / unit).cast("long")  # whole blocks of this size: up <= block < down
    up2, down2 = F.ceil(F.col(low) / (2 * unit)).cast("long"), F.floor(F.least(F.col(high), F.lit(1 << levels)) / (2 * unit)).cast("long")
    inner = up2 < down2  # some of them are halves of whole blocks of the next size
    edge = F.filter(
        F.array(F.when((up < down) & (~inner | (up < 2 * up2)), up), F.when((up < down) & ((~inner & (down - 1 > up)) | (inner & (down > 2 * down2))), down - 1)), lambda b: b.isNotNull()
    )
    longest = F.least(F.lit(levels), F.floor(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(1)))).cast("int") + 1)
    cut = ranges.withColumn("_k", F.explode(F.sequence(F.lit(0), longest))).withColumn("_block", F.explode(edge))
    sizes = {r["_k"]: r["n"] for r in cut.groupBy("_k").agg(F.count("*").alias("n")).collect()}
    marked = points.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in sorted(sizes) or [0]]))).withColumn("_block", F.floor(F.col(at) / unit).cast("long"))
    blocks = F.broadcast(cut) if sum(sizes.values()) <= BROADCAST_BLOCKS else cut.hint("merge")
    return blocks.join(marked, ["_k", "_block"]).drop("_k", "_block")
