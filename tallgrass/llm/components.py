"""Connected components of an undirected link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Returns node and root for every node of links (two columns of longs): nodes share a root exactly if a chain of links joins them.

    Each round every node takes the name of the node of smallest hash within two links of it, and the links are renamed: a star of any size is one node after a round, and as the hash changes from
    round to round, long chains shrink by a constant factor. The names of a round and its links are written to the shared checkpoint folder: nothing is gathered on the driver but a count.
    A node with very many links is first reduced by partial aggregation. Links to itself and repeated links are allowed, links with a null end are dropped.
    """
    spark = links.sparkSession
    shared_dir(spark)
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct().checkpoint()
    nodes = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        weight = lambda c, t=turn: F.xxhash64(c, F.lit(t))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min_by("b", weight("b")).alias("b"))
        near = least.select(F.col("a").alias("b"), F.when(weight("b") < weight("a"), F.col("b")).otherwise(F.col("a")).alias("m"))
        named = both.join(near, "b").groupBy("a").agg(F.min_by("m", weight("m")).alias("to")).checkpoint()  # a neighbour's least is no greater than one's own
        edges = edges.join(named.toDF("a", "ta"), "a").join(named.toDF("b", "tb"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct().checkpoint()
        nodes = nodes.join(named.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return nodes.checkpoint()
