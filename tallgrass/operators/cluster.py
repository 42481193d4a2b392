"""Clusters whose members all fit each other: range joins with widths that differ by row, contradictions, shared items and caps that follow the members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.sources.tables import checkpoint_folder

#: Contradictions: a column, and pairs of its values that can't both hold.
Contradictions = dict[str, list[tuple[str, str]]]


def fits(x: Column, y: Column, *, value: str, width: str, contradictions: Contradictions) -> Column:
    """Whether two structs fit: their values differ by the smaller of their widths at most (a null value fits any), and no contradiction holds of them."""
    near = F.coalesce(F.abs(x[value] - y[value]) <= F.least(x[width], y[width]), F.lit(True))
    for column, pairs in contradictions.items():
        for a, b in pairs:
            near &= ~F.coalesce(((x[column] == a) & (y[column] == b)) | ((x[column] == b) & (y[column] == a)), F.lit(False))
    return near


def range_pairs(df: DataFrame, keys: list[str], item: str, value: str, width: str, *, contradictions: Contradictions | None = None, shared: DataFrame | None = None, feature: str = "feature", most: int | None = None) -> DataFrame:
    """Rows (a, b), a < b: items with equal keys (null keys fit none) whose values differ by the smaller of both widths at most, without contradictions. A row with a null value fits every value; item must be unique, widths are 0 or more.

    Widths are classed by powers of two. A pair meets in bands of the smaller class: each row is dealt to the own band and both beside it in its own class, and to its band in every lower class, so that a
    wide row costs one row a class and never the whole key.

    shared (item, feature) keeps the pairs that share a feature, with n_shared, how many: then the features are part of the join, and no pair without one is made. A feature of more than `most` items in a key is left out (None: none is).
    """
    checks = contradictions or {}
    rows = df.where(F.col(item).isNotNull()).dropna(subset=keys)
    about = F.struct(*[F.col(c) for c in dict.fromkeys([value, width, *checks])]).alias("_about")
    base = rows.select(*keys, F.col(item).alias("_i"), about, F.col(f"`{value}`").cast("double").alias("_v"), F.ceil(F.log2(F.greatest(F.col(f"`{width}`").cast("double"), F.lit(1e-6)))).cast("int").alias("_class"))
    join = [*keys]
    if shared is not None:
        held = shared.select(F.col(item).alias("_i"), F.col(feature).alias("_f")).where("_f IS NOT NULL").distinct()
        base, join = base.join(held, "_i"), [*keys, "_f"]
        if most is not None:
            base = base.join(base.groupBy(*join).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(*join), join, "left_semi")
    lowest = base.agg(F.min("_class")).first()[0]
    band = F.floor(F.col("_v") / F.pow(F.lit(2.0), F.col("_band_class"))).cast("long")
    known = base.where("_v IS NOT NULL")
    left = known.withColumn("_band_class", F.col("_class")).withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    right = known.withColumn("_band_class", F.explode(F.sequence(F.lit(lowest if lowest is not None else 0), F.col("_class")))).withColumn("_band", band)
    side = lambda d, name, *more: d.select(*join, *more, F.col("_i").alias(name), F.col("_about").alias(f"{name}_about"), F.col("_class").alias(f"{name}_class"))
    met = side(left, "x", "_band_class", "_band").join(side(right, "y", "_band_class", "_band"), [*join, "_band_class", "_band"]).where("x_class < y_class OR (x_class = y_class AND x < y)")
    unknown = base.where("_v IS NULL")
    loose = side(unknown, "x").join(side(base, "y"), join).where("x <> y AND (y_about IS NOT NULL)").where(F.col(f"y_about.{value}").isNotNull() | (F.col("x") < F.col("y")))
    columns = ["x", "y", "x_about", "y_about", *(["_f"] if shared is not None else [])]
    both = met.select(*columns).union(loose.select(*columns)).where(fits(F.col("x_about"), F.col("y_about"), value=value, width=width, contradictions=checks))
    pairs = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *(["_f"] if shared is not None else []))
    return pairs if shared is None else pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def clique_clusters(nodes: DataFrame, pairs: DataFrame, item: str, *, fit: Callable[[Column, Column], Column], cap: Callable[[Column], Column]) -> DataFrame:
    """Rows (item, cluster, rank). The item with the most neighbours that is still free (ties: the smaller) begins a cluster named after it, with rank 0. Its free neighbours join in order of n_shared (descending; ties: the smaller
    item): one that fits all members so far is taken, until the cluster has cap(members) items, which is asked again whenever one was taken. Clusters of one item aren't kept.

    nodes has item (unique) and about, a struct; pairs has a, b and n_shared, each pair once. fit compares two of these structs, cap takes an array of them. An item that comes first among all free items within two links would be the
    next to begin whatever happens elsewhere, so all such items begin at once; and in each step every cluster takes its best remaining candidate, so that no list of candidates is ever gathered. All rounds are written to the
    checkpoint folder.
    """
    checkpoint_folder(nodes.sparkSession)
    both = pairs.select("a", "b", "n_shared").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_shared")).checkpoint()
    size = both.groupBy(F.col("a").alias("item")).agg(F.count("*").alias("n"))
    free = nodes.select(F.col(item).alias("item"), "about").join(size, "item").select("item", "about", F.struct("n", (-F.col("item")).alias("first")).alias("rank")).checkpoint()
    done = None
    while True:
        live = both.join(free.select(F.col("item").alias("a"), F.col("rank").alias("ra")), "a").join(free.select(F.col("item").alias("b"), F.col("rank").alias("rb"), F.col("about").alias("b_about")), "b").checkpoint()
        if live.isEmpty():
            break
        near = live.groupBy("a").agg(F.max(F.greatest("ra", "rb")).alias("best"))
        far = live.join(near.withColumnRenamed("a", "b"), "b").groupBy(F.col("a").alias("item")).agg(F.max("best").alias("best"))
        seeds = free.join(far, "item").where("best = rank").select(F.col("item").alias("cluster"), F.array(F.struct(F.col("item"), F.col("about"))).alias("members")).checkpoint()
        asked = live.select(F.col("a").alias("cluster"), F.col("b").alias("item"), F.col("b_about").alias("about"), "n_shared").join(seeds, "cluster").checkpoint()
        grown = seeds
        while True:
            open_ = asked.where((F.size("members") < cap(F.col("members.about"))) & F.forall("members.about", lambda m: fit(m, F.col("about"))))
            taken = open_.groupBy("cluster").agg(F.min(F.struct((-F.col("n_shared")).alias("order"), F.col("item"), F.col("about"))).alias("t")).checkpoint()
            if taken.isEmpty():
                break
            more = taken.select("cluster", F.array(F.struct(F.col("t.item"), F.col("t.about"))).alias("_new"))
            grown = grown.join(more, "cluster", "left").select("cluster", F.concat("members", F.coalesce("_new", F.array_except("members", "members"))).alias("members")).checkpoint()
            # what was passed over before the member that was taken didn't fit and never will, as members only grow
            asked = asked.join(taken, "cluster").where((F.struct((-F.col("n_shared")).alias("order"), F.col("item")) > F.struct("t.order", "t.item"))).select("cluster", asked["item"], asked["about"], "n_shared", F.concat("members", F.array(F.struct(F.col("t.item"), F.col("t.about")))).alias("members")).checkpoint()
        new = grown.select("cluster", F.size("members").alias("_size"), F.posexplode("members").alias("rank", "m")).select(F.col("m.item").alias("item"), "cluster", "rank", "_size").checkpoint()
        kept = new.where("_size > 1").select("item", "cluster", "rank")
        done = kept if done is None else done.union(kept)
        free = free.join(new.select("item"), "item", "left_anti").checkpoint()
    none = nodes.select(F.col(item).alias("item"), F.col(item).alias("cluster"), F.lit(0).alias("rank")).limit(0)
    return (none if done is None else done).withColumnRenamed("item", item)


def faults(clusters: DataFrame, nodes: DataFrame, pairs: DataFrame, item: str, *, fit: Callable[[Column, Column], Column]) -> DataFrame:
    """One row of counts that are 0 for right clusters: n_repeated items in two places, n_unfit pairs of members that don't fit, n_unlinked members that no pair links to their cluster's first one, n_single clusters of one item."""
    about = nodes.select(F.col(item).alias("_i"), "about")
    members = clusters.join(about, F.col(item) == F.col("_i")).select(F.col(item).alias("i"), "cluster", "rank", "about")
    lists = members.groupBy("cluster").agg(F.collect_list("about").alias("all"), F.count("*").alias("n"))
    each = members.join(lists, "cluster").select(F.size(F.filter("all", lambda m: ~fit(F.col("about"), m))).alias("k"), "n")
    link = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    loose = members.where("rank > 0").join(link.toDF("i", "cluster"), ["i", "cluster"], "left_anti")
    twice = members.groupBy("i").agg(F.count("*").alias("c")).where("c > 1")
    sums = each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_unfit"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(twice, "n_repeated").join(sums).join(count(loose, "n_unlinked")).join(count(lists.where("n < 2"), "n_single"))
