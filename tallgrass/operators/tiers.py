"""Tiers of what an entity shows, by how it is linked to a field, over a sparse grid: absent pairs are sampled and never all made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.tables import checkpoint_folder

from .ordered import numbered

TIERS = ("primary", "relevant", "neutral", "excluded")

#: Rows (finding, condition) up to which an entity is worked on as a whole, in one task with others.
ENTITY_ROWS = 2_000

#: Conditions, with their fields and links, that are broadcast; with more of them both sides are shuffled.
BROADCAST_CONDITIONS = 100_000


def tiers(owners: DataFrame, home: DataFrame, gold: DataFrame, neutral: DataFrame, fields: DataFrame, *, most: int = 20, excluded: int = 15, absent: int = 2) -> DataFrame:
    """Rows (entity, field, involvement, tier, rank, finding): for each field that an entity's conditions are at home in (involved), its findings by their best tier:

    primary - the finding has an owner at home in the field; relevant - an owner that a gold link joins to one of the entity's conditions at home in it; neutral - so joined by a neutral link; excluded - none of these. Tiers hold the
    first `most` findings, the excluded one the first `excluded`, in the order of the findings. For the first `absent` fields in which the entity isn't involved (absent) all findings are excluded.

    owners has entity, finding and condition, home condition and field, gold and neutral a and b (links in both directions), fields has field. Repeated rows and rows with a null count not at all.

    Entities of at most ENTITY_ROWS rows are dealt out once, by entity, and all that is known of an entity is worked out where it lies; those of more rows are counted over ranges (_spread). The distinct rows of owners are written to the
    checkpoint folder, and no others but for those of large entities.
    """
    checkpoint_folder(owners.sparkSession)
    owned = owners.select("entity", "finding", "condition").dropna().distinct().checkpoint()
    at_home = home.select("condition", "field").dropna().distinct().join(fields.select("field").dropna().distinct(), "field", "left_semi")
    order = numbered(fields.select("field").dropna().distinct(), [], ["field"], number="k", size="all").select("k", "field")
    large = owned.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > ENTITY_ROWS).select("entity").checkpoint()
    caps = {"most": most, "excluded": excluded, "absent": absent}
    found = _together(owned.join(large, "entity", "left_anti"), at_home, gold, neutral, order, **caps)
    return found if large.isEmpty() else found.unionByName(_spread(owned.join(large, "entity", "left_semi"), at_home, gold, neutral, order, **caps))


def _named(rows: DataFrame) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(x) for x in TIERS]), F.col("tier") + 1)
    return rows.select("entity", "field", "involvement", names.alias("tier"), "rank", "finding")


def _together(owned: DataFrame, at_home: DataFrame, gold: DataFrame, neutral: DataFrame, order: DataFrame, *, most: int, excluded: int, absent: int) -> DataFrame:
    """The tiers of entities whose rows fit into a task: after one shuffle by entity each step is a window or an aggregate of the entity's rows."""
    both = [links.select("a", "b").union(links.select("b", "a")).dropna().distinct().withColumn("tier", F.lit(i)) for i, links in enumerate((gold, neutral), 1)]
    fields_of = at_home.groupBy("condition").agg(F.collect_list("field").alias("own"))
    links_of = both[0].union(both[1]).join(at_home.withColumnRenamed("condition", "b"), "b").groupBy(F.col("a").alias("condition")).agg(F.collect_list(F.struct("b", "field", "tier")).alias("linked"))
    about = fields_of.join(links_of, "condition", "full").checkpoint()
    about = F.broadcast(about) if about.count() <= BROADCAST_CONDITIONS else about
    entity = Window.partitionBy("entity")
    none = lambda name: F.coalesce(name, F.array())
    rows = owned.repartition("entity").join(about, "condition", "left").select("entity", "finding", "condition", none("own").alias("own"), none("linked").alias("linked"))
    whole = rows.withColumns({"present": F.collect_set("condition").over(entity), "involved": F.array_distinct(F.flatten(F.collect_set("own").over(entity)))})
    linked = lambda i: F.transform(F.filter("linked", lambda x: (x["tier"] == i) & F.array_contains("present", x["b"])), lambda x: x["field"])
    by_tier = whole.select("entity", "finding", "involved", F.col("own").alias("t0"), linked(1).alias("t1"), linked(2).alias("t2"))
    each = by_tier.groupBy("entity", "finding").agg(F.first("involved").alias("involved"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("t0", "t1", "t2")])
    has = lambda c: F.array_contains(c, F.col("field"))
    tiered = each.withColumn("field", F.explode("involved")).select("entity", "finding", "field", F.when(has("t0"), 0).when(has("t1"), 1).when(has("t2"), 2).otherwise(3).alias("tier"))
    rank = F.row_number().over(Window.partitionBy("entity", "field", "tier").orderBy("finding")).cast("long")
    shown = tiered.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("tier") == 3, excluded).otherwise(most)).select("entity", "field", F.lit("involved").alias("involvement"), "tier", "rank", "finding")
    # the first fields that an entity isn't involved in stand among the first n + absent of all fields, if it is involved in n
    one = each.groupBy("entity").agg(F.first("involved").alias("involved"), F.slice(F.sort_array(F.collect_list("finding")), 1, excluded).alias("findings"))
    ends = one.withColumn("end", F.least(F.lit(order.count()), F.size("involved") + absent)).where("end > 0")
    spare = ends.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "end"))).join(order, "k").where(~F.array_contains("involved", F.col("field")))
    bare = spare.withColumn("j", F.row_number().over(Window.partitionBy("entity").orderBy("k"))).where(F.col("j") <= absent).select("entity", "field", F.posexplode("findings").alias("at", "finding"))
    return _named(shown.unionByName(bare.select("entity", "field", F.lit("absent").alias("involvement"), F.lit(3).alias("tier"), (F.col("at") + 1).cast("long").alias("rank"), "finding")))


def _spread(owned: DataFrame, at_home: DataFrame, gold: DataFrame, neutral: DataFrame, order: DataFrame, *, most: int, excluded: int, absent: int) -> DataFrame:
    """The tiers of entities of any size. No grid of entities, fields and findings is made. The k-th finding that a tiered entity and field lack stands among the first k + n of the entity's findings, if n have a tier: so many places are
    made and those with a tier dropped, which are as many rows as tiers have. The numbers of an entity's findings are counted over ranges, however many it has.
    """
    present = owned.select("entity", "condition").distinct()
    involved = present.join(at_home, "condition").select("entity", "field").distinct()

    def linked(links: DataFrame) -> DataFrame:
        both = links.select("a", "b").union(links.select("b", "a")).dropna().distinct()
        other = present.join(at_home, "condition").select("entity", F.col("condition").alias("b"), "field")
        return owned.join(both, F.col("condition") == F.col("a")).select("entity", "finding", "b").distinct().join(other, ["entity", "b"]).select("entity", "field", "finding")

    own = owned.join(at_home, "condition").select("entity", "field", "finding")
    every = [d.withColumn("tier", F.lit(i)) for i, d in enumerate((own, linked(gold), linked(neutral)))]
    best = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("entity", "field", "finding").agg(F.min("tier").alias("tier"))
    places = numbered(owned.select("entity", "finding").distinct(), ["entity"], ["finding"], number="place", size="n_findings")
    held = best.join(places.select("entity", "finding", "place"), ["entity", "finding"])
    ranked = numbered(held, ["entity", "field", "tier"], ["finding"], number="rank", size="_n").where(F.col("rank") <= most).select("entity", "field", "tier", "rank", "finding")
    sizes = involved.join(held.groupBy("entity", "field").agg(F.count("*").alias("n")), ["entity", "field"], "left").join(places.groupBy("entity").agg(F.max("n_findings").alias("all")), "entity")
    room = sizes.withColumn("end", F.least("all", F.coalesce("n", F.lit(0)) + excluded)).where("end > 0").select("entity", "field", F.explode(F.sequence(F.lit(1).cast("long"), "end")).alias("place"))
    lacking = room.join(held.select("entity", "field", "place"), ["entity", "field", "place"], "left_anti")
    first = numbered(lacking, ["entity", "field"], ["place"], number="rank", size="_n").where(F.col("rank") <= excluded)
    out = first.join(places.select("entity", "place", "finding"), ["entity", "place"]).select("entity", "field", F.lit(3).alias("tier"), "rank", "finding")
    shown = ranked.unionByName(out).select("entity", "field", F.lit("involved").alias("involvement"), "tier", "rank", "finding")
    counts = present.select("entity").distinct().join(involved.groupBy("entity").agg(F.count("*").alias("n")), "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n"))
    total = order.count()
    spare = counts.withColumn("end", F.least(F.lit(total), F.col("n") + absent)).where("end > 0").select("entity", F.explode(F.sequence(F.lit(1).cast("long"), "end")).alias("k")).join(order, "k")
    missing = numbered(spare.join(involved, ["entity", "field"], "left_anti"), ["entity"], ["k"], number="j", size="_n").where(F.col("j") <= absent)
    bare = missing.select("entity", "field").join(places.where(F.col("place") <= excluded), "entity").select("entity", "field", F.lit("absent").alias("involvement"), F.lit(3).alias("tier"), F.col("place").alias("rank"), "finding")
    return _named(shown.unionByName(bare))
