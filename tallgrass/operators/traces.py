"""How traces of actions went: rows (item, order columns, kind, name, encounter, section, args, output_length), one for each entry of an item's trace.

Entries of the kinds in ACTIONS are actions; others (messages, submissions) only take a place in the order. The order columns must tell the entries of a trace apart. Rows of a null item are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

ACTIONS = ("tool", "command")
#: The names of actions that look over a chart, and of those that ask for one thing.
OVERVIEW, SPECIFIC = ("open_chart", "view_encounters"), ("view_encounter_detail", "view_section")
#: The order in which a chart's sections are usually read: fixed values.
USUAL_ORDER = (
    "demographics", "chief_complaint", "hpi", "pmh", "psh", "medications", "allergies", "family_history", "social_history", "ros", "vitals", "physical_exam", "labs", "imaging", "pathology",
    "other_studies", "assessment", "plan",
)


def _actions(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("item").isNotNull() & F.col("kind").isin(*ACTIONS))


def efficiency(runs: DataFrame, keys: list[str], *, budget: int = 40) -> DataFrame:
    """For each value of the keys: mean and median number of turns, share of submitted runs, mean share of the budget used, mean tokens and mean milliseconds.

    runs: the keys, turns, submitted, budget (null: the default), tokens_in, tokens_out, latency_ms. A run that doesn't say that it was submitted wasn't; null numbers count in no mean, null tokens as none; a budget of 0 has no share.
    """
    limit = F.coalesce("budget", F.lit(budget))
    tokens = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("turns").alias("mean_actions"), F.median("turns").alias("median_actions"), F.avg(F.coalesce(F.col("submitted"), F.lit(False)).cast("double")).alias("submission_rate"),
        F.avg(F.col("turns") / F.nullif(limit, F.lit(0))).alias("budget_use"), F.avg(tokens).alias("mean_tokens"), F.avg("latency_ms").alias("mean_ms"),
    )


def gathering(steps: DataFrame) -> DataFrame:
    """A row for each item that has entries: n_actions, the distinct sections it read (encounter and section known), and the shares of actions without output and of repeated ones (null without actions).

    An action repeats twice if both its section and its arguments came before, so that a share may be above 1. All of it is counted, without an order: what isn't the first of its kind is a repeat.
    """
    place = F.when(F.col("encounter").isNotNull() & F.col("section").isNotNull(), F.struct("encounter", "section"))
    acts = _actions(steps).select("item", place.alias("place"), F.coalesce("args", F.lit("")).alias("args"), (F.coalesce("output_length", F.lit(0)) == 0).alias("failed"))
    counted = acts.groupBy("item").agg(F.count("*").alias("n_actions"), F.count("place").alias("n_places"), F.count_if("failed").alias("n_failed"))
    # Distinct values are counted after they have been made distinct, so that the entries of one long trace are spread over tasks.
    places = acts.where("place IS NOT NULL").select("item", "place").distinct().groupBy("item").agg(F.count("*").alias("n_sections"))
    args = acts.select("item", "args").distinct().groupBy("item").agg(F.count("*").alias("n_args"))
    every = steps.where("item IS NOT NULL").select("item").distinct()
    rows = every.join(counted, "item", "left").join(places, "item", "left").join(args, "item", "left").na.fill(0, ["n_actions", "n_places", "n_failed", "n_sections", "n_args"])
    share = lambda c: c / F.nullif(F.col("n_actions"), F.lit(0))
    repeats = F.col("n_places") - F.col("n_sections") + F.col("n_actions") - F.col("n_args")
    return rows.select("item", "n_actions", "n_sections", share(F.col("n_failed")).alias("failure_rate"), share(repeats).alias("repeat_rate"))


def order_agreement(ranked: DataFrame, order: list[str]) -> DataFrame:
    """Kendall's tau-b between the ranks of an item's rows (item, rank, order columns), in order, and the same ranks sorted: rows (item, tau), of items with two different ranks at least.

    Places are numbered over ranges, and the rank that the sorted list has at a place follows from how often each rank occurs, so no two rows meet: what an item's task holds is a row for each two ranks that share a place. Ranks are those of a short list, so these are few; NULL ranks are left out.
    """
    rows = numbered(ranked.where(F.col("item").isNotNull() & F.col("rank").isNotNull()).select("item", "rank", *order), ["item"], order, number="_place", size="_size")
    counts = ranked.where("item IS NOT NULL AND rank IS NOT NULL").groupBy("item", "rank").agg(F.count("*").alias("n")).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("ranks"))
    upto = F.aggregate("ranks", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(ranked.schema["rank"].dataType).alias("rank")),
                       lambda a, r: F.when(a["seen"] < F.col("_place"), F.struct((a["seen"] + r["n"]).alias("seen"), r["rank"].alias("rank"))).otherwise(a))
    cells = rows.join(counts, "item").select("item", F.col("rank").alias("x"), upto["rank"].alias("y")).groupBy("item", "x", "y").agg(F.count("*").alias("n"))
    sign = lambda c, d: F.when(c["y"] > d["y"], F.signum((c["x"] - d["x"]).cast("double"))).otherwise(0.0)
    listed = cells.groupBy("item").agg(F.collect_list(F.struct("x", "y", "n")).alias("c"))
    balance = F.aggregate("c", F.lit(0.0), lambda a, c: a + c["n"] * F.aggregate("c", F.lit(0.0), lambda b, d: b + sign(c, d) * d["n"]))
    ties = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + r["n"] * (r["n"] - 1) / 2)
    size = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + r["n"])
    return listed.join(counts, "item").where(F.size("ranks") >= 2).select("item", (balance / (size * (size - 1) / 2 - ties)).alias("tau"))


def _first_kind(kind: Column, name: Column) -> Column:
    return F.when(kind.isin(*ACTIONS), F.when(name.isin(*OVERVIEW), "overview").when(name.isin(*SPECIFIC), "specific").otherwise("other"))


def workflow(steps: DataFrame, order: list[str], *, sections: tuple[str, ...] = USUAL_ORDER) -> DataFrame:
    """A row for each item that has entries: tau of the order in which its sections are read against the usual order (others are passed over), breadth_depth, the encounters that it reads divided by how
    often it reads that which it reads most (null without encounters), and first, the kind of its first entry (overview, specific, other; null if that is no action)."""
    acts = _actions(steps)
    rank = F.nullif(F.array_position(F.lit(list(sections)), F.col("section")), F.lit(0))
    tau = order_agreement(acts.select("item", rank.alias("rank"), *order), order)
    reads = acts.where(F.col("encounter").isNotNull()).groupBy("item", "encounter").agg(F.count("*").alias("n")).groupBy("item").agg((F.count("*") / F.max("n")).alias("breadth_depth"))
    first = steps.where("item IS NOT NULL").groupBy("item").agg(F.min_by(F.struct("kind", "name"), F.struct(*order)).alias("f")).select("item", _first_kind(F.col("f.kind"), F.col("f.name")).alias("first"))
    return first.join(tau, "item", "left").join(reads, "item", "left").select("item", "tau", "breadth_depth", "first")


def workflow_means(each: DataFrame) -> DataFrame:
    """One row over workflow()'s rows: mean tau and mean breadth_depth of the items that have one, and the share of each kind among first actions (0 without any)."""
    n = F.greatest(F.count("first"), F.lit(1))
    return each.agg(F.avg("tau").alias("tau"), F.avg("breadth_depth").alias("breadth_depth"), *[(F.count_if(F.col("first") == k) / n).alias(k) for k in ("overview", "specific", "other")])
