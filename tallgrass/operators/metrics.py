"""Ranking metrics as aggregates over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by_score(df: DataFrame, item: str, score: str, tie: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(F.desc(score), tie)))


def ranking_metrics(ranked: DataFrame, item: str, *, k: int = 10, relevant: int = 2, tie: str = "passage") -> DataFrame:
    """ndcg, map, recall and precision at k and the reciprocal rank of every item, from rows with rank (from 1) and grade.

    A gain is 2^grade - 1; passages of at least the grade `relevant` count as hits. Precision divides by the number of results if that is below k, average precision by the number of
    relevant passages or k, whichever is less. Items without a relevant passage get 0.
    """
    by_rank, by_grade = Window.partitionBy(item).orderBy("rank"), Window.partitionBy(item).orderBy(F.desc("grade"), tie)
    hit = (F.col("grade") >= relevant).cast("int")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    rows = ranked.withColumn("_best", F.row_number().over(by_grade)).withColumn("_hits", F.sum(hit).over(by_rank))
    top = F.col("rank") <= k
    sums = rows.groupBy(item).agg(
        F.count("*").alias("n"), F.sum(hit).alias("rel"),
        F.sum(F.when(top, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("_best") <= k, gain / F.log2(F.col("_best") + 1)).otherwise(0.0)).alias("ideal"),
        F.sum(F.when(top, hit).otherwise(0)).alias("hits"),
        F.sum(F.when(top & (hit == 1), F.col("_hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(hit == 1, F.col("rank"))).alias("first"),
    )
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    return sums.select(
        item, share(F.col("dcg"), F.col("ideal")).alias(f"ndcg{k}"), share(F.col("ap"), F.least("rel", F.lit(k))).alias(f"map{k}"),
        share(F.col("hits"), F.col("rel")).alias(f"recall{k}"), share(F.col("hits"), F.least("n", F.lit(k))).alias(f"precision{k}"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def latency_adjusted(score: Column, mean_ms: Column) -> Column:
    """A score divided by log2(1 + the mean latency in seconds); the score itself where no latency is known or it is 0."""
    return F.coalesce(score / F.nullif(F.log2(1 + mean_ms / 1000.0), F.lit(0.0)), score)


def conditioned(items: DataFrame, gold: DataFrame, found: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """One row of recall, leakage and abstention over items (item, involved, abstained), gold findings (item, tier, critical, finding) and found ones (item, finding).

    An item is involved if it says so or has primary or relevant findings. Each recall is the mean over involved items that have findings of its kind (0 without such items); leakage is the share of
    excluded findings that are found, strict leakage that of excluded and neutral ones; conditioned_f1 is the harmonic mean of the recall of critical primary and relevant findings and 1 - leakage.
    Absent items should abstain. Repeated findings count once. Findings are dealt to as many tasks as tasks says (None: as a shuffle has).
    """
    # gold and found rows of an item meet once, and a finding's rows lie side by side there: no join
    every = gold.select("item", "finding", "tier", "critical", F.lit(0).alias("found")).union(found.where("item IS NOT NULL AND finding IS NOT NULL").select("item", "finding", F.lit(None).alias("tier"), F.lit(None).alias("critical"), F.lit(1).alias("found")))
    dealt = (every.repartition(tasks, "item") if tasks else every.repartition("item")).distinct()
    hits = dealt.withColumn("hit", F.max("found").over(Window.partitionBy("item", "finding"))).where("found = 0")
    good, critical = F.col("tier").isin("primary", "relevant"), F.coalesce("critical", F.lit(False))
    kinds = {
        "primary_critical": (F.col("tier") == "primary") & critical, "primary": F.col("tier") == "primary", "relevant_critical": (F.col("tier") == "relevant") & critical, "relevant": F.col("tier") == "relevant",
        "all_critical": good & critical, "all": good, "leaked": F.col("tier") == "excluded", "strict": F.col("tier").isin("excluded", "neutral"),
    }
    shares = hits.groupBy("item").agg(*[(F.sum(F.when(c, F.col("hit"))) / F.nullif(F.count_if(c), F.lit(0))).alias(k) for k, c in kinds.items()], F.count_if(good).alias("n_good"))
    each = items.join(shares, "item", "left").withColumn("involved", F.coalesce("involved", F.lit(False)) | (F.coalesce("n_good", F.lit(0)) > 0))
    mean = lambda k, c: F.coalesce(F.avg(F.when(c, F.col(k))), F.lit(0.0))
    yes, no = F.col("involved"), ~F.col("involved")
    one = each.agg(
        F.count_if(yes).alias("n_involved"), F.count_if(no).alias("n_absent"), *[mean(k, yes).alias(k) for k in kinds],
        F.avg(F.when(no, F.col("abstained").cast("int"))).alias("abstention_accuracy"), mean("leaked", no).alias("absent_leakage_rate"),
    )
    both = lambda r: F.coalesce(2 * r * (1 - F.col("leaked")) / F.nullif(r + 1 - F.col("leaked"), F.lit(0.0)), F.lit(0.0))
    return one.select(
        "n_involved", "n_absent", F.col("primary_critical").alias("primary_recall_critical"), F.col("primary").alias("primary_recall_complete"), F.col("relevant_critical").alias("relevant_recall_critical"),
        F.col("relevant").alias("relevant_recall_complete"), F.col("leaked").alias("leakage_rate"), F.col("strict").alias("leakage_rate_strict"), both(F.col("all_critical")).alias("conditioned_f1"),
        both(F.col("all")).alias("conditioned_f1_complete"), (1 - F.col("primary")).alias("omission_rate"), "abstention_accuracy", "absent_leakage_rate",
    )
